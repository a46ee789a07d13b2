"""Token ids by the tokenizers library, piece by piece.

No pre-token of the two vocabularies reaches from a character that is not white space into a space behind it, so texts
are split at their spaces, each different piece of a batch is encoded once, and its ids are set in for all its places.
Ids of single runs stay in a bounded memory of the worker. Plain words, taken apart from the punctuation behind them,
go to the library's model directly, many in a call; other runs go through the whole library, joined by a special
token; a text that holds a special token's own string is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veristrata.llm import shared
from veristrata.llm.token_counts import RUNS, WHITE, byte_names

#: Entries of a worker's memory of encoded runs; when it is full, later runs are forgotten after their batch.
KNOWN = 500_000
#: Runs that go to the library in a call.
PART = 1024
#: A word of letters that every normal form leaves alone, and ASCII punctuation that makes a pre-token of its own behind it.
WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ʯ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def encoder(path: str, keep_white: bool, end_id: int | None = None):
    """A function from an Arrow array of texts to (ids, offsets): uint32 ids of all texts, each followed by end_id.

    keep_white: white space makes tokens.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    special, (mark, mark_id) = list(added), next(iter(added.items()))
    words = Tokenizer(library.model)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    shown = str.maketrans({chr(b): c for c, b in byte_names().items()})
    stop = "\n".translate(shown)
    (stop_id,) = words.encode(stop).ids
    cut = re.compile(RUNS if keep_white else rf"[^{WHITE}]+").findall
    known: dict[str, bytes] = shared.worker_memory(f"runs of {path}")
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def put(found: dict, runs: list[str], tokenizer, line: str, stop: int) -> None:
        got = np.array(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(got == stop) * 4
        data = got.tobytes()
        found.update(zip(runs, map(data.__getitem__, map(slice, [0, *(ends + 4).tolist()], [*ends.tolist(), len(data)])), strict=True))

    def look_up(pieces: list[str], single: bool = False) -> list[bytes]:
        """The ids of pieces that are not known; single: each is one run."""
        plan: list = []
        some, rest = set(), set()
        for p in pieces:
            m = WORD(p if keep_white else p.lower() if p.isascii() else p)
            if m and (keep_white or m[1].islower()):
                plan.append(m.groups())
                some.add(m[1])
                if m[2]:
                    rest.add(m[2])
            elif single or len(runs := cut(p)) == 1:
                plan.append((p, ""))
                rest.add(p)
            else:
                plan.append(runs)
        inner = {r for runs in plan if type(runs) is list for r in runs if r not in known}
        found = dict(zip(inner, look_up(list(inner), True), strict=True)) if inner else {}
        for runs, tokenizer, at_end in ((some, words, stop_id), (rest, library, mark_id)):
            runs = [r for r in runs if r not in known]
            for at in range(0, len(runs), PART):
                part = runs[at : at + PART]
                line = mark.join(part) if tokenizer is library else "\n".join(part).encode().decode("latin-1").translate(shown).replace(stop, f" {stop} ")
                put(found, part, tokenizer, line, at_end)
        out = []
        for p in plan:
            if type(p) is list:
                out.append(b"".join([found[r] if r in found else known[r] for r in p]))
            else:
                word, tail = p
                ids = found[word] if word in found else known[word]
                out.append(ids + (found[tail] if tail in found else known[tail]) if tail else ids)
        if len(known) < KNOWN:
            known.update(found)
            known.update((p, x) for p, x, how in zip(pieces, out, plan, strict=True) if type(how) is tuple)
        return out

    def encode(texts) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        n = len(texts)
        hard = np.zeros(n, bool)
        for s in special:
            hard |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = {int(i): np.array(e.ids, "<u4").tobytes() for i, e in zip(np.flatnonzero(hard), library.encode_batch_fast([texts[i].as_py() for i in np.flatnonzero(hard)], add_special_tokens=False))} if hard.any() else {}
        if keep_white:
            # a space behind other white space may share its pre-token: such texts are cut run by run
            spaced = pc.match_substring_regex(texts, r"[\s\v\x{85}\p{Z}] ").to_numpy(zero_copy_only=False) & ~hard
            at = np.flatnonzero(spaced).tolist()
            whole |= zip(at, look_up([texts[i].as_py() for i in at]))
            hard |= spaced
        plain = pc.if_else(pa.array(hard), "", texts) if hard.any() else texts
        split = pc.split_pattern(plain, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        index = pieces.indices.to_numpy().copy()
        names = pieces.dictionary if not keep_white else pc.binary_join_element_wise(" ", pieces.dictionary, "")
        names = names.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, names))
        unknown = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(unknown, look_up([names[k] for k in unknown]), strict=True):
            ids[k] = x
        # what stands before the first space has none before it; whole texts stand there, too
        first = [whole.get(i) for i in range(n)] if whole or keep_white else []
        if keep_white:
            heads = pieces.dictionary.take(pa.array(index[offsets[:-1]])).to_pylist()
            at = [i for i in range(n) if first[i] is None]
            for i, x in zip(at, look_up([heads[i] for i in at]), strict=True):
                first[i] = x
        for i, x in enumerate(first):
            if x is not None:
                index[offsets[i]] = len(ids)
                ids.append(x)
        if end:
            index = np.insert(index, offsets[1:], len(ids))
            offsets = offsets + np.arange(n + 1)
            ids.append(end)
        # the table's ids, set in for every place; a batch has far fewer than 2**31 of them
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        del split, pieces, names, ids
        size = sizes[index]
        ends = np.r_[0, np.cumsum(size, dtype=np.int64)]
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[index] - ends[:-1].astype(np.int32)
        places = np.repeat(shift, size)
        del shift, size, index
        places += np.arange(len(places), dtype=np.int32)
        return table[places], ends[offsets]

    return encode
