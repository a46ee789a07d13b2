"""Token counts by rank-synchronous merging of ragged arrays.

Each batch's pre-tokens that are not known yet lie end to end in one numpy array of symbols. In every round each
sequence finds the lowest merge rank among its neighbouring pairs and merges all places of that pair at once; a
sequence without a mergeable pair is done, and its symbols are counted.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give one row each, an empty table none; extra columns are
ignored. Texts of any length are whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared

#: The vocabulary that the query counts with.
VOCABULARY = "byte_bpe_50k.json"
#: White space as the vocabulary's library understands it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs between which no pre-token reaches: an optional space and what is not white, or white space.
RUNS = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The pre-tokens of byte-level BPE (fixed by the vocabulary).
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NONE = np.int64(1 << 40)
#: Entries of a worker's memory of counted runs.
KNOWN = 400_000


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Merges:
    """Merge ranks as sorted arrays: pair code -> rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.special = [t["content"] for t in file["added_tokens"]]
        self.first = np.zeros(256, np.int64)
        for name, byte in byte_names().items():
            self.first[byte] = vocab[name]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word."""
        out = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), out)
        while len(symbols) > 1:
            rank = self.ranks(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NONE], start)
            length = np.diff(np.r_[start, len(symbols)])
            out[owner[start]] = length
            lowest = np.repeat(least, length)
            hit = np.flatnonzero((rank < NONE) & (rank == lowest[:-1]))
            # of pairs that overlap (a a a) every second one merges, from the left
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = lowest < NONE
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


def counter(path: str):
    """A function from texts to their numbers of tokens, with a bounded memory of runs."""
    merges, runs, pre = Merges(path), re.compile(RUNS), regex.compile(PRE_TOKENS)
    special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
    known: dict[str, int] = shared.worker_memory(f"run counts of {path}")

    def learn(new: list[str]) -> None:
        pieces = [[p.encode() for p in pre.findall(r)] for r in new]
        unique = list(dict.fromkeys(p for ps in pieces for p in ps))
        count = dict(zip(unique, merges.count(unique).tolist(), strict=True)) if unique else {}
        for r, ps in zip(new, pieces, strict=True):
            known[r] = sum(map(count.__getitem__, ps))

    def count(texts: list[str]) -> list[int]:
        found = []
        for text in texts:
            parts = special.split(text) if special and special.search(text) else [text]
            found.append((len(parts) - 1, [r for part in parts for r in runs.findall(part)]))
        if len(known) > KNOWN:
            known.clear()
        learn(list({r for _, rs in found for r in rs} - known.keys()))
        return [n + sum(map(known.__getitem__, rs)) for n, rs in found]

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs(doc_id, text)."""

    def run(batches):
        import public_tokenizers

        count = counter(path or public_tokenizers.path(VOCABULARY))
        for b in shared.slices(batches, 4000, 16 << 20):
            texts = b.column("text").to_pylist()
            n = pa.array(count(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", shared.text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(shared.table(spark, sf_dir, "documents"))
