"""Parts of the operators on their own."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veristrata.llm import encoding, license_scan, packing, suffix_groups, token_files


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(s):
    order = suffix_groups.suffix_array(s)
    assert order == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2000), st.data())
def test_direct_access(ids, data):
    x = np.array(ids, np.uint32)
    file = token_files.DacFile(token_files.pack_file([5, None], [len(x), 0], x))
    assert file.doc_ids == [5, None] and (file.document(0) == x).all() and not len(file.document(1))
    if ids:
        at = data.draw(st.integers(0, len(ids) - 1))
        assert token_files.read_token(file.levels, at) == ids[at]


def fewest(pieces, capacity):
    """The smallest number of sequences, by trying every place of every piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(pieces):
            best[0] = len(bins)
            return
        for b in {n: k for k, n in enumerate(bins)}.values():
            if bins[b] + pieces[at] <= capacity:
                bins[b] += pieces[at]
                place(at + 1, bins)
                bins[b] -= pieces[at]
        place(at + 1, [*bins, pieces[at]])

    place(0, [])
    return best[0]


def packed(pieces, capacity):
    counts = [0] * (capacity + 1)
    for x in pieces:
        counts[x] += 1
    plan, proven = packing.complete_bins(counts, capacity)
    left = list(counts)
    for lengths, times in plan:
        assert sum(lengths) <= capacity
        for x in lengths:
            left[x] -= times
    assert not any(left)
    return sum(t for _, t in plan), proven, sum(t for _, t in packing.best_fit(counts, capacity)), packing.lower_bound(counts, capacity)


def test_packing_is_fewest():
    rng, beaten = random.Random(5), 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 37, 100])
        pieces = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 6 + 1, capacity // 2) for _ in range(rng.randint(1, 12))]
        n, proven, best_fit, bound = packed(pieces, capacity)
        assert proven and bound <= n == fewest(pieces, capacity) <= best_fit
        beaten += n < best_fit
    assert beaten


def test_completion_beats_best_fit_on_many_pieces():
    rng = random.Random(5)
    n, _, best_fit, bound = packed([rng.randint(300, 1100) for _ in range(3000)], 2048)
    assert bound <= n < best_fit


def test_fillings_are_undominated():
    left = [0] * 1048
    for x in (1000, 600, 500, 400, 300):
        left[x] = 1
    found = list(packing.fillings(left, 1047, 1047, [10_000]))
    assert found == [(47, ((1000, 1),))]


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(i, 0, 700 + i % 5, i, "p", "o", "b", "n", "x") for i in range(40)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint, ids_crc32 bigint, part string, own string, before string, number string, n string")
    out = packing.pack_pieces(pieces)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(r[:9] for r in map(tuple, out.collect())) == rows


ODD = ["a", "b", "the", "Word", "É", "E\u0301", "J\u030c", "1", "23", ".", ",", "***", "'s", "'", " ", "  ", "\n", " \n", "\n ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u2028 ", "<|endoftext|>", "<|startoftext|>", "İ", "ẞ", "नम", "_", "!!", "ª", "🙂", "\u200d", "ſ", "K"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD) | st.text(max_size=4), max_size=12).map("".join), min_size=1, max_size=20), st.sampled_from([("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]))
def test_encoder_gives_the_library_s_ids(texts, vocabulary):
    path, keep_white = public_tokenizers.path(vocabulary[0]), vocabulary[1]
    ids, offsets = encoding.encoder(path, keep_white, 0)(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == [[*e.ids, 0] for e in want]


def test_many_small_files(spark, tmp_path):
    rows = [(i if i % 7 else None, "word " * (i % 23)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = f"file://{tmp_path}/dac"
    files = token_files.write_token_files(docs, folder, file_tokens=50)
    assert files.count() > 20 and all(f.n_tokens < 50 + 24 for f in files.collect())
    found = sorted(token_files.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == np.r_[0, np.cumsum([r.n_tokens for r in found])][:-1].tolist()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r.n_tokens for r in found) == sorted(len(library.encode(t).ids) + 1 for _, t in rows)


def test_fuzzy_notice():
    spans = license_scan.Scanner().find("x permision is hereby granted fre of charge to any persons obtaining a copy y")
    assert [(s[2], s[3]) for s in spans] == [("mit", 3)]
