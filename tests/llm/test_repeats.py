"""Repeated byte strings against brute force: each path, long texts, repeated rows, and windows of one bucket."""

import collections
import random

import numpy as np
import pytest

from veristrata.llm import shared, substring_dedup


def brute(texts, length):
    """Per text, the bytes that strings standing twice or more cover."""
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        out.append(np.cumsum(mark)[:-1] > 0)
    return out


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, with_text=True, **options).collect()}
    out = []
    for i, t in enumerate(texts):
        mark = np.zeros(len(t.encode()), bool)
        for s in got[i].spans:
            mark[s.lo : s.hi] = True
        assert got[i].n_removed == mark.sum() and got[i].n_spans == len(got[i].spans)
        out.append(mark)
    return out


def made(rng, n):
    phrases = ["".join(rng.choices("abcdeé .\n", k=rng.randint(20, 90))) for _ in range(12)]
    texts = ["".join(rng.choices(phrases, k=rng.randint(0, 12))) + "".join(rng.choices("xyz ", k=rng.randint(0, 60))) for _ in range(n)]
    return texts + ["", "ab" * 200, "q" * 150, "z" * 500, texts[0], texts[0]]


@pytest.mark.parametrize("options", [{}, {"bucket": 2}, {"hot": 1}, {"bits": 1 << 26, "hot": 0, "bucket": 1}, {"bits": 4}])
def test_every_path(spark, options, monkeypatch):
    texts = made(random.Random(9), 40)
    want = brute([t.encode() for t in texts], 60)
    if options.get("bits") == 4:  # too few for the keys: the semi-join takes over
        monkeypatch.setattr(shared, "bit_table", None)
    for a, b in zip(found(spark, texts, length=60, seed=20, **options), want, strict=True):
        assert (a == b).all()


def test_longer_than_a_part(spark, monkeypatch):
    rng = random.Random(3)
    block = "".join(rng.choices("abcdefgh \n", k=900))
    long = "".join("".join(rng.choices("abcdefghij ", k=70_000)) + block for _ in range(20))
    assert len(long) > substring_dedup.PART
    texts = [long, "x" + block + "y", "nothing of it " * 2]
    for a, b in zip(found(spark, texts), brute([t.encode() for t in texts], 200), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize("seed", range(6))
def test_windows_of_one_bucket(seed):
    rng = random.Random(seed)
    phrases = [bytes(rng.choices(b"abcd", k=rng.randint(5, 60))) for _ in range(6)]
    segs = list({b"".join(rng.choices(phrases, k=rng.randint(2, 9))) for _ in range(30)})
    segs = [s for s in segs if len(s) >= 40]
    seen = collections.Counter(s[p : p + 40] for s in segs for p in range(len(s) - 39))
    for s, runs in zip(segs, substring_dedup.repeated_windows(segs, 40), strict=True):
        assert {p for a, z in runs for p in range(a, z)} == {p for p in range(len(s) - 39) if seen[s[p : p + 40]] > 1}
