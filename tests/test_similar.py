"""Links between texts of common grams, against all pairs."""

import random

from veristrata import catalog
from veristrata.operators import similar
from veristrata.operators import simhash as S


def test_near_sets_meet_in_a_key():
    rng = random.Random(7)
    met = 0
    for n in [5, 6, 9, 12, 14, 15, 20, 40, 60, 100, 300, 301, 1000] * 12:
        a = [rng.choice("abcdefghij ") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, 1 + n // 90)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = b[: len(b) - rng.randint(0, n // 12)] if rng.random() < 0.5 else b
        x, y = "".join(a), "".join(b)
        p, q = S._grams(x, 5), S._grams(y, 5)
        (m, k), (o, j) = similar.keys(x), similar.keys(y)
        assert (m, o) == (len(p), len(q))
        if 10 * len(p & q) >= 9 * len(p | q):
            met += 1
            assert set(k.tolist()) & set(j.tolist())
            assert 19 * sum(abs(u - v) for u, v in zip(similar.sketch(x), similar.sketch(y))) <= m + o
    assert met > 60


def test_all_links_are_found(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = ["", "", "ab", "ab", "abc"]
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 400]))]
        texts.append(" ".join(t))
        for _ in range(i % 4):  # copies, and chains of ever more changes
            t = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = [S._grams(t, 5) for t in texts]
    label = list(range(len(texts)))
    linked = set()
    for b in range(len(texts)):
        for a in range(b):
            if grams[a] and grams[b] and 10 * len(grams[a] & grams[b]) >= 9 * len(grams[a] | grams[b]):
                linked |= {a, b}
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    found = catalog.QUERIES["dup_components"](spark, str(tmp_path)).collect()
    assert len(linked) > 50 and {(r.doc_id, r.label) for r in found} == {(v, label[v]) for v in linked}
