"""Proximity matches of op9 against brute force."""

import collections
import random
import re

from veristrata.llm import catalog

WORD = re.compile(r"[a-z0-9]+")


def test_proximity(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(1, say(26)), (2, say(13)), (3, say(4)), (4, say(7)), (5, "gone " + say(12)), (6, None), (7, say(40)), (7, say(14)), (8, "w1"), (9, "never seen")]
    texts = [None, "", "w1"] + [say(rng.randint(1, 80)) for _ in range(40)]
    for _, t in items:
        w = (t or "").split()
        for step in (6, 12):
            put = [x for k, word in enumerate(w) for x in ((word, "new") if k % step == step - 1 else (word,))]
            out = [word for k, word in enumerate(w) if k % step != step // 2]
            swap = [("other" if k % step == 3 else word) for k, word in enumerate(w)]
            texts += [say(20) + " " + " ".join(x) + " " + say(5) for x in (put, out, swap, w)] + [" ".join(out)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, texts[-2])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, text in docs:
        w = WORD.findall((text or "").lower())
        for item, t in items:
            v = WORD.findall((t or "").lower())
            n = min(13, len(v))
            for at in range(len(v) - n + 1 if n else 0):
                window = collections.Counter(v[at : at + n])
                for s in range(len(w)):
                    if (window & collections.Counter(w[s : s + n + 1])).total() >= n - (n >= 6):
                        want[i, str(item)] = min(s, want.get((i, str(item)), s))
                        break
    rows = catalog.QUERIES["op9_proximity"](spark, str(tmp_path)).collect()
    found = {(r.doc_id, r.item_id): r.first_word for r in rows}
    exact = {r.doc_id for r in catalog.QUERIES["op9_decontamination"](spark, str(tmp_path)).collect() if r.n_items}
    assert len(rows) == len(found) and found == want
    assert exact < {i for i, _ in want}
