"""cer_by_lang over whole texts, against brute force."""

import collections
import random

from veristrata import catalog


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_reads_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = ["a" * 60 + "B" * 60, "İstanbul " * 12 + "AbAbAb", "ΑΣ ΣΑΣ ß ẞ Ǆ ǅ 𐐀𐐨 " * 5, "", None, "Aa", "x" * 200]
    texts += ["".join(rng.choices("abAB İΣ.", k=rng.randint(61, 200))) for _ in range(20)]
    rows = [(i, t, ("en", "de")[i % 2]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    edits, size = collections.Counter(), collections.Counter()
    for _, t, lang in rows:
        edits[lang] += distance(t or "", (t or "").lower())
        size[lang] += len(t or "")
    found = {r.lang: r.cer for r in catalog.QUERIES["cer_by_lang"](spark, str(tmp_path)).collect()}
    assert found == {lang: round(edits[lang] / size[lang], 6) for lang in size}
