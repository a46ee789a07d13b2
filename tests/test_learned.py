"""Estimators on held-out rows."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata import catalog
from veristrata.operators import learned as L

SF = "/root/testdata/sf0.001"


def test_char_grams(spark):
    grams = spark.createDataFrame([("Ab c",), ("",)], "t string").select(L.char_grams(F.col("t"), 1, 3)).collect()
    assert [r[0] for r in grams] == [[" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab ", " ", "c", " ", " c", "c ", " c "], []]


def test_word_grams(spark):
    grams = spark.createDataFrame([("one a two three",), ("",)], "t string").select(L.word_grams(F.col("t"))).collect()
    assert [r[0] for r in grams] == [["one", "two", "three", "one two", "two three"], []]


def test_terms_tell_languages_apart(spark):
    words = {"x": "aba abb aab baba", "y": "dodo dod ddo odo", "z": "kik kki iki kikk"}
    rows = [(i, lang, " ".join(words[lang].split()[j % 4] for j in range(i, i + 5))) for i in range(40) for lang in words]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "id int, lang string, t string")
    sides = {"t": L.char_grams(F.col("t"), 1, 3)}
    fitted = L.fit_terms(df.filter("id % 2 = 0"), "id", "lang", sides)
    held = df.filter("id % 2 = 1").unionByName(spark.createDataFrame([(999, "x", "???"), (1000, "x", None)], "id int, lang string, t string"))
    scored = L.score_terms(held, "id", sides, fitted).join(df, "id", "left").collect()
    assert len(scored) == 62  # one row for each, with or without known terms
    assert all(r.label == r.lang for r in scored if r.lang) and all(0 < r.p <= 1 for r in scored)


def by_hand(texts, fitted, lo, hi):
    """(label, p) of each text, gram by gram."""
    (terms, idf), = fitted.sides
    out = []
    for text in texts:
        w = [f" {x} " for x in re.split(r"[\t-\r \x85\xa0\u2003]+", (text or "").lower()) if x]
        grams = Counter(x[i : i + n] for x in w for n in range(lo, min(hi, max(len(x), lo)) + 1) for i in range(max(len(x) - n + 1, 1)))
        known = {i: (1 + math.log(grams[t])) * v for i, (t, v) in enumerate(zip(terms, idf)) if grams[t]}
        z = list(fitted.intercepts)
        for i, v in known.items():
            z = [a + v / norm(known.values()) * b for a, b in zip(z, fitted.coefficients[i])]
        e = [math.exp(a - max(z)) for a in z]
        out.append((fitted.labels[e.index(max(e))], max(e) / sum(e)))
    return out


@pytest.mark.parametrize(("lo", "hi"), [(1, 5), (2, 3), (4, 5), (1, 12)])
def test_scores_are_those_made_gram_by_gram(spark, monkeypatch, lo, hi):
    texts = ["Ärger mit ÄRGER im Haus", "naïve\u2003café 😀😀", "a", "", " \t a\x1cb\n", None, "zz qq 0x", "a a a a b", "haus haus a b c d"]
    rows = [(i, "xyz"[i % 3], texts[i % len(texts)]) for i in range(33)]
    df = spark.createDataFrame(rows, "id int, lang string, t string").repartition(2)
    sides = {"t": L.char_terms(F.col("t"), lo, hi)}
    fitted = L.fit_terms(df, "id", "lang", sides)
    n = Counter(g for _, _, t in rows for g in set(spark_grams(spark, t, lo, hi)))
    assert fitted.sides[0][0] == sorted(t for t in n if n[t] >= 2)
    assert [v for v in fitted.sides[0][1]] == pytest.approx([math.log(34 / (1 + n[t])) + 1 for t in fitted.sides[0][0]])
    asked = df.unionByName(spark.createDataFrame([(99, None, "ÄRger unknown ぁ haus"), (100, None, "ぁ")], df.schema))
    want = by_hand([r.t for r in asked.orderBy("id").collect()], fitted, lo, hi)
    for units in (L.PART_UNITS, 1):
        monkeypatch.setattr(L, "PART_UNITS", units)
        found = L.score_terms(asked, "id", sides, fitted).orderBy("id").collect()
        assert [r.label for r in found] == [x for x, _ in want] and [r.p for r in found] == pytest.approx([p for _, p in want])
    # as an array of grams, the same
    whole = L.score_terms(asked, "id", {"t": L.char_grams(F.col("t"), lo, hi)}, fitted).orderBy("id").collect()
    assert [(r.label, round(r.p, 9)) for r in whole] == [(r.label, round(r.p, 9)) for r in found]


def spark_grams(spark, text, lo, hi, seen={}):
    if (text, lo, hi) not in seen:
        seen[text, lo, hi] = spark.createDataFrame([(text,)], "t string").select(L.char_grams(F.col("t"), lo, hi)).first()[0] or []
    return seen[text, lo, hi]


def test_fit_by_products_of_rows_is_that_of_terms(spark, monkeypatch):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(i, "xyz"[i * i % 3], " ".join(words[(i * j + j) % 10] for j in range(i % 6))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, lang string, t string")
    for sides in ({"t": L.char_terms(F.col("t"), 1, 2)}, {"a": L.word_grams(F.col("t")), "b": L.char_terms(F.col("t"), 1, 1)}):
        monkeypatch.setattr(L, "EXACT_ROWS", 4000)
        found = [(r.label, r.p) for r in L.score_terms(df, "id", sides, L.fit_terms(df, "id", "lang", sides)).orderBy("id").collect()]
        monkeypatch.setattr(L, "EXACT_ROWS", 0)
        want = [(r.label, r.p) for r in L.score_terms(df, "id", sides, L.fit_terms(df, "id", "lang", sides)).orderBy("id").collect()]
        assert [x for x, _ in found] == [x for x, _ in want] and [p for _, p in found] == pytest.approx([p for _, p in want], abs=2e-3)


def test_products_of_rows(monkeypatch):
    x = np.random.default_rng(0).random((30, 50)) * (np.random.default_rng(1).random((30, 50)) < np.linspace(0.02, 1, 50))
    row, term = np.nonzero(x)
    for few, block in ((64, 2048), (5, 7), (0, 1)):
        assert np.allclose(L._row_products(row, term, x[row, term], 30, few, block), x @ x.T)


def test_scoring_makes_no_rows_of_terms(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2], f"a{i % 2} b") for i in range(8)], "id int, lang string, t string")
    sides = {"t": L.char_terms(F.col("t"))}
    plan = L.score_terms(df, "id", sides, L.fit_terms(df, "id", "lang", sides))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan


def test_temperature(spark):
    # logits four times too sharp: half as sure is right in the middle
    rows = [([math.log(3.0) * 4, 0.0], 0)] * 3 + [([math.log(3.0) * 4, 0.0], 1)]
    df = spark.createDataFrame(rows, "logits array<double>, at int")
    assert abs(L.fit_temperature(df) - 4) < 0.01


def test_rows_without_a_fold_are_refused(spark):
    with pytest.raises(ValueError, match="cross-fitted"):
        L.fit_verdict(spark.createDataFrame([(1.0, "a", None)], "x double, label string, fold int"), ["x"])


def test_verdict_of_unknown_class_and_no_passages(spark):
    rows = [(i, float(i % 2), float(i % 3), "Supported" if i % 2 else "Refuted", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label string, fold int")
    model = L.fit_verdict(df, ["x", "y"])
    found = L.learned_verdict(df, model, "id", F.when(F.col("id") == 0, 0).otherwise(3)).join(df, "id").collect()
    assert all((r.verdict, r.confidence) == ("NEI", 0.0) if r.id == 0 else r.verdict == r.label for r in found)
    assert all(r.probs[2] == r.probs[3] == 0 and abs(sum(r.probs) - 1) < 1e-9 for r in found if r.id)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_learned_queries(spark):
    lang = catalog.QUERIES["language_id"](spark, SF).alias("a").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("gold")), "doc_id").collect()
    assert len(lang) == 200 and sum(r.lang == r.gold for r in lang) >= 180
    verdicts = catalog.QUERIES["learned_verdict"](spark, SF).filter("fold = 1").collect()
    assert verdicts and sum(r.verdict == r.label for r in verdicts) >= 0.7 * len(verdicts)
    arms = {r[0]: r[1] for r in catalog.QUERIES["stance_terms"](spark, SF).groupBy("arm").count().collect()}
    assert arms["both"] == arms["control"] > 0
    v = catalog.QUERIES["word_vectors"](spark, SF).collect()
    assert len(v) == 200 and all(abs(norm(r.vector) - 1) < 1e-6 or not any(r.vector) for r in v)


def norm(v):
    return math.sqrt(sum(x * x for x in v))
