"""Line removal of op1 against brute force: lines at and just over each limit, and documents that they deplete."""

import collections
import hashlib

import duckdb
import pytest

from veristrata.llm import catalog, oracles, quality_rules


def made():
    """Rows (doc_id, source, text): on each host, documents that hold a shared line besides prose of their own."""
    rows = []

    def host(name, size, holders):
        for i in range(size):
            # own characters of every second holder stay under 30 % of the text
            own = " ".join(f"{name}{i}w{k}" for k in range(60 if i % 2 else 12))
            shared = "\n" + " ".join(f"{name}line{k}" for k in range(60))
            rows.append((len(rows), name, own + shared if i < holders else own + "\n" + " ".join(f"{name}{i}v{k}" for k in range(60))))

    host("a", 450, 101)  # over 100 documents, under a quarter of the host
    host("b", 450, 100)  # 100 documents, under a quarter
    host("c", 40, 11)  # over 10 documents and a quarter
    host("d", 44, 11)  # a quarter, no more
    host("e", 12, 10)  # 10 documents, no more
    host(None, 300, 150)  # over both limits, no host
    rows.append((len(rows), "a", rows[1][2]))  # a plain copy counts once
    return rows


def expected(rows, max_docs=100, min_docs=10, max_share=0.25, min_left=0.3):
    """The lines over the limits of each host, and whether each document has enough left."""
    lines = {i: frozenset(" ".join(x.lower().split()) for x in t.split("\n") if x.strip()) for i, _, t in rows}
    number = {x: int(hashlib.md5("\n".join(sorted(x)).encode()).hexdigest()[:15], 16) for x in lines.values()}
    docs = collections.defaultdict(set)
    for i, s, _ in rows:
        docs[s].add(lines[i])
    over, left = {}, {}
    for s, every in docs.items():
        n = collections.Counter(x for d in every for x in d)
        homes = {x: min((d for d in every if x in d), key=number.get) for x in n}
        over[s] = {x: homes[x] for x, c in n.items() if c > max_docs or (c > min_docs and c > max_share * len(every))}
    for i, s, _ in rows:
        size = sum(map(len, lines[i]))
        left[i] = sum(len(x) for x in lines[i] if over[s].get(x, lines[i]) == lines[i]) >= min_left * size
    return over, left


def test_lines_over_either_limit_are_removed(spark, tmp_path):
    rows = made()
    over, left = expected(rows)
    assert {s: len(x) for s, x in over.items()} == {"a": 1, "b": 0, "c": 1, "d": 0, "e": 0, None: 1}
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in catalog.QUERIES["op1_quality_rules"](spark, str(tmp_path)).collect()}
    assert {i for i, r in found.items() if r.kept} == {i for i, r in found.items() if not r.base_failed and left[i]}
    assert any(not r.base_failed and not r.kept for r in found.values())
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, r in found.items() if r.kept}


@pytest.mark.parametrize("limits", [(1, 1, 0.25, 0.3), (100, 10, 0.25, 0.3), (1000, 5, 0.4, 0.9), (10, 20, 0.1, 0.99)])
def test_limits_agree_with_brute_force_and_sql(spark, tmp_path, limits):
    rows = made()
    names = dict(zip(("max_docs", "min_docs", "max_share", "min_left"), limits))
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(df, **names).collect()}
    _, left = expected(rows, **names)
    assert {i: k for i, (_, k) in found.items()} == {i: not failed and left[i] for i, (failed, _) in found.items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, base_failed, kept FROM ({oracles.quality(**names)})").fetchall()} == found


def test_columns_of_any_name_stay(spark):
    columns = ["doc_id", "source", "text", "_host", "_t", "_w", "_fp", "_marks", "_gone", "__row", "kept", "a.b"]
    df = spark.createDataFrame([tuple(f"{c}{i}" for c in columns) for i in range(3)], columns)
    assert quality_rules.judge(df).columns == [c for c in columns if c not in ("text", "kept")] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert quality_rules.judge(df).select("`a.b`", "_fp").distinct().count() == 3
    assert quality_rules.keep_good(df).columns == columns and quality_rules.keep_good(df).count() == 0


def test_repeated_rows_each_give_a_row(spark):
    rows = [(1, "a", "x y z")] * 3 + [(None, None, None)] * 2
    assert quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).count() == 5
