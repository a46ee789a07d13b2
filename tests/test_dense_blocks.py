"""Dense search of more queries than one broadcast takes."""

import pytest
from pyspark.sql import functions as F

from veristrata import catalog
from veristrata.operators import retrieval as R


def test_blocks_give_what_one_broadcast_gives(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2, 1.0], i % 3) for i in range(60)], "vec_id bigint, embedding array<float>, label int")
    queries = docs.filter("vec_id % 5 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(R.dense(queries, docs))
    assert len(whole) == 12 * 59
    for limit in (1, 5, 11):
        assert rows(R.dense(queries, docs, limit)) == whole


def test_best_by_matrices_are_those_of_all_pairs(spark, monkeypatch):
    # copies tie, two labels are null, a vector and an element are missing, one vector is shorter
    rows = [(i * 3 % 61, [float(i % 7), float(i % 5) - 2, 1.0], i % 3) for i in range(61)]
    rows[5], rows[9], rows[12], rows[20] = (rows[5][0], None, 1), (rows[9][0], [1.0, None, 2.0], 2), (rows[12][0], rows[12][1], None), (rows[20][0], rows[20][1], None)
    rows[30] = (rows[30][0], [1.0, 2.0], 0)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    queries = docs.filter("vec_id % 5 = 0 OR label IS NULL")
    pairs = R.dense(queries, docs).withColumn("score", F.round("score", R.PLACES))
    columns = ["query_id", "q_label", "vec_id", "label", "score", "rank"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    for cells in (R.MOST_CELLS, 2 * 16 * 7):
        monkeypatch.setattr(R, "MOST_CELLS", cells)
        for k, limit in ((1, 10_000), (4, 10_000), (100, 5)):
            assert rows(R.dense_best(queries, docs, k, limit=limit)) == rows(R.top_k(pairs, ["query_id"], "vec_id", k))
        other = R.top_k(pairs.filter("label <> q_label"), ["query_id"], "vec_id", 3)
        assert rows(R.dense_best(queries, docs, 3, others=True)) == rows(other)


def test_vector_of_zeros_ranks_first_as_in_sql(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [1.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    found = R.dense_best(docs.filter("vec_id = 0"), docs, 2).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2] and found[0].score != found[0].score and found[1].score == 0.707107


@pytest.mark.parametrize("name", ["weighted_fuse", "fast_path_curve", "dense_topk", "retrieval_metrics", "rrf_fuse"])
def test_no_pairs_are_made(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2, 1.0], i % 3) for i in range(1, 120)], "vec_id bigint, embedding array<float>, label int")
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    docs = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.50655, (1 - 0.50655**2) ** 0.5], 0)], "vec_id bigint, embedding array<float>, label int")
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.score for r in catalog.QUERIES["dense_topk"](spark, str(tmp_path)).collect()] == [0.5065]


def test_nearest_keys_are_those_of_all_pairs(spark):
    ids = spark.createDataFrame([(i * i % 97 + 100 * (i // 50),) for i in range(49)] + [(i * 7 + 3000,) for i in range(60)], "vec_id bigint").distinct()
    asked = ids.filter("vec_id % 3 = 0")
    pairs = asked.select(F.col("vec_id").alias("query_id")).join(ids, F.col("vec_id") != F.col("query_id"))
    want = R.top_k(pairs.withColumn("near", -F.abs(F.col("vec_id") - F.col("query_id"))), ["query_id"], "vec_id", 9, "near").select("query_id", "vec_id", "rank")
    assert sorted(map(tuple, R.nearest_keys(asked, ids, 9).collect())) == sorted(map(tuple, want.collect()))
