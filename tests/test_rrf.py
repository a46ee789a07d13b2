"""rrf_fuse over the union of both rankings, against brute force."""

import math

from veristrata import catalog


def test_rrf_keeps_documents_of_one_ranking(spark, tmp_path):
    vectors = {i: [math.sin(i * i), math.cos(3 * i), math.sin(7 * i)] for i in range(260)}
    spark.createDataFrame([(i, v, i % 3) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    want = {}
    for q in range(0, 260, 50):
        others = [i for i in stored if i != q]
        for ranked in (sorted(others, key=lambda i: (-cosine(stored[q], stored[i]), i))[:20], sorted(others, key=lambda i: (abs(i - q), i))[:200]):
            for rank, i in enumerate(ranked, 1):
                want[q, i] = want.get((q, i), 0) + 1 / (60 + rank)
    found = {(r.query_id, r.vec_id): r.score for r in catalog.QUERIES["rrf_fuse"](spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys() and len(found) > 6 * 200
    assert all(abs(found[k] - want[k]) < 1e-7 for k in want)
