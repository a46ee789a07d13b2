"""Live verdicts of claims whose means lie on a limit or on half of a last decimal, against SQL in one thread."""

import duckdb
import pytest

from veristrata import catalog

#: Events of a claim whose mean is 1/4; summed as doubles in this order it comes out below.
EDGES = {"live_verdict": [5993, 10127], "live_confidence": [5993, 10127], "two_model_agree": [1498, 11618]}


@pytest.mark.parametrize("name", EDGES)
def test_sums_follow_the_order_of_events(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE TABLE events AS SELECT unnest({EDGES[name]})::BIGINT AS event_id, 1::BIGINT AS user_id")
    want = con.sql(catalog.ORACLES[name])
    # from several files and out of order
    rows = spark.createDataFrame([(e, 1) for e in EDGES[name]][::-1], "event_id bigint, user_id bigint").repartition(3)
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert [tuple(r) for r in found.collect()] == want.fetchall()
