"""rule_verdict over every passage, against brute force."""

import collections

from veristrata import catalog
from veristrata.operators import decisions as D


def test_every_passage_counts(spark, tmp_path):
    # the best passages of claims 0 to 3 have an event_id % 11 of 8 or less
    events = [(97 * 11 + 96, 0), (96, 1), (88, 2), (97 * 89 * 2 - 1, 3), (5, 4)] + [(i, 5 + i % 40) for i in range(200, 3000)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(c,) for c in range(60)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    best = collections.defaultdict(lambda: [0, 0])
    for e, claim in events:
        best[claim] = [max(best[claim][0], e % 97 / 192), max(best[claim][1], e % 89 / 176)]
    want = {}
    for claim, (s, r) in best.items():
        verdict = {(1, 1): "Conflicting", (1, 0): "Supported", (0, 1): "Refuted", (0, 0): "NEI"}[s >= 0.5, r >= 0.5]
        want[claim] = (verdict, round(1 - max(s, r) if verdict == "NEI" else max(s, r), 6))
    want |= {c: ("NEI", 0.0) for c in range(45, 60)}
    found = {r.claim: (r.verdict, r.confidence) for r in catalog.QUERIES["rule_verdict"](spark, str(tmp_path)).collect()}
    assert {v for v, _ in want.values()} == {"Conflicting", "Supported", "Refuted", "NEI"}
    assert found.keys() == want.keys()
    assert all(found[c][0] == want[c][0] and abs(found[c][1] - want[c][1]) < 2e-6 for c in want)


#: Parts of 200 and weights in tenths whose weighted mean is 1/4; as doubles, in this order, it comes out below.
QUARTER = [(15, 10), (62, 6), (54, 9), (76, 7), (60, 6)]


def test_order_of_the_sum_does_not_decide_a_limit(spark):
    passages = [(1, a / 200.0, 0.3, c / 10.0) for a, c in QUARTER] + [(2, a / 200.0, 0.3, c / 10.0) for a, c in QUARTER[::-1]]
    df = spark.createDataFrame(passages, "claim int, support double, refute double, relevance double").coalesce(1)
    found = sorted(map(tuple, D.live_scored(df, "claim").collect()))
    assert found == [(1, "Conflicting", 0.55), (2, "Conflicting", 0.55)]
    assert {r.verdict for r in D.live_verdict(df, "claim").collect()} == {"Conflicting"}
