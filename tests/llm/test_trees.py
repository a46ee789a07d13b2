"""Reply trees of op3 against brute force: branches, ranks, cycles, odd roles and repeated nodes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from veristrata.llm import chat_format

ODD = ["user", "assistant", "a\\nb", "a\\sb\\", "\n\\", "x\x00\x01y", "<|im_end|>\n", "<\\|im_start|>", "", None]
SCHEMA = "conv_id bigint, node bigint, parent bigint, role string, text string, score double"


def made():
    rng, rows = random.Random(4), []
    for conv in range(12):
        own = []
        for _ in range(rng.randint(1, 25)):
            node = len(rows)
            parent = rng.choice(own) if own and rng.random() < 0.9 else None
            rows.append((conv, node, parent, rng.choice(ODD), f"t{node} [INST] <|im_end|>", rng.choice([0.0, 0.5, 1.0, float(node)])))
            own.append(node)
    n = len(rows)
    rows.append((20, n, 10**6, "user", "its parent is not there", 1.0))
    rows += [(21, n + 1 + k, n + 1 + (k + 1) % 3, "user", "on a cycle", 1.0) for k in range(3)]
    rows += [(21, n + 4, n + 1, "assistant", "below the cycle", 1.0), (21, n + 5, n + 4, "user", "leaf below it", 1.0)]
    rows += [(22, n + 6, n + 6, "user", "its own parent", 1.0)]
    rows += [(23, n + 7 + k, n + 6 + k if k else None, "user", str(k), 0.0) for k in range(40)]
    return rows


def expected(rows, top):
    up = {r[1]: r[2] if r[2] in {x[1] for x in rows} else None for r in rows}
    said = {r[1]: r for r in rows}
    found = collections.defaultdict(list)
    for leaf in set(up) - set(up.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            found[said[leaf][0]].append((-sum(said[x][5] for x in path) / len(path), leaf, [(said[x][3] or "", said[x][4]) for x in reversed(path)]))
    return {leaf: turns for branches in found.values() for _, leaf, turns in sorted(branches)[:top]}


@pytest.mark.parametrize("top", [1, 2, None])
def test_best_branches(spark, top):
    rows = made()
    df = spark.createDataFrame([*rows, rows[0], rows[5]], SCHEMA)
    done = chat_format.format_trees(df, top).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("said", chat_format.read_loss(F.col("formatted"), F.col("loss")))
    found = {r.leaf: ([tuple(t) for t in r.turns], r.said) for r in done.collect()}
    want = expected(rows, top)
    assert {k: v for k, (v, _) in found.items()} == want
    assert all(s == [t for role, t in turns if role == "assistant"] for turns, s in found.values())


def test_cycles_stay_small(spark):
    df = spark.createDataFrame([(1, k, (k + 1) % 4, "user", "c", 0.0) for k in range(4)] + [(1, 4, 0, "user", "below", 0.0)], SCHEMA)
    assert chat_format.paths(df).count() == 0


@pytest.mark.parametrize("role", [r for r in ODD if r])
def test_roles_come_back(spark, role):
    df = spark.createDataFrame([(role,)], "r string")
    assert df.select(chat_format.unescape_role(chat_format.escape_role(F.col("r")))).first()[0] == role
