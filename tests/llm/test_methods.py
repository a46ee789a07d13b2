"""What the methods add to the base of the queries, their paths for large inputs, and the pipeline's stages, against brute force."""

import random
import re

import pytest
from test_queries import ALNUM_WORD, DOC_SCHEMA, DOCS, ITEMS, KINDS, LOWER, SPACE_WORD, linked

import corpus_pipeline
from veristrata.llm import decontaminate, license_scan, near_dedup, packing, pii, shared, token_counts


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def test_op10_finds_every_notice_in_reach():
    rng = random.Random(2)
    notices = license_scan.NOTICES[1:3] + license_scan.NOTICES[5:7]
    scanner = license_scan.Scanner(notices)
    seen = set()
    for _ in range(120):
        n, label = rng.choice(notices)
        said = list(n)
        for _ in range(rng.randint(0, len(n) // 10 + 3)):
            at = rng.randrange(len(said))
            how = rng.random()
            said[at : at + (how < 0.7)] = [] if how < 0.3 else [rng.choice("abcdefg ")]
        text = " ".join(("some words before " + "".join(said) + " and some after").split())
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        ends = [*(m.start() for m in re.finditer(" ", text)), len(text)]
        want = set()
        for notice, name in notices:
            k = len(notice) // 10
            if any(edits(notice, text[a:z], k) <= k for a in starts for z in ends if abs(z - a - len(notice)) <= k):
                want.add(name)
        found = scanner.find(text)
        assert {s[2] for s in found} == want, text
        assert all(edits(next(x for x, y in notices if y == name), text[a:z], 99) <= n for a, z, name, n, _ in found)
        seen.add((label in want, len(want)))
    assert {True, False} <= {x for x, _ in seen}


def labelled(n):
    """Rows (text, span or None), by other templates than the trees were fitted on."""
    rng = random.Random(6)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    h = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    out = []
    for _ in range(n):
        phone, ssn = rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")), f"{d(3)}-{d(2)}-{d(4)}"
        yes = [(rng.choice(("our phone is ", "Tel: ", "please call ", "mobile ", "contact: ")), phone), (rng.choice(("social security number ", "SSN ")), ssn), ("IBAN: ", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}")]
        no = [(rng.choice(("Order no. ", "invoice ", "serial number ", "version ", "ref ")), rng.choice((phone, ssn))), ("see item ", f"{d(3)} {d(3)} {d(4)}")]
        lead, what = rng.choice(yes + no)
        out.append((f"{h(5)} {lead}{what} thanks", what if (lead, what) in yes else None))
    return out


def test_op5_recall_and_precision_on_other_rows(spark):
    rows = labelled(400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in pii.find_pii(df).collect()}
    hit = sum(any(a <= t.index(w) and t.index(w) + len(w) <= z for a, z in got[i]) for i, (t, w) in enumerate(rows) if w)
    wrong = sum(bool(got[i]) for i, (_, w) in enumerate(rows) if not w)
    assert hit >= 0.9 * sum(w is not None for _, w in rows)
    assert wrong <= 0.05 * sum(w is None for _, w in rows)


def test_op5_thresholds_reach_their_precision(spark):
    margin, limits = pii.fit(spark)
    assert len(limits) == len(pii.GENERATORS) and any(x != float("inf") for x in limits)
    assert pii.fit(spark) == (margin, limits)


def shingle_sets(docs, size):
    out = {}
    for i, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("cell", [2, 3, 1000])
def test_op8_cells(spark, cell, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=60)
    docs = []
    for i in range(30):
        w = list(base) if i < 22 else rng.choices(words, k=40)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((100 - i, " ".join(w)))
    for f in (near_dedup.families, near_dedup.confirmed):
        monkeypatch.setattr(near_dedup, f.__name__, lambda *a, f=f: f(*a, cell=cell))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 2).collect()}
    assert found == linked({i: s for i, s in sorted(shingle_sets(docs, 2).items())})


def test_op9_blocks_of_items(spark):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = lambda df: sorted(map(tuple, df.drop("k1", "k2").collect()), key=repr)
    whole = rows(decontaminate.report(docs, items))
    assert any(r[-1] for r in whole)
    for block in (1, 30):
        assert rows(decontaminate.report(docs, items, block_words=block)) == whole


CLASH = ["k1", "k2", "_k1", "_id", "_has", "_t", "_text", "_host", "_marks", "_fp", "__row", "_spans", "_base", "part", "a", "n", "sig", "key", "number", "length", "a.b"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    rows = [(*d[:5], *[f"{c}{i}" for c in CLASH]) for i, d in enumerate(DOCS[:30])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *CLASH])
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = [tuple(r) for r in out.collect()]
    if name != "personal data":
        assert kept and set(kept) <= set(rows)


def test_repeated_rows(spark):
    twice = spark.createDataFrame([d[:2] for d in DOCS[:20]] * 2, "doc_id bigint, text string")
    assert token_counts.count_tokens(twice).count() == 40
    assert license_scan.scan_licenses(twice).count() == 40 and pii.find_pii(twice).count() == 40
    assert near_dedup.near_duplicates(twice, 2).count() == 40
    pieces = packing.pack_documents(twice)
    assert pieces.count() == pieces.select("sequence_id", "offset").distinct().count()


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {d[0]: d[1] for d in DOCS}
    run = lambda name, df: shared.materialise(stages[name](spark, df, str(tmp_path)), "stage")
    ids = lambda df: {r.doc_id for r in df.collect()}

    def good(text):
        w = SPACE_WORD.findall(text or "")
        where = {}
        for k in range(len(w) - 2):
            where.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {x for v in where.values() if len(v) > 1 for k in v for x in (k, k + 1, k + 2)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    docs = run("quality rules", docs)  # no line of DOCS is over a limit but those of copies and near copies, whose home stays
    assert ids(docs) <= {i for i, t in rows.items() if good(t)} and len(ids(docs)) >= 30
    left = sorted(((i, rows[i]) for i in ids(docs)), key=lambda r: (r[0] is None, r[0] or 0))
    label = linked(shingle_sets(left, 5))
    docs = run("near duplicates", docs)
    assert ids(docs) == {i for i, x in label.items() if i == x}
    windows = set()
    for _, t in ITEMS:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1) if w}
    clean = set()
    for i in ids(docs):
        w = ALNUM_WORD.findall((rows[i] or "").translate(LOWER))
        hit = {x for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for x in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert clean < ids(docs)
    docs = run("decontamination", docs)
    assert ids(docs) == clean
    extra = spark.createDataFrame([(10_000, DOCS[-2][1], "en", "s", len(DOCS[-2][1]), 5, "z")], DOC_SCHEMA)
    after = {r.doc_id: r for r in run("personal data", docs.unionByName(extra)).collect()}
    assert after.keys() == clean | {10_000}
    for i, r in after.items():
        text = DOCS[-2][1] if i == 10_000 else rows[i]
        spans = [m for kind, p, ok in KINDS for m in re.finditer(p, text) if ok(m[0])]
        assert not any(m[0] in r.text for m in spans) and r.n_chars == len(r.text)
        assert spans or "[" in r.text or r.text == text
    pieces = run("packing", docs).collect()
    assert {r.doc_id for r in pieces} == clean


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
