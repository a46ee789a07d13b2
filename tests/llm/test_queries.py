"""The ten queries and the pipeline's stages against brute force, on tables with nulls, copies, ties and odd texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veristrata.llm import catalog, shared

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made():
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vo", "dél", "qu", "shi", "or"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(400)]

    def prose(n):
        return "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n))

    items = [" ".join(rng.choices(words, k=n)) for n in (20, 30, 5, 13)] + [None, "", " .. "]
    base = prose(30)
    texts = [prose(rng.randint(2, 40)) for _ in range(40)] + [base] * 4 + [prose(6)] * 2
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(1, 30)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "word", "one two", "a" * 5000, "ab " * 900, "x1 " * 300, "İstanbul ẞ Ǆ. <|endoftext|> a  <|endoftext|>"]
    texts += [prose(3) + " " + items[0] + " " + prose(3), prose(1) + " " + items[1].upper() + "!", items[2], "Mit License, and the GNU General Public\nLicense"]
    texts += ["mail a.b@c.de, d@e.f_g@h.ij ip 10.0.0.1 300.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 4111111111111112 phone +49 (30) 123-4567 token = \"0123456789abcdef0123\" ssn: 123-45-6789"]
    texts += [prose(4000)]
    return [(i if i != 7 else None, t, "en", None if i % 9 == 0 else f"s{i % 2}", len(t or ""), 5, "z") for i, t in enumerate(texts)], [(i, t) for i, t in enumerate(items)] + [(0, items[0])]


DOCS, ITEMS = made()
CHATS = [(1, 0, "user", "hi </s> <|im_end|>\n"), (1, 1, "assistant", "<|im_start|>\\ <\\|im_end|> ok"), (1, 1, "assistant", None), (2, 0, None, "x"), (3, 5, "assistant", ""), (4, None, "user", "n")] + [(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(70)]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def found(spark, sf, n, key="doc_id"):
    name = next(q for q in catalog.QUERIES if q.startswith(f"op{n}_"))
    rows = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).count() == (1 if name.startswith("op3_") else 0)


def test_op1(spark, sf):
    rows = found(spark, sf, 1)
    for doc_id, text, *_ in DOCS:
        text = text or ""
        w = SPACE_WORD.findall(text)
        at = collections.defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        covered = {k for v in at.values() if len(v) > 1 for j in v for k in (j, j + 1, j + 2)}
        lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = rows[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert r["kept"] <= (not failed)


def ids(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([d[1] or "" for d in DOCS], add_special_tokens=False)]


def test_op2(spark, sf):
    rows, start = found(spark, sf, 2), 0
    for (doc_id, *_), x in sorted(zip(DOCS, ids("byte_bpe_50k.json"), strict=True), key=lambda p: (p[0][0] is not None, p[0][0] or 0)):
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_op3(spark, sf):
    rows = found(spark, sf, 3, "conv_id")
    chats = collections.defaultdict(list)
    for c, t, role, text in sorted([*CHATS, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats[c].append((role or "", text or ""))
    assert rows.keys() == chats.keys()
    for c, turns in chats.items():
        said = "".join(t for role, t in turns if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op4(spark, sf):
    rows, seen = found(spark, sf, 4), collections.Counter()
    data = [(d[0], (d[1] or "").encode()) for d in DOCS]
    for _, x in data:
        seen.update(hash(x[p : p + 200]) for p in range(len(x) - 199))
    for doc_id, x in data:
        mark = np.zeros(len(x) + 1, np.int64)
        for p in range(len(x) - 199):
            if seen[hash(x[p : p + 200])] > 1:
                mark[p] += 1
                mark[p + 200] -= 1
        hit = np.cumsum(mark)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~hit])
        r = rows[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def numbers(m):
    return re.sub("[^0-9]", "", m)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(numbers(m)) <= 19 and luhn(numbers(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(numbers(m)) <= 15),
)


def test_op5(spark, sf):
    rows = found(spark, sf, 5)
    for doc_id, text, *_ in DOCS:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m[0]))
        spelled = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        r = rows[doc_id]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k[0]}"] for k in KINDS] == [sum(s[3] == k[0] for s in spans) for k in KINDS]


def test_op6(spark, sf):
    rows = found(spark, sf, 6)
    for (doc_id, text, *_), x in zip(DOCS, ids("byte_bpe_50k.json"), strict=True):
        assert (rows[doc_id]["n_bytes"], rows[doc_id]["n_tokens"], rows[doc_id]["over_limit"]) == (len((text or "").encode()), len(x) - 1, len(x) > 1025)


def test_op7(spark, sf):
    rows = [r.asDict() for r in catalog.QUERIES["op7_best_fit_packing"](spark, sf).collect()]
    by = {(r["doc_id"], r["piece"]): r for r in rows}
    want = 0
    for (doc_id, *_), x in zip(DOCS, ids("word_bpe_49k.json"), strict=True):
        for piece, at in enumerate(range(0, len(x), 2048)):
            part, r = x[at : at + 2048], by[doc_id, piece]
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(part.tobytes()))
            want += 1
    assert want == len(rows) == len(by)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def linked(sets):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    order = list(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def test_op8(spark, sf):
    rows, sets = found(spark, sf, 8), {}
    for doc_id, text, *_ in DOCS:
        if doc_id is not None:
            w = SPACE_WORD.findall((text or "").translate(LOWER))
            sets[doc_id] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    label = linked(sets)
    for i, s in sets.items():
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (len(s), label[i], label[i] == i)


def test_op9(spark, sf):
    rows, windows = found(spark, sf, 9), collections.defaultdict(set)
    split = lambda t: ALNUM_WORD.findall((t or "").translate(LOWER))
    for item, text in ITEMS:
        w = split(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(item))
    for doc_id, text, *_ in DOCS:
        w, hit, items = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    items |= own
                    hit.update(range(k, k + n))
        r = rows[doc_id]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


def test_op10(spark, sf):
    rows = found(spark, sf, 10)
    for doc_id, text, *_ in DOCS:
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        places = [(k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = rows[doc_id]
        at = [k for k, _ in places]
        labels = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_pipeline_stages(spark, sf):
    docs = shared.table(spark, sf, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()} if n < 4 else {}
        docs = shared.materialise(stage(spark, docs, sf), "stage")
        if n == 4:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name != "personal data":
            assert all(before[i] == r for i, r in after.items())
        else:
            assert after.keys() == before.keys() and not any("a.b@c.de" in r["text"] for r in after.values())
    assert docs.count() > 0
