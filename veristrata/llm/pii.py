"""Personal data: strict base patterns, and looser candidates judged by boosted trees.

Generators with high recall propose spans, which may overlap each other. Each span gets features of its format and of
the characters around it; gradient-boosted trees score it; per generator, a threshold calibrated on held-out rows
selects it. Selected spans that overlap a base span or a better selected one are dropped; base spans always stay.

The trees are fitted with Spark ML on a bounded set of TRAINING rows that are made by rule (invented contacts and
look-alikes such as order numbers, versions and dates) and then act as one SQL expression inside the scan: there is
no shuffle, no Python and no join. Whole texts are searched; the patterns run in linear time.

Null and empty texts have no spans: counts 0, empty strings. Repeated rows give one row each, an empty table none. Extra columns are
ignored by find_pii() and kept by redact().
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import shared

#: Kinds of the base patterns, in the order that breaks ties (fixed by the contract), then those of the method.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
#: Base patterns. Possessive, and bound to where a run starts, so that they match as the plain ones do but in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Generators of candidates: (kind, pattern, text that a document must contain).
GENERATORS = (
    ("phone", r"(?<![0-9+.,-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    ("secret", r"(?i)(?:token|secret|password|api[_-]?key)[\"' ]{0,3}[:=][\"' ]{0,3}[A-Za-z0-9_-]{16,128}", None),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,4}", "at"),
)
FEATURES = ("generator", "length", "digits", "letters", "marks", "keyword", "lookalike", "touches_left", "touches_right", "groups", "opens", "plus")
KEYWORD = r"(?i)(phone|tel|call|mobile|fax|contact|ssn|social|iban|account|bank|mail|reach|token|secret|password|key)(?:[^a-z]{0,3}(?:is|at|no|number|security|my|me|us|on)){0,3}[^a-z0-9]*$"
LOOKALIKE = r"(?i)(order|invoice|version|release|page|ref|isbn|item|serial|total|price|date|build|model)[^a-z]*(is|no|number)?[^a-z0-9]*$"
#: Rows that the trees are fitted and calibrated on; precision that a threshold must reach on the held-out third.
TRAINING, PRECISION = 3000, 0.99
SPAN = "struct<k:int,lo:int,hi:int,s:double>"


def spans(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of the pattern's matches that are valid, in code points, by one walk over the text between them."""
    walk = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def step(a, x):
        lo = a["at"] + x["gap"]
        hi = lo + F.length(x["m"])
        own = F.array(F.struct(F.lit(KINDS.index(kind)).alias("k"), lo.alias("lo"), hi.alias("hi"), F.lit(1.0).alias("s")))
        more = F.when(valid(x["m"]), F.concat(a["out"], own)).otherwise(a["out"])
        return F.when(x["m"].isNull(), a).otherwise(F.struct(hi.alias("at"), more.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(walk, start, step, lambda a: a["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(m: Column) -> Column:
    def passes(d):
        # every second digit from the right counts twice, its digits summed
        def part(i):
            x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
            return F.when(x > 9, x - 9).otherwise(x)

        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + part(i))
        return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(digits(m), passes)


def base_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, "email", lambda m: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), spans(text, IP, "ip", lambda m: m.rlike(OCTETS))).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), spans(text, CARD, "card", luhn)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), spans(text, PHONE, "phone", lambda m: F.length(digits(m)).between(9, 15))).otherwise(none),
    )


CANDIDATE = "array<struct<k:int,lo:int,hi:int,f:array<double>>>"


def generated(df: DataFrame, text: str, g: int) -> DataFrame:
    """df with _c{g}: the g-th generator's candidates."""
    kind, pattern, needs = GENERATORS[g]
    t, p, m, n = F.col(text), f"_p{g}", f"_m{g}", f"_n{g}"
    has = t.rlike(pattern) if needs is None else F.contains(t, F.lit(needs)) & t.rlike(pattern)
    df = df.withColumns({p: F.when(has, F.split(t, pattern, -1)), m: F.when(has, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))})
    around = lambda i: F.struct(F.length(F.get(p, i)).alias("gap"), F.length(F.get(m, i)).alias("n"), F.right(F.get(p, i), F.lit(24)).alias("left"), F.substring(F.get(p, i + 1), 1, 1).alias("right"), F.get(m, i).alias("m"))
    df = df.withColumn(n, F.transform(F.sequence(F.lit(0), F.size(m) - 1), around))

    def step(a, x):
        lo = a["at"] + x["gap"]
        hi = lo + x["n"]
        count = lambda p: F.length(F.regexp_replace(x["m"], p, "")).cast("double")
        yes = lambda c: F.when(c, 1.0).otherwise(0.0)
        features = F.array(F.lit(float(g)), x["n"].cast("double"), count("[^0-9]"), count("[^A-Za-z]"), count("[A-Za-z0-9]"), yes(x["left"].rlike(KEYWORD)), yes(x["left"].rlike(LOOKALIKE)), yes(x["left"].rlike("[A-Za-z0-9]$")), yes(x["right"].rlike("[A-Za-z0-9]")), F.size(F.split(x["m"], "[ .-]", -1)).cast("double"), yes(F.contains(x["m"], F.lit("("))), yes(x["left"].rlike(r"\+[0-9 ]*$")))
        own = F.array(F.struct(F.lit(KINDS.index(kind)).alias("k"), lo.alias("lo"), hi.alias("hi"), features.alias("f")))
        return F.struct(hi.alias("at"), F.concat(a["out"], own).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(CANDIDATE).alias("out"))
    return df.withColumn(f"_c{g}", F.coalesce(F.aggregate(n, start, step, lambda a: a["out"]), F.array().cast(CANDIDATE))).drop(p, m, n)


def candidates(df: DataFrame, text: str) -> DataFrame:
    """df with _c: array of (k, lo, hi, f: array of FEATURES) from all generators."""
    for g in range(len(GENERATORS)):
        df = generated(df, text, g)
    own = [f"_c{g}" for g in range(len(GENERATORS))]
    return df.withColumn("_c", F.concat(*own)).drop(*own)


def training(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """id, text and label of invented rows: contacts (1) and look-alikes (0), by rule from the row's number."""
    n = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))
    d = lambda salt, size: F.lpad(n(salt, 10**size).cast("string"), size, "0")
    word = lambda salt: F.element_at(F.array(*map(F.lit, ("river", "stone", "market", "garden", "winter", "signal", "paper", "harbour"))), (n(salt, 8) + 1).cast("int"))
    sep = F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit(".")), (n("sep", 3) + 1).cast("int"))
    phone = F.concat(F.when(n("par", 3) == 0, F.concat(F.lit("("), d("a", 3), F.lit(")"))).otherwise(d("a", 3)), sep, d("b", 3), sep, d("c", 4))
    ssn = F.concat(d("a", 3), F.lit("-"), d("b", 2), F.lit("-"), d("c", 4))
    iban = F.concat(F.lit("DE"), d("a", 2), F.lit(" "), d("b", 4), F.lit(" "), d("c", 4), F.lit(" "), d("e", 4), F.lit(" "), d("g", 4), F.lit(" "), d("h", 2))
    secret = F.concat(F.lit('token = "'), F.substring(F.md5(F.col("id").cast("string")), 1, 24), F.lit('"'))
    mail = F.concat(word("w1"), F.lit(" [at] "), word("w2"), F.lit(" [dot] com"))
    lead = F.element_at(F.array(*map(F.lit, ("phone: ", "call ", "tel. ", "contact me at ", "mobile number ", "fax "))), (n("lead", 6) + 1).cast("int"))
    false_lead = F.element_at(F.array(*map(F.lit, ("order ", "invoice no. ", "version ", "ref ", "serial number ", "page ", "total ", ""))), (n("false", 8) + 1).cast("int"))
    hidden = F.concat(F.lit("token = "), word("w1"), F.lit("_"), word("w2"), F.lit("_"), word("w3"))
    code = F.concat(F.lit("AB"), d("a", 2), F.lit("CDEF"), d("b", 4), F.lit("GH"), d("c", 2), F.lit("XY"))
    social = F.when(n("soc", 2) == 0, "ssn: ").otherwise("social security no. ")
    cases = [(F.concat(lead, phone), 1), (F.concat(social, ssn), 1), (F.concat(F.lit("iban "), iban), 1), (secret, 1), (F.concat(F.lit("mail "), mail), 1)]
    cases += [(F.concat(false_lead, phone), 0), (F.concat(false_lead, ssn), 0), (F.concat(false_lead, code), 0), (hidden, 0), (F.concat(word("w3"), F.lit(" "), d("a", 3), F.lit(" "), d("b", 3), F.lit(" "), d("c", 4)), 0)]
    pick = n("case", len(cases))
    text, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (t, y) in enumerate(cases):
        text, label = F.when(pick == i, t).otherwise(text), F.when(pick == i, y).otherwise(label)
    return spark.range(0, rows, 1, 2).select("id", F.concat(word("l"), F.lit(" "), text, F.lit(" "), word("r")).alias("text"), label.alias("label"))


def tree_sql(lines: list[str]) -> str:
    """A tree's printed form as a CASE expression over the array f."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D"
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (.+)\)", line).groups()
    yes = tree_sql(lines)
    lines.pop(0)
    return f"(CASE WHEN c.f[{feature}] <= {float(limit)!r}D THEN {yes} ELSE {tree_sql(lines)} END)"


_fitted: dict[str, tuple[str, list[float]]] = {}


def fit(spark: SparkSession, rows: int = TRAINING, precision: float = PRECISION) -> tuple[str, list[float]]:
    """The trees' margin as SQL over c.f, and each generator's threshold on it (inf: none is precise enough)."""
    key = f"{rows} {precision}"
    if key not in _fitted:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        made = candidates(training(spark, rows), "text").select("id", "label", F.explode("_c").alias("c"))
        made = shared.materialise(made.select("id", F.col("label").cast("double").alias("label"), F.col("c.f").alias("f")), "pii-training").coalesce(2)
        held = F.col("id") % 3 == 0
        model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, checkpointInterval=-1).fit(made.filter(~held).select("label", array_to_vector("f").alias("features")))
        parts = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
            parts.append(f"{float(weight)!r}D * {tree_sql(lines)}")
        margin = " + ".join(parts)
        rated = made.filter(held).select(F.struct("f").alias("c"), "label").selectExpr("c.f[0] AS g", f"{margin} AS m", "label").collect()
        limits = []
        for g in range(len(GENERATORS)):
            own = sorted(((r.m, r.label) for r in rated if int(r.g) == g), reverse=True)
            limit, good = float("inf"), 0
            for i, (m, y) in enumerate(own, 1):
                good += y
                last = i == len(own) or own[i][0] < m
                if last and good >= precision * i and i >= 10:
                    limit = m
            limits.append(limit)
        _fitted[key] = margin, limits
    return _fitted[key]


def with_spans(docs: DataFrame, text: str = "text", rows: int = TRAINING, precision: float = PRECISION) -> DataFrame:
    """docs with _base and _spans (base and selected), arrays of (k, lo, hi, s) in order."""
    margin, limits = fit(docs.sparkSession, rows, precision)
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_base", F.array_sort(base_spans(F.col("_t")), lambda a, b: F.when(a["lo"] != b["lo"], a["lo"] - b["lo"]).otherwise(a["k"] - b["k"])))
    df = candidates(df, "_t")
    allowed = " OR ".join(f"(c.f[0] = {g} AND m >= {limit!r}D)" for g, limit in enumerate(limits) if limit != float("inf")) or "false"
    df = df.withColumn("_good", F.expr(f"transform(filter(transform(_c, c -> struct(c.k AS k, c.lo AS lo, c.hi AS hi, c.f AS f, {margin} AS s)), x -> {allowed.replace('c.f', 'x.f').replace('m >=', 'x.s >=')}), x -> struct(x.k AS k, x.lo AS lo, x.hi AS hi, x.s AS s))"))
    beaten = lambda x, i: F.exists("_base", lambda b: (b["lo"] < x["hi"]) & (x["lo"] < b["hi"])) | F.exists(F.transform("_good", lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda o: (o["y"]["lo"] < x["hi"]) & (x["lo"] < o["y"]["hi"]) & ((o["y"]["s"] > x["s"]) | ((o["y"]["s"] == x["s"]) & (o["j"] < i))))
    df = df.withColumn("_added", F.when(F.size("_good") > 0, F.filter("_good", lambda x, i: ~beaten(x, i))).otherwise(F.col("_good")))
    df = df.withColumn("_spans", F.array_sort(F.concat("_base", "_added"), lambda a, b: F.when(a["lo"] != b["lo"], a["lo"] - b["lo"]).otherwise(a["k"] - b["k"])))
    return df.drop("_t", "_c", "_good", "_added")


def spelled(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, the base spans' digest and all spans of docs(doc_id, text)."""
    df = with_spans(docs.select("doc_id", "text"), **options)
    own = F.transform("_base", lambda s: s["k"])
    n = {f"n_{kind}": (F.size(own) - F.size(F.array_remove(own, k))).cast("bigint") for k, kind in enumerate(KINDS[:4])}
    return df.withColumns(n).select("doc_id", *n, F.sha2(spelled("_base"), 256).alias("base_sha256"), spelled("_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; overlapping spans become one. All columns stay.

    length: a column that holds the text's length, to be brought up to date where a text changes.
    """
    df = with_spans(shared.as_row(docs, _text=F.col(text)), "_text", **options)
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        fresh = F.struct(s["hi"].alias("at"), F.concat(a["out"], F.array(F.substr(F.col("_text"), a["at"] + 1, s["lo"] - a["at"]), F.concat(F.lit("["), F.upper(F.get(names, s["k"])), F.lit("]")))).alias("out"))
        return F.when(s["lo"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["hi"]).alias("at"), a["out"].alias("out")))

    done = F.aggregate("_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("_text"), a["at"] + 1, F.length("_text"))))
    df = df.withColumn("_done", F.when(F.size("_spans") > 0, done))
    changed = {text: F.coalesce("_done", "_text")}
    if length in docs.columns:
        changed[length] = F.when(F.col("_done").isNull(), F.col(shared.ROW).getField(length)).otherwise(F.length("_done").cast(docs.schema[length].dataType))
    return shared.from_row(df, docs, **changed)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(shared.table(spark, sf_dir, "documents"))
