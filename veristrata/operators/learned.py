"""Estimators on terms and on features (E-01, E-02, E-04, E-11, E-12, V-02, M-40), fitted by pyspark.ml.

Fitting turns the training rows into sparse vectors. Scoring meets each batch of rows with the coefficients, which are
sent to all tasks (their number is bounded by the vocabulary): no row is made for a term, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veristrata.functions.text import tokens
from veristrata.operators.retrieval import top_k

VERDICTS = ("Supported", "Refuted", "Conflicting", "NEI")
#: Logit of a class that the fitted model does not know.
UNKNOWN = -1e9
#: Terms of a vocabulary at most, documents that hold a term at least, training rows of word vectors at most.
VOCABULARY, LEAST_DOCUMENTS, TRAINING_ROWS = 200_000, 2, 200_000
#: Rows of a task of a fit; rows and cells up to which a fit on terms is done by the products of all pairs of rows.
FIT_TASK_ROWS, EXACT_ROWS, EXACT_CELLS = 5_000, 4_000, 20_000_000
#: Units of a batch's slice, of which a task holds the terms.
PART_UNITS = 1_000_000


def _words(text: Column) -> Column:
    """What white space parts in a lower-case text, with an empty string where it begins or ends with one."""
    return F.split(F.lower(text), r"(?U)\s+")


def char_grams(text: Column, lo: int = 1, hi: int = 5) -> Column:
    """n-grams of a lower-case text's words, each between two spaces; a padded word shorter than n is one gram."""
    padded = F.transform(F.filter(_words(text), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w):
        sizes = F.sequence(F.lit(lo), F.least(F.lit(hi), F.greatest(F.length(w), F.lit(lo))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, n))))

    return F.flatten(F.transform(padded, of))


def word_grams(text: Column) -> Column:
    """Words of two characters and pairs of neighbours."""
    w = F.filter(tokens(text), lambda x: F.length(x) >= 2)

    def both(x):
        pairs = F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.concat_ws(" ", F.get(x, i), F.get(x, i + 1)))
        return F.concat(x, F.when(F.size(x) >= 2, pairs).otherwise(F.array().cast("array<string>")))

    return F.get(F.transform(F.array(w), both), F.lit(0))


class Grams(NamedTuple):
    """Terms of a side: an array's units, or their n-grams from sizes[0] to sizes[1], each unit between two spaces."""

    units: Column
    sizes: tuple[int, int] | None = None


def char_terms(text: Column, lo: int = 1, hi: int = 5) -> Grams:
    """char_grams() by words, for sides: the grams are made once for a word, not for each of its places."""
    return Grams(_words(text), (lo, hi))


def _sides(sides: dict[str, Column | Grams]) -> tuple[list[Column], list[tuple[int, int] | None]]:
    """The units of the sides as columns s0, s1, ... and their sizes."""
    grams = [s if isinstance(s, Grams) else Grams(s) for s in sides.values()]
    return [g.units.alias(f"s{i}") for i, g in enumerate(grams)], [g.sizes for g in grams]


def _terms(unit: str | None, sizes: tuple[int, int] | None) -> list[str]:
    if unit is None or sizes is None:
        return [] if unit is None else [unit]
    if not unit:
        return []
    (lo, hi), w = sizes, f" {unit} "
    return [w[i : i + n] for n in range(lo, min(hi, max(len(w), lo)) + 1) for i in range(max(len(w) - n + 1, 1))]


def _listed(units: list[str | None], sizes: tuple[int, int] | None, number: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the terms of all units in order, those without a number left out, and how many each unit has."""
    held = [[i for t in _terms(u, sizes) if (i := number(t)) is not None] for u in units]
    n = np.array([len(h) for h in held], np.int64)
    return np.fromiter(chain.from_iterable(held), np.int64, n.sum()), n


def _finder(terms: list[str], sizes: tuple[int, int] | None) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """_listed() of units by their places in terms. Grams are compared as numbers, of their characters' places in the terms'
    alphabet, where the longest gram fits 63 bits."""
    lo, hi = sizes or (0, 0)
    alphabet = sorted(set("".join(terms)))
    bits = len(alphabet).bit_length()
    if not 1 <= lo <= 3 or bits * hi > 63:
        index = {t: i for i, t in enumerate(terms)}
        return lambda units: _listed(units, sizes, index.get)
    place = np.zeros(0x110000, np.int64)  # 0: in no term
    place[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)

    def places(text: str) -> np.ndarray:
        return place[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    known = {}
    for n in range(lo, hi + 1):
        own = np.array([i for i, t in enumerate(terms) if len(t) == n], np.int32)
        digits = places("".join(terms[i] for i in own)).reshape(-1, n)
        known[n] = (pa.array((digits << (bits * np.arange(n - 1, -1, -1))).sum(1)), own)

    def held(units):
        padded = [f" {u} " if u else "" for u in units]
        sizes_held = np.array([len(w) for w in padded], np.int64)
        ends, chars = np.cumsum(sizes_held), places("".join(padded))
        left = np.repeat(ends, sizes_held) - np.arange(len(chars))
        found, key = np.full((len(chars), hi - lo + 1), -1, np.int32), np.zeros(len(chars) + 1, np.int64)
        for n in range(1, min(hi, len(chars)) + 1):
            key = key[: len(chars) - n + 1] << bits | chars[n - 1 :]
            if n >= lo:
                at = np.flatnonzero(left[: len(key)] >= n)
                f = pc.index_in(pa.array(key[at]), known[n][0])
                hit = f.is_valid().to_numpy(zero_copy_only=False)
                found[at[hit], n - lo] = known[n][1][f.drop_null().to_numpy()]
        hits = np.concatenate([[0], np.cumsum((found >= 0).sum(1))])
        return found[found >= 0].astype(np.int64), hits[ends] - hits[ends - sizes_held]

    return held


def _parts(batches: Iterable[pa.RecordBatch], sides: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PART_UNITS units."""
    for b in batches:
        units = sum(len(pc.list_flatten(b.column(f"s{i}"))) for i in range(sides))
        step = max(1, PART_UNITS * b.num_rows // max(1, units))
        yield from (b.slice(lo, step) for lo in range(0, b.num_rows, step))


def _bags(units: pa.Array, held: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each row of units, terms in order of their numbers; a unit's are looked up once for all rows."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(pc.list_flatten(units), null_encoding="encode")
    at = coded.indices.to_numpy(zero_copy_only=False)
    flat, size = held(coded.dictionary.to_pylist())
    begins = np.cumsum(size) - size

    def bag(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        n = size[at[lo:hi]]
        counts = np.bincount(flat[np.arange(n.sum()) + np.repeat(begins[at[lo:hi]] - np.cumsum(n) + n, n)])
        terms = np.flatnonzero(counts)
        return terms, counts[terms]

    return (bag(lo, hi) for lo, hi in zip([0, *ends[:-1]], ends))


def vocabulary(rows: DataFrame, sides: dict[str, Column | Grams], documents: int, most: int = VOCABULARY, least: int = LEAST_DOCUMENTS) -> list[tuple[list[str], np.ndarray]]:
    """Of each side, the `most` terms that stand in most documents, `least` at least, in order, and their idf.

    The documents of a term are counted in each batch before they are shuffled together.
    """
    columns, sizes = _sides(sides)

    def count(batches):
        for b in _parts(batches, len(sizes)):
            for side, own in enumerate(sizes):
                index: dict[str, int] = {}
                bags = _bags(b.column(f"s{side}"), lambda units: _listed(units, own, lambda t: index.setdefault(t, len(index))))  # noqa: B023
                df = np.zeros(len(index), np.int64)
                for terms, _ in bags:
                    df[terms] += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df), side, np.int32)), pa.array(list(index), pa.string()), pa.array(df)], ["side", "term", "df"])

    df = rows.select(*columns).mapInArrow(count, "side int, term string, df bigint").groupBy("side", "term").agg(F.sum("df").alias("df"))
    best = top_k(df.filter(F.col("df") >= least), ["side"], "term", most, "df").select("side", "term", "df").orderBy("side", "term").toArrow()  # bounded by `most`
    side, n = (best.column(c).to_numpy() for c in ("side", "df"))
    idf = np.log((1 + documents) / (1 + n)) + 1
    cut = np.searchsorted(side, np.arange(len(sizes) + 1))
    return [(best.column("term")[lo:hi].to_pylist(), idf[lo:hi]) for lo, hi in zip(cut, cut[1:])]


class Fitted(NamedTuple):
    """A classifier on terms: each side's terms and idf, the labels, coefficients (terms of all sides by labels), intercepts."""

    sides: list[tuple[list[str], np.ndarray]]
    labels: list
    coefficients: np.ndarray
    intercepts: np.ndarray


def _weights(batch: pa.RecordBatch, vocab: list[tuple[list[str], np.ndarray]], finders: list[Callable]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each row, (terms, weights) of each side: (1 + ln n) * idf, of length 1. Terms are numbered through all sides."""
    firsts = np.cumsum([0, *(len(terms) for terms, _ in vocab)])

    def one(side: int):
        idf = vocab[side][1]
        for terms, n in _bags(batch.column(f"s{side}"), finders[side]):
            w = (1 + np.log(n)) * idf[terms]
            yield terms + firsts[side], w / np.sqrt((w * w).sum())

    return zip(*map(one, range(len(vocab))))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with `weight`: all labels weigh the same together."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    totals = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n.crossJoin(totals)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def _fit(rows: DataFrame, c: float, known: tuple[list, float, int] | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """Labels, coefficients (labels by features) and intercepts of rows(label, features, weight): balanced logistic regression.
    With known labels, total weight and number of rows, the rows are not held here: the fit holds them in its own blocks."""
    rows = rows if known else rows.cache()
    labels = known[0] if known else [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]  # the declared classes
    indexed = rows.withColumn("y", (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("double"))
    total, n = known[1:] if known else rows.agg(F.sum("weight"), F.count("*")).first()
    # every step sends the gradient of each task, as large as the model
    tasks = max(4, n // FIT_TASK_ROWS)
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * total), family="multinomial", maxIter=100, standardization=False).fit(indexed.coalesce(tasks))
    if not known:
        rows.unpersist()
    return labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def _row_products(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, few: int = 64, block: int = 512) -> np.ndarray:
    """Products of all pairs of n sparse rows: terms of few rows go by pairs of cells, the others by dense blocks of terms."""
    order = np.argsort(term, kind="stable")
    row, w, (terms, start, df) = row[order], w[order], np.unique(term[order], return_index=True, return_counts=True)
    k = np.zeros((n, n))
    for d in range(1, few + 1):
        own = start[df == d]
        for lo in range(0, len(own), max(1, (1 << 18) // d**2)):
            at = own[lo : lo + max(1, (1 << 18) // d**2), None] + np.arange(d)
            pairs = row[at][:, :, None] * n + row[at][:, None, :]
            np.add.at(k.reshape(-1), pairs.reshape(-1), (w[at][:, :, None] * w[at][:, None, :]).reshape(-1))
    own = np.flatnonzero(df > few)
    for lo in range(0, len(own), block):
        x = np.zeros((n, min(block, len(own) - lo)))
        for j, t in enumerate(own[lo : lo + block]):
            x[row[start[t] : start[t] + df[t]], j] = w[start[t] : start[t] + df[t]]
        k += x @ x.T
    return k


def _fit_rows(rows: pa.Table, size: int, c: float, memory: int = 10, steps: int = 1000) -> tuple[list, np.ndarray, np.ndarray]:
    """_fit() of a sample of few rows(label, weight, i, w), by L-BFGS to the minimum.

    A gradient is a sum of rows, and so are all coefficients on the way: they are held as their share of each row, beside the
    products of these sums with each row, so that a step costs the products of the rows and not the terms.
    """
    labels = sorted(rows.column("label").unique().to_pylist())
    y = np.array([labels.index(x) for x in rows.column("label").to_pylist()])
    weight, n = rows.column("weight").to_numpy(), rows.num_rows
    cells = rows.column("i").combine_chunks()
    row = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(cells).to_numpy())
    term, w = cells.flatten().to_numpy(), rows.column("w").combine_chunks().flatten().to_numpy()
    k, reg, share, own = _row_products(row, term, w, n), 1 / (c * weight.sum()), weight / weight.sum(), (np.arange(n), y)

    def at(x):
        """Loss and gradient; a vector is (shares of rows, their products, intercepts)."""
        a, ka, b = x
        z = ka + b
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        loss = share @ (np.log(e.sum(1)) + z.max(1) - z[own]) + reg / 2 * (a * ka).sum()
        p[own] -= 1
        r = p * share[:, None]
        return loss, (r + reg * a, k @ r + reg * ka, r.sum(0))

    dot = lambda u, v: (u[0] * v[1]).sum() + u[2] @ v[2]
    add = lambda u, v, s: tuple(p + s * q for p, q in zip(u, v))
    x = (np.zeros((n, len(labels))), np.zeros((n, len(labels))), np.log(np.bincount(y, weight, len(labels)) / weight.sum()))
    loss, g = at(x)
    pairs = []
    for _ in range(steps):
        if dot(g, g) <= 1e-16:
            break
        d, alphas = g, []
        for s, t, rho in reversed(pairs):
            alphas.append(rho * dot(s, d))
            d = add(d, t, -alphas[-1])
        if pairs:
            d = tuple(v / (pairs[-1][2] * dot(pairs[-1][1], pairs[-1][1])) for v in d)
        for (s, t, rho), alpha in zip(pairs, reversed(alphas)):
            d = add(d, s, alpha - rho * dot(t, d))
        slope, step = dot(g, d), 1.0
        while True:
            moved = add(x, d, -step)
            new, turned = at(moved)
            if new <= loss - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if new >= loss:
            break
        s, t = add(moved, x, -1), add(turned, g, -1)
        if dot(s, t) > 0:
            pairs = [*pairs, (s, t, 1 / dot(s, t))][-memory:]
        x, loss, g = moved, new, turned
    matrix = np.array([np.bincount(term, w * x[0][row, j], size) for j in range(len(labels))])
    return labels, matrix, x[2]


def sampled(rows: DataFrame, key: str, training_rows: int) -> DataFrame:
    """About training_rows rows, those with the least hashes of their key; all of a smaller table. Only for fitting."""
    n = rows.count()
    if n <= training_rows:
        return rows
    u = F.conv(F.substring(F.md5(F.concat(F.lit("sample:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint") / float(2**48)
    return rows.filter(u < training_rows / n)


def fit_terms(rows: DataFrame, key: str, label: str, sides: dict[str, Column | Grams], c: float = 1.0, most: int = VOCABULARY, training_rows: int | None = None) -> Fitted:
    """E-01, E-02: a classifier on the sides' terms, fitted on all rows, or on about training_rows rows, see sampled(), if given.

    The vocabulary has at most `most` terms a side, so the coefficients are bounded; the rows of a large fit are held once, in
    blocks of pyspark.ml that go to disk where memory ends.
    """
    if training_rows is not None:
        rows = sampled(rows, key, training_rows).cache()
    vocab = vocabulary(rows, sides, rows.count(), most)
    columns, sizes = _sides(sides)
    size, kind = sum(len(terms) for terms, _ in vocab), rows.schema[label].dataType

    def found_in(batches):
        finders = [_finder(terms, own) for (terms, _), own in zip(vocab, sizes)]
        for b in _parts(batches, len(sizes)):
            found = [tuple(map(np.concatenate, zip(*row))) for row in _weights(b, vocab, finders)]
            ends = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]), pa.int32())
            yield b, [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([row[x] for row in found]), t)) for x, t in ((0, pa.int32()), (1, pa.float64()))]

    def cells(batches):
        for b, (i, w) in found_in(batches):
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("weight"), i, w], ["label", "weight", "i", "w"])

    def vectors(batches):
        for b, (i, w) in found_in(batches):
            n = b.num_rows
            v = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), i, w], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("weight"), v], ["label", "weight", "features"])

    labelled = balanced(rows.select(F.col(label).alias("label"), *columns), "label")
    total, n = labelled.agg(F.sum("weight"), F.count("*")).first()
    few = None
    if 0 < n <= EXACT_ROWS:
        # rows without a known term are vectors of zeros
        few = labelled.mapInArrow(cells, f"label {kind.simpleString()}, weight double, i array<int>, w array<double>").cache()
        exact = few.agg(F.sum(F.size("i"))).first()[0] <= EXACT_CELLS
    if few is not None and exact:
        labels, matrix, intercepts = _fit_rows(few.toArrow(), size, c)
    else:
        labels = [r[0] for r in labelled.select("label").distinct().orderBy("label").collect()]  # the declared classes
        schema = StructType([StructField("label", kind), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
        labels, matrix, intercepts = _fit(labelled.mapInArrow(vectors, schema), c, (labels, total, n))
    if few is not None:
        few.unpersist()
    if training_rows is not None:
        rows.unpersist()
    return Fitted(vocab, labels, np.ascontiguousarray(matrix.T), intercepts)


def score_terms(rows: DataFrame, key: str, sides: dict[str, Column | Grams], fitted: Fitted) -> DataFrame:
    """(key, label, p) of the likeliest class; rows without a known term go by the intercepts. Ties: the first label."""
    columns, sizes = _sides(sides)

    def score(batches):
        finders = [_finder(terms, own) for (terms, _), own in zip(fitted.sides, sizes)]
        for b in _parts(batches, len(sizes)):
            z = np.tile(fitted.intercepts, (b.num_rows, 1))
            for r, row in enumerate(_weights(b, fitted.sides, finders)):
                for terms, w in row:
                    z[r] += (w[:, None] * fitted.coefficients[terms]).sum(0)  # no product of matrices: it would start threads
            p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(z.argmax(1), pa.int32()), pa.array(p)], [key, "at", "p"])

    found = rows.select(key, *columns).mapInArrow(score, f"`{key}` {rows.schema[key].dataType.simpleString()}, at int, p double")
    return found.select(key, F.get(F.array(*map(F.lit, fitted.labels)), F.col("at")).alias("label"), "p")


def cross_fitted(rows: DataFrame, fold: str, fit: Callable[[DataFrame], object], score: Callable[[DataFrame, object], DataFrame], folds: int = 5) -> DataFrame:
    """E-12: every row scored by the model that did not see its fold."""
    out = None
    for i in range(folds):
        own = score(rows.filter(F.col(fold) == i), fit(rows.filter(F.col(fold) != i))).withColumn("fold", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def fit_verdict(train: DataFrame, features: list[str], c: float = 1.0) -> dict:
    """E-11: scaled features to balanced multinomial logits, as a plain dictionary. train(features, label, fold): a row without a
    fold was not scored by a model that had not seen it, and is refused."""
    if "fold" in train.columns and not train.filter("fold IS NULL").isEmpty():
        raise ValueError("training rows without a fold: they were not cross-fitted")
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(train)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    labels, matrix, intercepts = _fit(balanced(scaler.transform(raw).select("label", "features"), "label"), c)
    return {"features": features, "mean": list(scaler.mean), "std": list(scaler.std), "labels": labels, "matrix": matrix.tolist(), "intercepts": intercepts.tolist(), "temperature": 1.0}


def verdict_logits(model: dict, classes: tuple[str, ...] = VERDICTS) -> Column:
    """Logits in the order of classes, as one expression over the feature columns; constant features weigh nothing."""

    def one(name):
        if name not in model["labels"]:
            return F.lit(UNKNOWN)
        j = model["labels"].index(name)
        z = F.lit(model["intercepts"][j])
        for f, m, s, k in zip(model["features"], model["mean"], model["std"], model["matrix"][j]):
            z = z + ((F.col(f) - m) / s * k if s else F.lit(0.0))
        return z

    return F.array(*map(one, classes))


def nll(rows: DataFrame, temperatures: list[float]) -> dict[float, float]:
    """Mean negative log-likelihood of rows(logits, at: the true class's place from 0) at each temperature, in one pass."""

    def one(t):
        top = F.array_max("logits")
        total = F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp((z - top) / t))
        return F.avg(F.log(total) - (F.get("logits", F.col("at").cast("int")) - top) / t)

    found = rows.agg(*(one(t).alias(f"t{i}") for i, t in enumerate(temperatures))).first()
    return dict(zip(temperatures, found))


def fit_temperature(rows: DataFrame, lo: float = 0.05, hi: float = 10.0, points: int = 16, rounds: int = 5) -> float:
    """M-40: the temperature of least NLL between lo and hi. Each pass tries a row of temperatures and closes in on the best one's
    neighbours; five passes leave a factor of 1.0001."""
    a, b = math.log(lo), math.log(hi)
    rows = rows.select("logits", "at").cache()
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        loss = nll(rows, [math.exp(g) for g in grid])
        at = min(range(points), key=list(loss.values()).__getitem__)
        a, b = grid[max(at - 1, 0)], grid[min(at + 1, points - 1)]
    rows.unpersist()
    return math.exp((a + b) / 2)


def learned_verdict(rows: DataFrame, model: dict, key: str, passages: Column) -> DataFrame:
    """V-02: (key, verdict, confidence, probs in the order of VERDICTS); a claim without passages is (NEI, 0). Ties: the first."""
    from veristrata.operators.decisions import softmax

    p = rows.select(key, passages.alias("__n"), softmax(verdict_logits(model), model["temperature"]).alias("probs"))
    best = F.array_max("probs")
    verdict = F.get(F.array(*map(F.lit, VERDICTS)), (F.array_position("probs", best) - 1).cast("int"))
    some = F.col("__n") > 0
    return p.select(key, F.when(some, verdict).otherwise("NEI").alias("verdict"), F.when(some, best).otherwise(0.0).alias("confidence"), F.when(some, F.col("probs")).alias("probs"))


def word_vectors(rows: DataFrame, key: str, text: str, size: int = 100, seed: int = 42, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """E-04: (key, vector): the mean of a text's word vectors, of length 1 (zeros where no word is known), fitted on a bounded
    sample by hash."""
    worded = rows.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=2, seed=seed, inputCol="words", outputCol="v").fit(sampled(worded, key, training_rows))
    v = model.transform(worded).select(key, vector_to_array("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("n", norm).select(key, F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)).alias("vector"))


