"""Publishers' ratings to verdicts (N-28, N-31 to N-34, V-06)."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: a rating in lower case, and the verdict that it stands for
REFUTED = (
    "false", "falso", "mostly false", "yanlış", "yanlis", "faux", "fake", "fałsz", "falsch", "fals", "falsk", "nepravda", "notizia falsa", "netačno", "pants on fire",
    "salah", "tak benar", "disinformation", "onwaar", "onjuist", "vals", "hamis", "epätosi", "errado", "rrenë", "incorrect", "inaccurate", "untrue", "ψευδές", "невярно",
    "خطأ", "زائف", "असत्य", "altered", "altered image", "montagem", "montaje", "fake tweet", "falsa", "yanliş", "ψευδες", "фейк", "really_false", "altered video",
    "immagine modificata", "distorcido",
)
SUPPORTED = ("true", "doğru", "prawda", "pravda", "verdadero", "verdadeiro", "correct", "waar")
CONFLICTING = (
    "مضلل", "half true", "partly false", "partly true", "partiellement faux", "mixture", "misleading", "engañoso", "enganoso", "enganyós", "és enganyós", "trompeur",
    "irreführend", "misleidend", "keliru", "sesat", "भ्रामक", "παραπληροφόρηση", "подвеждащо", "missing context", "out of context", "fuori contesto", "sem contexto",
    "sin contexto", "falta contexto", "محتوى ناقص", "عنوان مضلل", "parcialmente falso", "zavádějící", "zavádzajúce", "înșelător", "παραπλανητικό", "mengelirukan",
    "félrevezető", "contexte manquant", "manque de contexte", "fehlender kontext", "nedostaje kontekst",
)
NEI = ("unverifiable", "unproven", "unsupported", "no evidence", "not enough experts", "neoveriteľné", "sin registro", "cuestionable", "questionable")
VERDICTS = {"Refuted": REFUTED, "Supported": SUPPORTED, "Conflicting": CONFLICTING, "NEI": NEI}


@F.pandas_udf(ArrayType(StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    def read(cell):
        try:
            value = ast.literal_eval(cell.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return [cell.strip()]
        return [value] if isinstance(value, str) else list(map(str, value)) if isinstance(value, (list, tuple)) else []

    return cells.map(read, na_action="ignore")


def ratings(cell: Column) -> Column:
    """N-31: a cell with a list literal as its labels, lower case, none blank; another cell is one label, a null one none.

    Plain cells are read without Python: only those that begin like a literal go there.
    """
    trimmed = F.trim(cell)
    like = trimmed.rlike(r"""^[\[('"{0-9+-]|^(?:True|False|None)$""")
    many = F.when(like, _literal(F.when(like, cell))).otherwise(F.array(trimmed))
    clean = F.filter(F.transform(many, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(clean, F.array().cast("array<string>"))


def verdict(labels: Column) -> Column:
    """N-32: the verdict that all labels that have one agree on, else null."""
    known = F.create_map(*(F.lit(x) for v, words in VERDICTS.items() for w in words for x in (w, v)))
    found = F.array_distinct(F.filter(F.transform(labels, lambda x: F.try_element_at(known, x)), lambda v: v.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


#: How sure a publisher's rating makes a stance (fixed value).
RATED = 0.9


def stance(labels: Column) -> Column:
    """V-06: support, refute and neutral of a publisher's rating; one without a verdict for a side is neutral."""
    v = verdict(labels)
    sided = F.coalesce(v.isin("Supported", "Refuted"), F.lit(False))
    side = lambda name: F.when(v == name, RATED).otherwise(0.0)
    return F.struct(side("Supported").alias("support"), side("Refuted").alias("refute"), F.when(sided, 1 - RATED).otherwise(1.0).alias("neutral"))


def canonical_url(url: Column) -> Column:
    """N-28: without an archive's wrapper, the scheme and a slash at the end, in lower case."""
    inner = F.regexp_replace(url, r"(?i)^https?://web\.archive\.org/web/[^/]+/", "")
    return F.lower(F.regexp_replace(F.regexp_replace(inner, r"(?i)^https?://", ""), r"/+$", ""))


def source_index(uid: Column) -> Column:
    """N-34: (split, index) of ids like set:train.json:12, null of others."""
    found = F.regexp_extract(uid, r"^[a-z0-9_]+:(train|dev)\.json:(\d+)$", 1)
    return F.when(found != "", F.struct(found.alias("split"), F.regexp_extract(uid, r":(\d+)$", 1).cast("bigint").alias("at")))
