"""Text scalars as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges of the scripts (fixed values).
SCRIPTS = {"deva": r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", "guru": r"\x{0A00}-\x{0A7F}", "latn": r"A-Za-z\x{00C0}-\x{024F}"}
#: Letters, digits and underscore, without marks: what the tokenizer of the index calls a word.
WORD = r"[\p{L}\p{N}_]+"
URL = r"https?://\S+|www\.\S+"
INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


def tokens(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normalised(text: Column) -> Column:
    """For hashing: no invisibles, links or emoji, lower case, single spaces."""
    t = F.regexp_replace(text, INVISIBLE, "")
    t = F.regexp_replace(F.regexp_replace(t, URL, " "), EMOJI, " ")
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-grams of a text; a shorter text is its own; none of an empty one."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(text)).otherwise(F.array_distinct(grams))


def script_count(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]", ""))


def dominant_script(text: Column) -> Column:
    """deva, guru or latn by most characters, ties in this order; latn below three."""
    d, g, x = (script_count(text, s) for s in SCRIPTS)
    return F.when(d + g + x < 3, "latn").when((d >= g) & (d >= x), "deva").when(g >= x, "guru").otherwise("latn")


def script_purity(text: Column) -> Column:
    d, g, x = (script_count(text, s) for s in SCRIPTS)
    return F.when(d + g + x == 0, 0.0).otherwise(F.greatest(d, g, x) / (d + g + x))


def publisher(url: Column) -> Column:
    """The host of a URL, lower case, without www."""
    host = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"[/?#].*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def redacted_keys(url: Column) -> Column:
    return F.regexp_replace(url, r"([?&](?:key|api_key)=)[^&]*", "$1***")


def fold(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """A fold by the first 64 bits of a SHA-256, the same everywhere."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % folds).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
