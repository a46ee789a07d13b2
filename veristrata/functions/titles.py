"""Whether a page's title is about a claim, and what to search for a claim (N-46, N-47, N-62), as Catalyst expressions.

A claim comes as `forms`, an array of its texts: as typed, in its native script, in English.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions.claims import STOPWORDS, content_terms

# fixed values
GENERIC = ("a", "an", "the", "of", "in", "and", "on", "at", "to", "for", "by", "or", "list", "river", "city", "district", "state", "town", "article", "disambiguation")
JOINERS = ("of", "the", "and", "for", "de")
NO_NAME = (
    *STOPWORDS, "if", "since", "when", "now", "all", "any", "yes", "ok", "pls", "plz", "fake", "true", "false", "note", "alert", "urgent", "new",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
SEARCHED = ("hi", "pa")
LEAST_SKELETON, LEAST_STEM, MOST_TERMS = 3, 4, 8
ACRONYM, NAME = r"^[A-Z]{3,6}$", r"^[A-Z][\p{L}\p{N}_'’-]*$"


def ascii_only(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def skeleton(word: Column) -> Column:
    """A word's consonants, doubled ones once; a word of vowels is its own."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(word), "[aeiouy]", ""), r"(.)\1+", "$1")
    return F.when(bare == "", F.lower(word)).otherwise(bare)


def same_word(a: Column, b: Column) -> Column:
    """Equal words, or one skeleton of three letters begins the other."""
    begins = lambda x, y: F.startswith(y, x) & (F.length(x) >= LEAST_SKELETON)
    return (a == b) | begins(skeleton(a), skeleton(b)) | begins(skeleton(b), skeleton(a))


def same_stem(a: Column, b: Column) -> Column:
    """The same word, or a word of four letters that begins the other."""
    begins = lambda x, y: F.startswith(y, x) & (F.length(x) >= LEAST_STEM)
    return same_word(a, b) | begins(a, b) | begins(b, a)


def title_words(title: Column) -> Column:
    plain = F.lower(F.regexp_replace(title, r"\([^)]*\)", " "))
    return F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*GENERIC))


def claim_words(forms: Column) -> Column:
    plain = F.transform(F.filter(forms, ascii_only), lambda f: F.regexp_extract_all(F.lower(f), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_distinct(F.flatten(plain))


def _hits(title: Column, forms: Column, same) -> Column:
    return F.transform(title_words(title), lambda w: F.exists(claim_words(forms), lambda c: same(w, c)))


def _all(hits: Column) -> Column:
    return (F.size(hits) > 0) & F.forall(hits, lambda h: h)


def grounded(title: Column, forms: Column) -> Column:
    """N-46: every content word of the title stands in a Latin form of the claim."""
    return _all(_hits(title, forms, same_word))


def grounded_by_stem(title: Column, forms: Column) -> Column:
    return _all(_hits(title, forms, same_stem))


def grounded_mostly(title: Column, forms: Column) -> Column:
    """Two thirds of the words, the first among them."""
    h = _hits(title, forms, same_stem)
    share = F.size(F.filter(h, lambda x: x)) / F.size(h)
    return (F.size(h) > 0) & (((share >= 2 / 3) & F.get(h, F.lit(0))) | F.forall(h, lambda x: x))


def grounded_or_acronym(title: Column, forms: Column) -> Column:
    """By stem, or the claim holds the initials of the title's words (of, the, and, for, in left out)."""
    parts = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin("of", "the", "and", "for", "in"))
    initials = F.array_join(F.transform(parts, lambda w: F.left(w, F.lit(1))), "")
    return grounded_by_stem(title, forms) | ((F.size(parts) >= 2) & F.array_contains(claim_words(forms), initials))


def queries(forms: Column, lang: Column) -> Column:
    """N-47: struct(lang, query) of each form: its first eight content terms, any of them; a form not in ASCII asks its own language."""
    own = F.when(lang.isin(*SEARCHED), lang).otherwise("en")
    asked = F.transform(forms, lambda f: F.struct(F.when(ascii_only(f), "en").otherwise(own).alias("lang"), F.array_join(F.slice(content_terms(f), 1, MOST_TERMS), " OR ").alias("query")))
    return F.array_distinct(F.filter(asked, lambda q: q["query"] != ""))


def acronyms(forms: Column, most: int = 3) -> Column:
    """Words of three to six capitals of all forms, in order of first appearance."""
    found = F.flatten(F.transform(forms, lambda f: F.regexp_extract_all(f, F.lit("[A-Za-z]+"), F.lit(0))))
    return F.slice(F.array_distinct(F.filter(found, lambda w: w.rlike(ACRONYM) & ~F.lower(w).isin(*NO_NAME))), 1, most)


def names(text: Column, most: int = 2) -> Column:
    """Runs of capitalised words, joined by of, the, and, for, de in front of another; longest first.

    Each word is marked: 1 opens or goes on with a run, 2 goes on only, 3 ends it. The runs are then one pattern.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'’-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"['’]s$", ""))

    def marks(all_words):
        def mark(w, i):
            name = w.rlike(NAME) & ~w.rlike(ACRONYM) & ~F.lower(w).isin(*NO_NAME)
            joins = F.lower(w).isin(*JOINERS) & F.coalesce(F.get(all_words, i + 1).rlike(NAME), F.lit(False))
            return F.when(name, F.concat(F.lit("\x01"), w)).when(joins, F.concat(F.lit("\x02"), w)).otherwise(F.lit("\x03"))

        return F.array_join(F.transform(all_words, mark), " ")

    marked = F.get(F.transform(F.array(tokens), marks), F.lit(0))
    runs = F.transform(F.regexp_extract_all(marked, F.lit("\x01[^ ]+(?: [\x01\x02][^ ]+)*"), F.lit(0)), lambda r: F.regexp_replace(r, "[\x01\x02]", ""))
    ranked = F.array_sort(F.transform(F.filter(runs, lambda r: F.length(r) >= 4), lambda r, i: F.struct((-F.length(r)).alias("o"), i.alias("i"), r.alias("r"))))

    def first_of_each(rows):
        low = F.transform(rows, lambda x: F.lower(x["r"]))
        return F.transform(F.filter(rows, lambda x, i: F.array_position(low, F.lower(x["r"])) == i + 1), lambda x: x["r"])

    return F.slice(F.get(F.transform(F.array(ranked), first_of_each), F.lit(0)), 1, most)


def deeper_queries(forms: Column, lang: Column) -> Column:
    """N-47, second version: queries(), the names of the last Latin form in quotes, and each acronym."""
    latin = F.filter(forms, ascii_only)
    english = lambda q: F.struct(F.lit("en").alias("lang"), q.alias("query"))
    quoted = F.array_join(F.transform(names(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), latin), -1), F.lit(""))), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " ")
    more = F.concat(F.array(english(quoted)), F.transform(acronyms(latin), english))
    return F.array_distinct(F.filter(F.concat(queries(forms, lang), more), lambda q: q["query"] != ""))
