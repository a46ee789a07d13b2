"""What is said of a claim: explanations, evidence texts, occlusion, silence and provenance (N-36, N-50, N-51, N-55, N-56, N-59 to N-61, N-64, F-05, T-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases of an explanation
VERDICT = {
    "Supported": "The evidence found supports this claim",
    "Refuted": "The evidence found contradicts this claim",
    "Conflicting": "The evidence found disagrees with itself about this claim",
    "NEI": "There is not enough evidence to judge this claim",
    "NotAClaim": "There is no checkable factual claim here",
}
STANCE = {"Supports": "supports it", "Refutes": "contradicts it", "Neutral": "is related but does not settle it"}
QA = r"(?i)\b(?:the\s+)?(?:\d+(?:st|nd|rd|th)\s+)?(?:QA\s*pairs?|Q\s*&\s*A(?:\s*pairs?)?s?|QAs?|questions?\s+and\s+answers?)\b"
ACCORDING = r"(?i)\bAccording to the evidence,?\s*"
MARKUP = r"<2[a-z]{2}>|</?s>|<pad>|<unk>"
MOST_CITED, CONTRADICTS = 3, 0.9


def mapped(value: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value), other)


def explanation(verdict: Column, passages: Column, abstained: Column) -> Column:
    """N-50: of an array of passages(title, stance), best first; the first three are cited."""
    leaning = F.when(verdict == "NEI", "not enough evidence").otherwise(F.lower(verdict))
    head = F.when(abstained, F.concat(F.lit("Not confident enough to judge this claim. Leaning: "), leaning)).otherwise(mapped(verdict, VERDICT, F.lit(VERDICT["NEI"])))
    one = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["title"], F.lit("source")), F.lit(" "), mapped(p["stance"], STANCE, F.lit(STANCE["Neutral"])))
    cited = F.array_join(F.transform(F.slice(passages, 1, MOST_CITED), one), "; ")
    none = F.coalesce(F.size(passages) <= 0, F.lit(True))
    return F.when(none, F.concat(head, F.lit(". No sources were retrieved."))).otherwise(F.concat(head, F.lit(". "), cited, F.lit(".")))


def single_spaced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def justification(text: Column) -> Column:
    """N-51: without references to question-answer pairs, the first letter a capital; a null text is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), QA, "the evidence")
    t = single_spaced(F.regexp_replace(t, ACCORDING, ""))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 2**31 - 1))


def without_markup(text: Column) -> Column:
    return single_spaced(F.regexp_replace(F.coalesce(text, F.lit("")), MARKUP, " "))


def source_text(claim: Column, verdict: Column, passages: Column) -> Column:
    """What a generator reads; empty passages keep their numbers."""
    body = F.filter(F.transform(passages, lambda p, i: F.when(p != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(p)))), lambda x: x.isNotNull())
    return F.concat(F.trim(claim), F.lit(" </s> "), verdict, F.lit(" </s> "), F.array_join(body, " "))


def evidence(question: Column, answer: Column, explained: Column) -> Column:
    """N-36: the parts that are not blank, one space between."""
    return F.concat_ws(" ", *(F.when(F.trim(c) != "", F.trim(c)) for c in (question, answer, explained)))


def pair_text(claim: Column, evidence_text: Column) -> Column:
    return F.concat(claim, F.lit("\n"), evidence_text)


def passage_text(kind: Column, title: Column, text: Column) -> Column:
    """N-55: a fact-check is read by its title, other documents by their text."""
    return F.when((kind == "factcheck") & (title != ""), title).otherwise(text)


def indexed_text(claim: Column, title: Column) -> Column:
    """N-56."""
    return F.concat_ws(" ", *(F.when(F.trim(c) != "", F.trim(c)) for c in (claim, title)))


def shared_latin(a: Column, b: Column) -> Column:
    """N-59: Jaccard of the Latin words and numbers of two texts, 0 without any."""
    of = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+|[0-9]+"), F.lit(0)))
    return F.size(F.array_intersect(of(a), of(b))) / F.greatest(F.size(F.array_union(of(a), of(b))), F.lit(1))


def occluded(text: Column) -> Column:
    """N-60: for each word between white space, the text without it."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w, i: F.array_join(F.filter(words, lambda _, j: j != i), " "))


def influences(full: Column, without: Column) -> Column:
    """How much the verdict's probability falls without each word."""
    return F.transform(without, lambda p: full - p)


def top_words(influence: Column, k: int = 3) -> Column:
    """T-04: places (from 0) of the k largest influences over 0, in reading order; the earlier of equals."""
    ranked = F.array_sort(F.filter(F.transform(influence, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda x: x["v"] < 0))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))


def bottom_words(influence: Column, k: int = 3) -> Column:
    ranked = F.array_sort(F.transform(influence, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))


def silence(failed: Column, disagree: Column, passages: Column) -> Column:
    """N-61: why nothing was shown; passages(source, stance), a null stance was not judged. The first rule that fits."""
    live = F.filter(passages, lambda p: p["source"].isin("wikipedia", "factcheck_live"))
    judged = F.filter(live, lambda p: p["stance"].isNotNull())
    return (
        F.when(failed, "INFRA").when(F.size(live) <= 0, "NO_SOURCE").when(F.size(judged) == 0, "NOT_JUDGED").when(disagree, "SOURCES_DISAGREE")
        .when(F.forall(judged, lambda p: p["stance"] == "Neutral"), "BOTH_NEI").when(F.exists(judged, lambda p: p["stance"].isin("Supports", "Refutes")), "ONE_SIDED").otherwise("OTHER")
    )


def guard_blocks(claim: Column, contradiction: Column) -> Column:
    """F-05: a match is blocked if its first sentence, no question, is contradicted by 0.9; one without text or score stands."""
    first = F.get(F.split(F.trim(claim), r"(?U)(?<=[.!?।])\s+"), F.lit(0))
    return F.coalesce((first != "") & ~F.endswith(first, F.lit("?")) & (contradiction >= CONTRADICTS), F.lit(False))


def provenance(found: Column, same: Column, config: Column, split: Column, lock: Column, hashed: Column) -> Column:
    """N-64: the first check of a result that fails; a null `hashed` is a configuration that does not load."""
    return (
        F.when(~found, "predictions-missing").when(~same, "predictions-changed").when(~config, "config-missing").when(~split, "split-changed")
        .when(~lock, "inputs-same-lock-grew").when(hashed.isNull(), "config-invalid").when(~hashed, "config-changed").otherwise("reproduces")
    )
