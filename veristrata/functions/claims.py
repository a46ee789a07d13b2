"""Words, content terms, sentences, check-worthiness and claims of a message (N-15 to N-21, N-45), as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions.normalise import ODD, for_models, squeezed

# fixed values: words without content, and patterns of greetings, blessings and requests to pass a message on
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "from", "by", "is", "are", "was", "were", "be", "been", "being", "has",
    "have", "had", "it", "its", "this", "that", "these", "those", "as", "not", "no", "did", "does", "do", "will", "would", "can", "could", "should", "may", "might",
    "than", "then", "there", "their", "they", "he", "she", "his", "her", "them", "who", "what",
    "hai", "hain", "tha", "thi", "ne", "ki", "ka", "ke", "ko", "se", "mein", "me", "aur", "bhi", "ye", "yeh", "wo", "vo", "ho", "kar", "raha", "rahe", "rahi",
    "gaya", "gayi", "diya", "kiya", "kya", "nahi", "nahin", "hota", "hoti", "hote", "jata", "jati", "hunda", "hundi", "nu", "da", "di", "de", "te", "vich", "ch",
    "ate", "han", "si",
    "है", "हैं", "था", "थी", "थे", "ने", "की", "का", "के", "को", "से", "में", "और", "भी", "यह", "वह", "हो", "कर", "रहा", "रहे", "रही", "गया", "गई", "दिया", "किया",
    "क्या", "नहीं", "होता", "होती", "होते", "जाता", "जाती",
    "ਹੈ", "ਹਨ", "ਸੀ", "ਨੇ", "ਦੀ", "ਦਾ", "ਦੇ", "ਨੂੰ", "ਤੋਂ", "ਵਿੱਚ", "ਵਿਚ", "ਅਤੇ", "ਵੀ", "ਇਹ", "ਉਹ", "ਹੋ", "ਕਰ", "ਰਹੇ", "ਰਿਹਾ", "ਗਿਆ", "ਦਿੱਤਾ", "ਕੀਤਾ",
)
W = r"[\p{L}\p{N}_]"
GREETING = (
    rf"(?i)good\s+(?:morning|night|evening|day)|suprabhat|su\s?prabhat|namaste|namaskar|sat\s+sri\s+akal|jai\s+(?:hind|shree\s+ram|mata\s+di)|shubh\s+{W}+"
    rf"|happy\s+{W}+day|सुप्रभात|नमस्ते|ਸਤ ਸ੍ਰੀ ਅਕਾਲ"
)
BLESSING = (
    rf"(?i)(?:rabb|allah|bhagwan|waheguru|god|ishwar|khuda)\s+{W}*\s*(?:rakhe|kare|karen|deve|de|bless|rakkhe)|mangalmay|manokamna|khush\s+rakhe|sukhi\s+raho"
    rf"|salamat\s+raho|have\s+a\s+{W}+\s+day|stay\s+(?:blessed|positive|safe|happy)|(?:puri|poori)\s+hogi|barkat|{W}+\s+mubarak|खुश\s+रखे|मंगलमय"
)
CHAIN = (
    r"(?i)forward\s+(?:this|to|karo|kar\s+do|sabko)|share\s+(?:this|with|karo)|send\s+to\s+\d+|\d+\s+(?:logo|people|friends|dostan)\s+(?:ko|nu|to)?\s*(?:bhej|send)"
    r"|sabko\s+bhej|sareyan\s+nu\s+dass|bhejein|forward\s+many\s+times"
)
PICTURE = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
#: A word for counting: Indic signs belong to it.
RUN = r"[\p{L}\p{N}_\x{0900}-\x{097F}\x{0A00}-\x{0A7F}]+"
SENTENCE_END = r"(?U)(?<=[.!?।])\s+|\n+"
#: Fewer words than this are nothing to check; claims taken of a message; share of tagged words that makes a sentence a claim.
LEAST_WORDS, MOST_CLAIMS, KEPT_SHARE = 4, 3, 0.5
NUMBER = r"^[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+$"


def words(text: Column) -> Column:
    """N-15: lower-case words between white space, without punctuation and symbols."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", ""), f"[ {ODD}]+"), lambda w: w != "")


def content_terms(text: Column) -> Column:
    """N-16: distinct words that are no stop word, no number and, in ASCII, three letters long; sorted. None of a null text."""
    short = lambda w: ~w.rlike(r"[^\x00-\x7F]") & (F.length(w) < 3)
    kept = F.filter(words(text), lambda w: ~w.isin(*STOPWORDS) & ~w.rlike(NUMBER) & ~short(w))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def coverage(terms: Column, passage: Column) -> Column:
    """N-45: share of a claim's terms that stand in the lower-case passage; 0 without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(F.lower(passage), t))) / F.size(terms))


def sentences(text: Column) -> Column:
    """N-17: parts between sentence ends or line breaks, trimmed, none blank."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def residue(text: Column) -> Column:
    """What is left of a cleaned message without greetings, blessings, requests and pictures."""
    for pattern in (GREETING, BLESSING, CHAIN, PICTURE):
        text = F.regexp_replace(text, pattern, " ")
    return squeezed(text)


def check_worthy(text: Column) -> Column:
    """N-18: four words in the message and four in its residue. A null text is not."""
    clean = for_models(F.coalesce(text, F.lit("")))
    return (count(clean, RUN) >= LEAST_WORDS) & (count(residue(clean), RUN) >= LEAST_WORDS)


def why_not_claim(text: Column) -> Column:
    """N-19: greeting, too_short or no_content, for a message that is not check-worthy."""
    clean = for_models(F.coalesce(text, F.lit("")))
    left = residue(clean)
    return F.when(clean == "", "no_content").when((left != clean) & (count(left, RUN) <= 1), "greeting").otherwise("too_short")


def _numbered(parts: Column) -> Column:
    return F.transform(parts, lambda s, i: F.struct(s.alias("text"), i.alias("pos"), F.length(s).alias("n")))


def _spanned(clean: Column, ranked: Column) -> Column:
    """Claims with the place of their first occurrence, end exclusive."""
    at = lambda s: F.position(s, clean) - 1
    return F.transform(ranked, lambda r: F.struct(r["text"].alias("text"), at(r["text"]).alias("start"), (at(r["text"]) + F.length(r["text"])).alias("stop")))


def claims(text: Column) -> Column:
    """N-20: struct(claims, unchecked): the check-worthy sentences, longest first, the earlier of equals before; the whole
    message where none is. The first MOST_CLAIMS are claims with their spans in the cleaned message, the others only texts."""
    clean = for_models(F.coalesce(text, F.lit("")))
    good = F.filter(_numbered(sentences(clean)), lambda s: check_worthy(s["text"]))
    order = F.array_sort(F.transform(good, lambda s: F.struct((-s["n"]).alias("o"), s["pos"].alias("pos"), s["text"].alias("text"))))
    whole = F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("pos"), clean.alias("text")))
    return _split(clean, F.when(F.size(order) > 0, order).otherwise(whole))


def _split(clean: Column, ranked: Column) -> Column:
    first = _spanned(clean, F.slice(ranked, 1, MOST_CLAIMS))
    rest = F.transform(F.filter(ranked, lambda _, i: i >= MOST_CLAIMS), lambda r: r["text"])
    return F.struct(first.alias("claims"), rest.alias("unchecked"))


def sentence_shares(clean: Column, candidates: Column, tags: Column) -> Column:
    """N-21: share of each candidate's words (between white space) whose tag is not O; tags as many as the text's words.

    A word counts if it begins within the sentence. The runs of a prefix are the words that begin in it, so two counts
    of prefixes give a sentence's tags; candidates are looked for in order, each behind the one before.
    """
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<double>").alias("shares"))
    runs = lambda upto: count(F.left(clean, upto), r"(?U)\S+")

    def step(a, s):
        at = F.position(s, clean, a["cursor"])
        own = F.slice(tags, runs(at - 1) + 1, F.greatest(runs(at - 1 + F.length(s)) - runs(at - 1), F.lit(0)))
        share = F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda t: t != "O")) / F.size(own))
        found = at > 0
        return F.struct(F.when(found, at + F.length(s)).otherwise(a["cursor"]).cast("int").alias("cursor"), F.array_append(a["shares"], F.when(found, share).otherwise(0.0)).alias("shares"))

    return F.aggregate(candidates, start, step, lambda a: a["shares"])


def tagged_claims(text: Column, tags: Column) -> Column:
    """N-21: as claims(), but of several check-worthy sentences those stay that are tagged by half, by share and then length;
    where none is, the best one."""
    clean = for_models(F.coalesce(text, F.lit("")))
    good = F.filter(sentences(clean), check_worthy)
    shares = sentence_shares(clean, good, tags)
    ranked = F.array_sort(F.zip_with(good, F.zip_with(shares, F.sequence(F.lit(0), F.size(good) - 1), lambda x, i: F.struct(x.alias("share"), i.alias("pos"))),
                                     lambda s, x: F.struct((-x["share"]).alias("o"), (-F.length(s)).alias("m"), x["pos"].alias("pos"), s.alias("text"))))
    kept = F.filter(ranked, lambda r: r["o"] <= -KEPT_SHARE)
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice(ranked, 1, 1))
    return F.when(F.size(good) > 1, _split(clean, chosen)).otherwise(claims(text))
