"""Devanagari and Gurmukhi to Latin letters and back, and language decisions (N-22 to N-26).

What goes word by word through a table of letters runs in Arrow batches on distinct words; lexicons are joins.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veristrata.functions.text import SCRIPTS, dominant_script, script_count

# fixed values: Devanagari letters and how they are typed; Gurmukhi letters stand 256 code points behind theirs
CONSONANTS = dict(zip(
    "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल ळ व श ष स ह".split(),
    "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split(),
))
VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऑ ऍ".split(), "a aa i ee u oo ri e ai o au o e".split()))
SIGNS = dict(zip("ा ि ी ु ू ृ े ै ो ौ ॉ ॅ".split(), "aa i ee u oo ri e ai o au o e".split()))
DOTTED_DEVA = dict(zip("क ख ग ज ड ढ फ".split(), "q kh g z r rh f".split()))
DOTTED_GURU = dict(zip("ਸ ਖ ਗ ਜ ਫ ਲ".split(), "sh kh g z f l".split()))
GURU_ONLY = {"ੜ": "r"}
GURU_BEARERS = {"ੲ": "i", "ੳ": "u"}
NASALS, VISARGA, KILLERS, DOTS, DOUBLER = "ंँੰਂ", "ःਃ", "्੍", "़਼", "ੱ"
SHORT_AT_END = {"aa": "a", "ee": "i", "oo": "u"}
BLOCK = 0x100


def _gurmukhi(letters: dict[str, str]) -> dict[str, str]:
    return {chr(ord(k) + BLOCK): v for k, v in letters.items()}


ONSETS = {**CONSONANTS, **_gurmukhi(CONSONANTS), **GURU_ONLY}
DOTTED = {**DOTTED_DEVA, **DOTTED_GURU}
OPEN = {**VOWELS, **_gurmukhi(VOWELS), **GURU_BEARERS}
MARKS = {**SIGNS, **_gurmukhi(SIGNS)}
#: Digits of both blocks and the two ends of sentences, as `translate` wants them.
PLAIN_FROM = "".join(chr(0x966 + i) for i in range(10)) + "".join(chr(0xA66 + i) for i in range(10)) + "।॥"
PLAIN_TO = "0123456789" * 2 + ".."


def spelled(word: str) -> str:
    """A word of Indic letters as it is typed in Latin ones; never empty for a word that is not.

    The word is read as syllables (onset, vowel, end); `None` is the vowel that every bare consonant carries, and the
    rules of speech decide where it is silent: at the end of a word unless a cluster stands before it, and, from the
    right, between a spoken syllable and one that begins with a consonant and is spoken.
    """
    syllables: list[list] = []
    doubled = False
    for ch in unicodedata.normalize("NFC", word):
        last = syllables[-1] if syllables else None
        if ch in ONSETS:
            syllables.append([ONSETS[ch][0] + ONSETS[ch] if doubled else ONSETS[ch], None, "", ch])
            doubled = False
        elif ch in DOTS:
            if last and last[3] in DOTTED and last[1] is None and not last[2]:
                double = len(last[0]) > len(ONSETS[last[3]])
                sound = DOTTED[last[3]]
                last[0] = sound[0] + sound if double else sound
        elif ch in KILLERS:
            if last and last[1] is None and last[3] and not last[2]:
                last[1] = ""
        elif ch in MARKS and last and last[1] is None and last[3] and not last[2]:
            last[1] = MARKS[ch]
        elif ch in OPEN or ch in MARKS:
            syllables.append(["", OPEN.get(ch) or MARKS[ch], "", ""])
        elif ch in NASALS or ch in VISARGA:
            if last:
                last[2] += "n" if ch in NASALS else "h"
            elif ch in NASALS:
                syllables.append(["", "", "n", ""])
        elif ch == DOUBLER:
            doubled = True
        else:
            at = PLAIN_FROM.find(ch)
            syllables.append([PLAIN_TO[at] if at >= 0 else ch, "", "", ""])
    count = len(syllables)
    silent = set()
    if count > 1 and syllables[-1][1] is None and syllables[-2][1] != "":
        silent.add(count - 1)
    for i in range(count - 2, 0, -1):
        before, here, behind = syllables[i - 1 : i + 2]
        spoken = behind[1] != "" and i + 1 not in silent
        if here[1] is None and not here[2] and before[1] != "" and behind[0] and spoken:
            silent.add(i)
    out = []
    for i, (onset, vowel, end, _) in enumerate(syllables):
        sound = "" if i in silent else "a" if vowel is None else vowel
        if i == count - 1 and not end:
            sound = SHORT_AT_END.get(sound, sound)
        out.append(onset + sound + end)
    return "".join(out) or word


# fixed values: the ITRANS scheme
ITRANS_CONSONANTS = dict(zip(
    "k kh g gh ~N ch Ch chh j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l L v w sh Sh s h q z f".split(),
    "क ख ग घ ङ च छ छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल ळ व व श ष स ह क़ ज़ फ़".split(),
))
ITRANS_VOWELS = dict(zip("a aa A i ii I u uu U e ai o au".split(), "अ आ आ इ ई ई उ ऊ ऊ ए ऐ ओ औ".split()))
ITRANS_SIGNS = dict(zip("a aa A i ii I u uu U e ai o au".split(), ["", *"ा ा ि ी ी ु ू ू े ै ो ौ".split()]))
VIRAMA = "्"


def native(word: str, gurmukhi: bool) -> str:
    """A word in the ITRANS scheme as Devanagari, or as Gurmukhi one block behind it; other characters stay."""
    out, at, bare = [], 0, False
    while at < len(word):
        for size in (3, 2, 1):
            part = word[at : at + size]
            if len(part) == size and (part in ITRANS_CONSONANTS or part in ITRANS_VOWELS):
                break
        else:
            part = word[at]
        at += len(part)
        if part in ITRANS_VOWELS:
            out.append(ITRANS_SIGNS[part] if bare else ITRANS_VOWELS[part])
            bare = False
            continue
        if bare:
            out.append(VIRAMA)
        out.append(ITRANS_CONSONANTS.get(part, part))
        bare = part in ITRANS_CONSONANTS
    text = unicodedata.normalize("NFD", "".join(out) + (VIRAMA if bare else ""))
    moved = "".join(chr(ord(c) + BLOCK) if gurmukhi and "ऀ" <= c <= "ॿ" else c for c in text)
    return unicodedata.normalize("NFC", moved)


@F.pandas_udf(StringType())
def _spelled(words: pd.Series) -> pd.Series:
    return words.map(spelled, na_action="ignore")


@F.pandas_udf(StringType())
def _native(words: pd.Series, langs: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else native(w, lang == "pa") for w, lang in zip(words, langs)], dtype=object)


def prepared(word: Column) -> Column:
    """An informally typed word as ITRANS reads it: doubled vowels are long, so is a last one behind a consonant; a last
    consonant gets its vowel."""
    w = F.lower(word)
    for a, b in (("aa", "A"), ("ii", "I"), ("ee", "I"), ("oo", "U"), ("uu", "U"), ("ck", "k"), ("ph", "f")):
        w = F.replace(w, F.lit(a), F.lit(b))
    for v in "aiu":
        w = F.regexp_replace(w, f"(?<=[^aeiouAIU]){v}$", v.upper())
    return F.regexp_replace(w, "([^aeiouAIU])$", "$1a")


def best_spellings(lexicon: DataFrame, backwards: bool = False) -> DataFrame:
    """(word, spelling) of a lexicon(native, roman, n): the most attested, then shortest, then first; romanisations with a
    space are left out. backwards: of each romanisation its most attested native word, then the first."""
    clean = lexicon.select("native", F.lower(F.trim("roman")).alias("roman"), F.coalesce("n", F.lit(0)).alias("n")).filter("roman <> '' AND NOT contains(roman, ' ')")
    if backwards:
        return clean.groupBy(F.col("roman").alias("word")).agg(F.min_by("native", F.struct((-F.col("n")).alias("n"), "native")).alias("spelling"))
    return clean.groupBy(F.col("native").alias("word")).agg(F.min_by("roman", F.struct((-F.col("n")).alias("n"), F.length("roman").alias("m"), "roman")).alias("spelling"))


def _with_spellings(words: DataFrame, lexicon: DataFrame | None, backwards: bool) -> DataFrame:
    if lexicon is None:
        return words.withColumn("spelling", F.lit(None).cast("string"))
    return words.join(best_spellings(lexicon, backwards), "word", "left")


def _rejoined(parts: DataFrame, key: str, keys: DataFrame, glue: str) -> DataFrame:
    """Parts of a text (pos, part) in order; a text without any is empty. One group is one text."""
    whole = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), glue).alias("out"))
    return keys.select(key).join(whole, key, "left").select(key, F.coalesce("out", F.lit("")).alias("out"))


def romanised(texts: DataFrame, key: str, text: str, lexicon: DataFrame | None = None) -> DataFrame:
    """N-25: (key, out): each token in Latin letters, one token for one, joined by single spaces. key is unique in texts.

    Punctuation around a word stays, sentence ends and digits become plain; the word is looked up in the lexicon, else
    spelled by rule. Distinct words are spelled once. Tokens without Indic letters only change digits and ends; a null
    text is empty.
    """
    token = F.posexplode(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")).alias("pos", "token")
    parts = texts.select(key, token)
    pattern = r"^([\p{P}\p{S}]*)(.*?)([\p{P}\p{S}]*)$"
    indic = rf"[\x{{0900}}-\x{{097F}}\x{{0A00}}-\x{{0A7F}}]"
    cut = {n: F.regexp_extract("token", pattern, i) for i, n in enumerate(("lead", "word", "trail"), 1)}
    parts = parts.withColumns(cut).withColumn("word", F.when(F.col("word").rlike(indic), F.col("word")))
    words = parts.select("word").filter("word IS NOT NULL").distinct()
    known = _with_spellings(words, lexicon, False).select("word", F.coalesce("spelling", _spelled("word")).alias("spelling"))
    plain = lambda c: F.translate(c, PLAIN_FROM, PLAIN_TO)
    part = F.when(F.col("word").isNull(), plain("token")).otherwise(F.concat(plain("lead"), "spelling", plain("trail")))
    return _rejoined(parts.join(known, "word", "left").select(key, "pos", part.alias("part")), key, texts, " ")


def to_native(texts: DataFrame, key: str, text: str, lang: str, lexicon: DataFrame | None = None) -> DataFrame:
    """N-26: (key, out): runs of Latin letters of hi and pa texts in their own script, by the lexicon(native, roman, n) or else
    by rule; all else, and texts of other languages, as they are. key is unique in texts."""
    runs = F.posexplode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("pos", "run")
    parts = texts.select(key, F.col(lang).alias("lang"), runs)
    turned = F.col("lang").isin("hi", "pa") & F.col("run").rlike("^[A-Za-z]")
    parts = parts.withColumn("word", F.when(turned, F.lower("run")))
    words = parts.select("word", "lang").filter("word IS NOT NULL").distinct()
    known = _with_spellings(words, lexicon, True).select("word", "lang", F.coalesce("spelling", _native(prepared(F.col("word")), F.col("lang"))).alias("spelling"))
    joined = parts.join(known, ["word", "lang"], "left").select(key, "pos", F.coalesce("spelling", "run").alias("part"))
    return _rejoined(joined, key, texts, "")


#: Limits of the language decision (fixed values).
FLOOR, OTHER_FLOOR, ROMAN_FLOOR, LEAST_LETTERS = 0.30, 0.50, 0.40, 3
KNOWN = ("en", "hi", "pa")


def script_language(text: Column) -> Column:
    """N-22."""
    s = dominant_script(text)
    return F.when(s == "deva", "hi").when(s == "guru", "pa").otherwise("en")


def language(text: Column, top: Column, p: Column, roman: Column | None = None, roman_p: Column | None = None) -> Column:
    """N-23: struct(lang, confidence) from a scorer's best label and, behind it, a scorer of romanised text.

    Blank texts and such with fewer than three letters are other with 0; an Indic script decides alone. Without a second
    scorer the first one's label counts if it is known and over FLOOR. With one, a confident unknown label is other, and
    the second decides the rest.
    """
    letters = sum((script_count(text, s) for s in SCRIPTS), F.lit(0))
    made = lambda lang, c: F.struct(lang.alias("lang"), c.cast("double").alias("confidence"))
    known = top.isin(*KNOWN)
    first = made(F.when(known & (p >= FLOOR), top).otherwise("other"), F.coalesce(p, F.lit(0.0)))
    if roman is None:
        judged = first
    else:
        second = made(F.when(roman_p >= ROMAN_FLOOR, roman).otherwise("other"), F.coalesce(roman_p, F.lit(0.0)))
        judged = F.when(~known & (p >= OTHER_FLOOR), made(F.lit("other"), p)).otherwise(second)
    script = dominant_script(text)
    blank = F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")
    return F.when(blank, made(F.lit("other"), F.lit(0.0))).when(script.isin("deva", "guru"), made(script_language(text), F.lit(1.0))).when(letters < LEAST_LETTERS, made(F.lit("other"), F.lit(0.0))).otherwise(judged)


NATIVE_SCRIPT = {"hi": "deva", "pa": "guru"}


def preprocessed(texts: DataFrame, key: str, text: str, lang: str, lexicon: DataFrame | None = None) -> DataFrame:
    """N-24: (key, lang, script, transliterated): only hi and pa texts in another script are turned; an unchanged result
    counts as none. A null lang (its scorer failed) is the script's."""
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(key, clean.alias("t"), F.coalesce(lang, script_language(clean)).alias("lang"), dominant_script(clean).alias("script"))
    own = F.when(F.col("lang") == "hi", "deva").when(F.col("lang") == "pa", "guru")
    turned = to_native(rows.filter(own != F.col("script")), key, "t", "lang", lexicon)
    return rows.join(turned, key, "left").select(key, "lang", "script", F.when(F.col("out") != F.col("t"), F.col("out")).alias("transliterated"))
