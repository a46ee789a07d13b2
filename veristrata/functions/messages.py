"""Pressure techniques and hoax cues of a message (N-48, N-49)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions.text import tokens

# fixed values: words of each technique and cue
TECHNIQUES = {
    "Appeal_to_Time": (
        "urgent", "immediately", "right now", "hurry", "asap", "last date", "today only", "before it is deleted", "before it's deleted", "before it gets deleted",
        "turant", "jaldi", "jaldi se", "abhi ke abhi", "aaj hi", "hune", "ajj hi",
        "तुरंत", "जल्दी", "आज ही", "अभी के अभी", "डिलीट होने से पहले", "ਤੁਰੰਤ", "ਜਲਦੀ", "ਹੁਣੇ", "ਅੱਜ ਹੀ",
    ),
    "Appeal_to_Authority": (
        "doctors say", "doctors have", "scientists say", "research shows", "study shows", "experts say", "nasa", "unesco", "aiims", "harvard",
        "doctor ne", "doctors ne", "vaigyanik", "scientist ne",
        "डॉक्टरों", "डॉक्टर ने", "वैज्ञानिक", "विशेषज्ञ", "ਡਾਕਟਰਾਂ", "ਡਾਕਟਰ ਨੇ", "ਵਿਗਿਆਨੀ", "ਮਾਹਿਰ",
    ),
    "Appeal_to_Popularity": (
        "everyone knows", "everybody knows", "everyone is", "millions of people",
        "sab log", "sabhi log", "saare log", "sare log", "sab jaante", "sab jante",
        "सब लोग", "सभी लोग", "सब जानते", "ਸਾਰੇ ਲੋਕ", "ਸਭ ਲੋਕ", "ਸਾਰੇ ਜਾਣਦੇ",
    ),
    "Loaded_Language": (
        "shocking", "dangerous", "deadly", "breaking", "beware", "alert",
        "khatarnak", "khatarnaak", "savdhan", "saavdhan", "sawdhan",
        "खतरनाक", "सावधान", "चौंकाने", "ਖ਼ਤਰਨਾਕ", "ਖਤਰਨਾਕ", "ਸਾਵਧਾਨ",
    ),
}
ACRONYMS = ("WHO", "ICMR")
ALARM = r"[\x{1F6A8}⚠‼❗\x{1F534}\x{1F631}]|!{2,}"
ORDER = ("Appeal_to_Fear-Prejudice", "Appeal_to_Time", "Loaded_Language", "Exaggeration-Minimisation", "Appeal_to_Authority", "Appeal_to_Popularity", "Repetition")
MOST = 3
CURE = (
    "cure", "cures", "cured", "curing", "kill", "kills", "killing", "prevent", "prevents", "heal", "heals", "theek ho", "theek kar", "theek hota", "theek ho jata",
    "ilaaj", "ilaj", "khatam", "khatm", "ठीक", "इलाज", "खत्म", "ਠੀਕ", "ਇਲਾਜ", "ਖਤਮ", "ਖ਼ਤਮ",
)
HEALTH = (
    "cancer", "covid", "corona", "coronavirus", "virus", "diabetes", "sugar", "tumor", "tumour", "hiv", "aids", "asthma", "cough", "fever", "malaria", "dengue", "jaundice",
    "blood pressure", "kidney", "disease", "कैंसर", "कोरोना", "शुगर", "मधुमेह", "बीमारी", "ਕੈਂਸਰ", "ਕੋਰੋਨਾ", "ਸ਼ੂਗਰ", "ਬਿਮਾਰੀ",
)
CONCEAL = (
    "don't reveal", "do not reveal", "don't want you to know", "do not want you to know", "hiding this", "hide this", "hidden from", "cover up", "covering up",
    "don't tell you", "not telling you", "big pharma", "chhupate", "chhupa", "chupate", "chupa rahe", "छुपा", "छिपा", "ਲੁਕਾ", "ਛੁਪਾ",
)
FREE = ("free", "muft", "मुफ़्त", "मुफ्त", "ਮੁਫ਼ਤ", "ਮੁਫਤ")
GIVEAWAY = ("laptop", "phone", "recharge", "ration", "tractor", "cylinder", "rupees", "gift", "data", "internet", "scholarship", "money", "₹", "रुपये", "ਰੁਪਏ")
DEADLINE = ("from tomorrow", "from next month", "from midnight", "kal se", "agle mahine se", "कल से", "अगले महीने से", "ਕੱਲ੍ਹ ਤੋਂ", "ਕੱਲ ਤੋਂ")
THREAT = (
    "will start charging", "will be charged", "will charge you", "paise lagenge", "charge lagega", "paisa lagega", "will be blocked", "will be banned", "will be cancelled",
    "will be canceled", "will be closed", "will be deleted", "will be stopped", "will be shut", "band ho jayega", "band ho jaayega", "band ho jaega",
    "बंद हो जाएगा", "बंद हो जायेगा", "ਬੰਦ ਹੋ ਜਾਵੇਗਾ",
)
CHARGE = ("charge", "paise", "block", "ban", "band", "close")


def any_of(words) -> str:
    """A pattern of any of the words in lower-case text; ASCII words stand between other characters than a to z."""
    plain = "|".join(re.escape(w) for w in words if w.isascii())
    other = "|".join(re.escape(w) for w in words if not w.isascii())
    return "|".join(p for p in (rf"(?<![a-z])(?:{plain})(?![a-z])" if plain else "", other) if p)


def trigram_most(words: Column) -> Column:
    """How often the most frequent three words in a row stand in an array of words: sorted, equal ones are neighbours."""
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a, g):
        run = F.when((g == a["last"]) & (a["run"] > 0), a["run"] + 1).otherwise(1)
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    def most(w):
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, 0).otherwise(F.aggregate(F.array_sort(grams), start, step, lambda a: a["most"]))

    # in a lambda of their own, the words are made once
    return F.get(F.transform(F.array(words), most), F.lit(0))


def techniques(text: Column) -> Column:
    """N-48: the first MOST techniques in ORDER; none of a null or blank text."""
    low = F.lower(text)
    found = {name: low.rlike(any_of(words)) for name, words in TECHNIQUES.items()}
    found["Appeal_to_Authority"] |= text.rlike("|".join(ACRONYMS))
    found["Loaded_Language"] |= text.rlike(ALARM) | (F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z]{4,}\b"), F.lit(0))) >= 2)
    found["Repetition"] = trigram_most(tokens(text)) >= 3
    names = F.array(*(F.when(found[n], n) for n in ORDER if n in found))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_compact(names), 1, MOST))


def hoax_cues(text: Column) -> Column:
    """N-49: shapes of hoaxes, in order of name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: low.rlike(any_of(words))
    return F.array_compact(F.array(
        F.when(has(CONCEAL), "concealment"),
        F.when(has(FREE) & has(GIVEAWAY), "giveaway"),
        F.when(has(CURE) & has(HEALTH), "miracle_cure"),
        F.when(has(THREAT) | has(DEADLINE) & has(CHARGE), "threat_or_charge"),
    ))


def caution_cues(text: Column) -> Column:
    """Hoax cues and, behind `technique:`, the techniques found, all of them; sorted."""
    return F.array_sort(F.array_distinct(F.concat(hoax_cues(text), F.transform(techniques(text), lambda t: F.concat(F.lit("technique:"), t)))))
