"""License scans: short notices found with up to a bounded share of edits.

A notice of n characters may have k edits. Split into k + 1 pieces, at least one piece of any such match is exact
(pigeonhole), so an Aho-Corasick automaton over all pieces finds every place worth a look; the regex library's
bounded-error matching then verifies the neighbourhood and reports span and edits.

Null and empty texts have no words, empty label strings and score 0. Ties between spans of a notice go to fewer
edits, then to the earlier span. Whole texts are searched; neighbourhoods that overlap are merged, and searched again
on both sides of each match. Repeated rows give one row each, extra columns are ignored, and an empty table gives an
empty result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import shared

#: Phrases whose exact places count, and their labels (fixed by the contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices as lower-case words, and the label that each adds.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under the creative commons zero", "cc0"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-nc"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-sa"),
    ("eclipse public license", "epl"),
    ("boost software license version 1 0", "bsl"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("microsoft public license", "ms-pl"),
    ("artistic license 2 0", "artistic"),
    ("sil open font license", "ofl"),
    ("open database license", "odbl"),
    ("gnu free documentation license", "gfdl"),
    ("python software foundation license", "psf"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("elastic license 2 0", "elastic"),
    ("academic free license", "afl"),
    ("university of illinois ncsa open source license", "ncsa"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd"),
    ("the above copyright notice and this permission notice shall be included in all copies", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache"),
    ("this program is free software you can redistribute it", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("all rights reserved", "reserved"),
)
#: One edit for so many characters of a notice.
PER_EDIT = 10


class Scanner:
    """The seeds and patterns of a set of (notice, label)."""

    def __init__(self, notices=NOTICES, per_edit: int = PER_EDIT):
        self.notices = [(n, label, len(n) // per_edit) for n, label in notices]
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, special_only=True)}){{e<={k}}}(?![^ ])") for n, _, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n[a:b], []).append((i, a))
        for s, at in seeds.items():
            self.seeds.add_word(s, (len(s), at))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Merged neighbourhoods in which each notice could stand."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.seeds.iter(text):
            for i, offset in at:
                n, _, k = self.notices[i]
                lo = end + 1 - size - offset - k - 1
                hi = lo + len(n) + 2 * k + 2
                own = out.setdefault(i, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        return out

    def find(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """start, end (in the words joined by single spaces), label, edits and score of every notice."""
        found = []
        for i, spans in self.windows(text).items():
            n, label, k = self.notices[i]
            for lo, hi in spans:
                # the best match of a part, then what stands before and behind it
                parts = [(max(0, lo), min(len(text), hi))]
                while parts:
                    lo, hi = parts.pop()
                    if hi - lo < len(n) - k or not (m := self.patterns[i].search(text, lo, hi)):
                        continue
                    edits = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), label, edits, 1 - edits / len(n)))
                    parts += [(lo, m.start()), (m.end(), hi)]
        return sorted(found)


def scan_licenses(docs: DataFrame, notices=NOTICES, per_edit: int = PER_EDIT) -> DataFrame:
    """Per row of docs(doc_id, text): words, exact phrases, labels, best score and the spans of the fuzzy notices."""

    def run(batches):
        scanner = Scanner(notices, per_edit)
        phrases = [(f" {p} ".encode(), label) for p, label in BASE]
        for b in shared.slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.encode().translate(shared.ALNUM_LOWER).split(None)
                line = b" ".join(words)
                places, labels = [], set()
                if b"license" in line:
                    framed = b" " + line + b" "
                    for phrase, label in phrases:
                        at = framed.find(phrase)
                        while at >= 0:
                            places.append(framed.count(b" ", 0, at))
                            labels.add(label)
                            at = framed.find(phrase, at + 1)
                spans = scanner.find(line.decode())
                rows.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[2] for s in spans})), max([1.0 if places else 0.0, *(s[4] for s in spans)]), [dict(zip(("lo", "hi", "label", "edits", "score"), s, strict=True)) for s in spans]))
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<lo:bigint,hi:bigint,label:string,edits:bigint,score:double>>"
    return docs.select("doc_id", shared.text_or_empty().alias("text")).mapInArrow(run, schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(shared.table(spark, sf_dir, "documents")).drop("spans")
