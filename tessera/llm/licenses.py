"""License scans: ordered signature rules (DataFrame functions only).

A text becomes its words, joined by single spaces. A few stems gate the scan:
every rule's matches hold one of them. For a text that passes, every rule whose
keyword occurs is matched (all matches hold it), and all places of it are
detections (word interval, label, priority, confidence).
Where intervals overlap by containment, a detection inside one of a better
priority, or inside a longer one of the same priority, is suppressed.

Rules are written as families (names of one license, its versions) times
signature forms; the form sets priority and confidence.

Defined results
- null text counts as empty: no words, empty label strings, score 0.
- all places count, in texts of any length; base phrases are never suppressed.
  Detections of a long text are compared within stretches of LONGEST words.
- repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Families: label, keyword (names that lack it are their own keyword), names, versions (none: no version; the label gets "-<version>").
FAMILIES = [
    ("mit", "mit", ["mit license", "mit licence", "expat license", "mit x11 license"], []),
    ("apache", "apache", ["apache license", "apache software license", "asl"], ["2 0", "1 1", "1 0"]),
    ("gpl", "general public", ["gnu general public license", "gnu gpl", "general public license"], ["3", "3 0", "2", "2 0", "1"]),
    ("lgpl", "general public", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"], ["3", "2 1", "2"]),
    ("agpl", "general public", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["3", "3 0", "1"]),
    ("gfdl", "documentation", ["gnu free documentation license", "free documentation license"], ["1 3", "1 2", "1 1"]),
    ("bsd-2-clause", "clause", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"], []),
    ("bsd-3-clause", "clause", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"], []),
    ("bsd-4-clause", "clause", ["bsd 4 clause license", "4 clause bsd license", "original bsd license"], []),
    ("bsd", "bsd", ["bsd license", "bsd style license", "bsd licence"], []),
    ("isc", "isc", ["isc license", "isc licence"], []),
    ("mpl", "mozilla", ["mozilla public license", "mozilla public licence"], ["2 0", "1 1", "1 0"]),
    ("epl", "eclipse", ["eclipse public license", "eclipse public licence"], ["2 0", "1 0"]),
    ("edl", "eclipse", ["eclipse distribution license"], ["1 0"]),
    ("cddl", "common development", ["common development and distribution license"], ["1 1", "1 0"]),
    ("cpl", "common public", ["common public license"], ["1 0"]),
    ("eupl", "european union", ["european union public licence", "european union public license"], ["1 2", "1 1"]),
    ("artistic", "artistic", ["artistic license", "perl artistic license"], ["2 0", "1 0"]),
    ("bsl", "boost", ["boost software license"], ["1 0"]),
    ("busl", "business source", ["business source license"], ["1 1"]),
    ("sspl", "server side", ["server side public license"], ["1"]),
    ("elastic", "elastic", ["elastic license"], ["2 0"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], []),
    ("unlicense", "unlicense", ["the unlicense"], []),
    ("wtfpl", "do what the", ["do what the fuck you want to public license"], ["2"]),
    ("ofl", "open font", ["sil open font license", "open font license"], ["1 1", "1 0"]),
    ("odbl", "open database", ["open database license", "open data commons open database license"], ["1 0"]),
    ("odc-by", "open data", ["open data commons attribution license"], ["1 0"]),
    ("pddl", "public domain", ["public domain dedication and license"], ["1 0"]),
    ("python", "python", ["python software foundation license", "psf license"], ["2", "2 0"]),
    ("php", "php", ["php license"], ["3 01", "3 0"]),
    ("ruby", "ruby", ["ruby license"], []),
    ("openssl", "openssl", ["openssl license"], []),
    ("postgresql", "postgresql", ["postgresql license", "postgresql licence"], []),
    ("ms-pl", "microsoft", ["microsoft public license"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], []),
    ("cecill", "cecill", ["cecill license", "licence cecill"], ["2 1", "2 0"]),
    ("osl", "open software", ["open software license"], ["3 0", "2 1"]),
    ("afl", "academic free", ["academic free license"], ["3 0", "2 1"]),
    ("upl", "universal permissive", ["universal permissive license"], ["1 0"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"], []),
    ("vim", "vim", ["vim license"], []),
    ("x11", "x11", ["x11 license"], []),
    ("blueoak", "blue oak", ["blue oak model license"], ["1 0 0"]),
    ("llama-community", "community license", ["llama 2 community license", "llama 3 community license"], []),
    ("openrail", "openrail", ["openrail license", "openrail m license", "bigcode openrail m"], []),
    ("proprietary", "proprietary", ["proprietary license", "commercial license agreement"], []),
]
# Creative Commons: elements in words -> label, and the versions printed after them.
CC = {
    "by": "cc-by", "by sa": "cc-by-sa", "by nc": "cc-by-nc", "by nd": "cc-by-nd", "by nc sa": "cc-by-nc-sa", "by nc nd": "cc-by-nc-nd",
}
CC_LONG = {
    "attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd",
    "attribution noncommercial sharealike": "cc-by-nc-sa", "attribution noncommercial noderivatives": "cc-by-nc-nd",
}
CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0"]
NOTICE = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available) under (?:the )?(?:terms of (?:the )?|conditions of (?:the )?)?"
# Texts of licenses and other signatures: label, keyword, pattern, confidence.
CLAUSES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.98),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0.97),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty in no event", 0.9),
    ("gpl", "free software", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.98),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license", 0.9),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 0.98),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.8),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.85),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v?1 0)?", 0.9),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 0.5),
    ("mit", "this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("x11", "except as contained in this notice", r"except as contained in this notice the name of the", 0.9),
    ("bsd-3-clause", "nor the names of its contributors", r"nor the names of its contributors may be used to endorse or promote products derived from this software", 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd", "reproduce the above copyright", r"redistributions in binary form must reproduce the above copyright notice", 0.85),
    ("boost-1.0", "accompanying documentation covered", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.97),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("apache-2.0", "apache org licenses", r"(?:www )?apache org licenses license 2 0(?: (?:txt|html))?", 0.97),
    ("apache", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.9),
    ("gpl-3", "gnu org licenses", r"(?:www )?gnu org licenses gpl 3 0(?: (?:txt|html|en html))?", 0.95),
    ("gpl-2", "gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: (?:txt|html|en html))?", 0.95),
    ("lgpl-3", "gnu org licenses", r"(?:www )?gnu org licenses lgpl 3 0(?: (?:txt|html|en html))?", 0.95),
    ("lgpl-2.1", "gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: (?:txt|html|en html))?", 0.95),
    ("agpl-3", "gnu org licenses", r"(?:www )?gnu org licenses agpl 3 0(?: (?:txt|html|en html))?", 0.95),
    ("gpl", "hope that it will be useful", r"in the hope that it will be useful but without any warranty without even the implied warranty of", 0.7),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license", 0.95),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("mpl-1.1", "mozilla org mpl", r"(?:www )?mozilla org mpl mpl 1 1(?: (?:txt|html))?", 0.95),
    ("mpl-2.0", "mozilla org", r"(?:www )?mozilla org (?:en us )?mpl 2 0", 0.95),
    ("epl-1.0", "eclipse org legal", r"(?:www )?eclipse org legal epl v10(?: html)?", 0.95),
    ("epl-2.0", "eclipse org legal", r"(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?", 0.95),
    ("cddl-1.0", "opensource org licenses", r"(?:www )?opensource org licenses cddl 1(?: 0)?", 0.95),
    ("mit", "opensource org licenses", r"(?:www )?opensource org licenses mit(?: license(?: php)?)?", 0.95),
    ("bsd-3-clause", "opensource org licenses", r"(?:www )?opensource org licenses bsd 3 clause", 0.95),
    ("bsd-2-clause", "opensource org licenses", r"(?:www )?opensource org licenses bsd 2 clause", 0.95),
    ("isc", "opensource org licenses", r"(?:www )?opensource org licenses isc", 0.95),
    ("cc0-1.0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0", 0.97),
    ("public-domain", "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0", 0.95),
    ("unlicense", "unlicense org", r"(?:please refer to (?:http|https) )?unlicense org", 0.95),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 0.95),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl", 0.95),
    ("ofl", "reserved font name", r"with reserved font name", 0.8),
    ("odbl-1.0", "opendatacommons org", r"opendatacommons org licenses odbl 1 0", 0.95),
    ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by 1 0", 0.95),
    ("pddl-1.0", "opendatacommons org", r"opendatacommons org licenses pddl 1 0", 0.95),
    ("beerware", "beer", r"(?:the )?beer ?ware license(?: revision 42)?", 0.95),
    ("json", "good not evil", r"the software shall be used for good not evil", 0.97),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0.95),
    ("php-3.01", "php net license", r"(?:www )?php net license 3 01(?: txt)?", 0.95),
    ("artistic-2.0", "perlfoundation", r"(?:www )?perlfoundation org artistic license 2 0", 0.95),
    ("us-government-work", "government", r"(?:a )?work of the (?:u s|us|united states) government", 0.8),
    ("proprietary", "confidential and proprietary", r"(?:this (?:document|file|software) is )?confidential and proprietary", 0.7),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited", 0.9),
    ("non-commercial", "commercial use", r"(?:for )?non commercial use only", 0.7),
    ("no-derivatives", "derivative works", r"no derivative works (?:are )?(?:allowed|permitted)", 0.7),
]
LONGEST = 64  # words of a detection, at most
FEW = 200  # detections that are compared each with each


def _groups() -> list[tuple[str, str, list[str], list[str]]]:
    """The families by keyword: every name of a group holds its keyword."""
    out = []
    for label, keyword, names, versions in FAMILIES:
        own = [n for n in names if keyword in n]
        out += [(label, keyword, own, versions)] if own else []
        out += [(label, n, [n], versions) for n in names if keyword not in n]
    return out


def stems() -> list[str]:
    """Whatever a rule matches holds one of these: "licen" where it must, else its keyword."""
    held = {"spdx", *BASE, *(keyword for _, keyword, _, _ in CLAUSES), *(f"cc {x}" for x in CC), *(f"creative commons {x}" for x in CC_LONG)}
    held |= {"licen" if all("licen" in n for n in names) else keyword for _, keyword, names, _ in _groups()}
    held = {"licen" if "licen" in x else x for x in held}
    return sorted(x for x in held if not any(y != x and y in x for y in held))


def rules() -> list[tuple[int, str, str, str, float, bool]]:
    """Ordered: (priority, label, keyword, pattern, confidence, base). Lower priorities win."""
    out = [(0, label, phrase, phrase, 1.0, True) for phrase, label in BASE.items()]
    spdx = "spdx licen[sc]e identifier "
    for label, _, _, versions in FAMILIES:
        for v in versions:
            out.append((1, f"{label}-{v.replace(' ', '.')}", "spdx", spdx + rf"{label.replace('-', ' ')} {v}(?: only| or later)?", 1.0, False))
        if not versions:
            out.append((1, label, "spdx", spdx + label.replace("-", " "), 1.0, False))
    for label, keyword, names, versions in _groups():
        name = "(?:" + "|".join(names) + ")"
        for v in versions:
            tagged = f"{label}-{v.replace(' ', '.')}"
            tail = rf"(?: v(?:ersion)?)? ?v?{v}(?: or (?:any )?later(?: version)?)?"
            end = "" if " " in v else r"(?! \d)"
            out.append((2, tagged, keyword, NOTICE + name + tail + end, 0.97, False))
            out.append((3, tagged, keyword, name + tail + end, 0.85, False))
        out.append((4, label, keyword, NOTICE + name, 0.9, False))
        out.append((5, label, keyword, name, 0.7, False))
    for forms, lead in ((CC, "cc "), (CC_LONG, "creative commons ")):
        for words, label in forms.items():
            for v in CC_VERSIONS:
                tail = f" {v}" if forms is CC else f"(?: license)? {v}"
                out.append((2, f"{label}-{v.replace(' ', '.')}", lead + words, lead + words + tail, 0.97, False))
                if forms is CC:
                    out.append((2, f"{label}-{v.replace(' ', '.')}", "creativecommons org licenses", f"creativecommons org licenses {words} {v}", 0.98, False))
            out.append((5, label, lead + words, lead + words, 0.75, False))
    out += [(2, label, keyword, pattern, conf, False) for label, keyword, pattern, conf in CLAUSES]
    return out


def normal(text: Column) -> Column:
    """' w0 w1 ... ' : the words, with a space before, between and after; one space for no words."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), NOT_WORD, " ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(norm: Column, rule: Column) -> Column:
    """All detections of a rule: word intervals [start, end). The matches are marked in the text, which is then cut into words; no word holds a mark."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )")), F.lit("\x01$0\x02"))

    def at(words: Column, is_end: bool) -> Column:
        hit = (lambda w: F.endswith(w, F.lit("\x02"))) if is_end else (lambda w: F.startswith(w, F.lit("\x01")))
        return F.filter(F.transform(words, lambda w, i: F.when(hit(w), i if is_end else i - 1)), lambda x: x.isNotNull())

    def placed(text: Column) -> Column:
        both = F.transform(F.array(F.split(text, " ", -1)), lambda words: F.arrays_zip(at(words, False).alias("start"), at(words, True).alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.when(F.contains(text, F.lit("\x01")), F.element_at(both, 1)).otherwise(none)

    return F.transform(
        F.element_at(F.transform(F.array(marked), placed), 1),
        lambda p: F.struct(
            rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"), p["start"].alias("start"), p["end"].alias("end"),
        ),
    )


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds norm, all detections as found, and kept: those that suppression leaves."""
    table = F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"), F.lit(c).alias("confidence"), F.lit(b).alias("base")
            )
            for p, label, k, x, c, b in rules()
        ]
    )
    norm = F.col("norm")
    gate = F.lit(False)
    for stem in stems():
        gate = gate | F.contains(norm, F.lit(stem))
    live = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    found = F.flatten(F.transform(live, lambda r: _places(norm, r)))
    none = F.array().cast("array<struct<priority:int,label:string,confidence:double,base:boolean,start:int,end:int>>")
    rows = df.withColumn("norm", normal(F.col(text_col)))
    rows = rows.withColumn("found", F.when(gate, found).otherwise(none))

    def beaten(d: Column, e: Column) -> Column:
        inside = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
        longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
        return inside & ~e["base"] & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & longer))

    def left(some: Column, others: Column) -> Column:
        return F.filter(some, lambda d: d["base"] | ~F.exists(others, lambda e: beaten(d, e)))

    # what holds a detection starts at most LONGEST words before it: many detections meet those of their own stretch and the one before alone
    stretches = F.sequence(F.lit(0), F.floor(F.array_max(F.transform("found", lambda d: d["start"])) / LONGEST).cast("int"))
    by_stretch = F.transform(stretches, lambda i: F.filter("found", lambda d: F.floor(d["start"] / LONGEST) == i))
    near = lambda s, i: F.when(i == 0, F.get(s, i)).otherwise(F.concat(F.get(s, i - 1), F.get(s, i)))
    many = F.flatten(F.element_at(F.transform(F.array(by_stretch), lambda s: F.transform(s, lambda own, i: F.element_at(F.transform(F.array(near(s, i)), lambda others: left(own, others)), 1))), 1))
    kept = F.when(F.size("found") < 2, F.col("found")).when(F.size("found") < FEW, left(F.col("found"), F.col("found"))).otherwise(many)
    return rows.withColumn("kept", kept)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs)
    base = F.filter("kept", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    return rows.select(
        "doc_id",
        (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("kept").cast("long").alias("n_detections"),
    )
