"""Licence detection by ordered signature rules.

A text becomes its words, lowered and joined by one blank. Rules are regular
expressions over words, each with a keyword, a priority, a confidence and a
label. Texts without any gate word are done; in the others a rule runs only
where its keyword occurs. Detections are word intervals; one that lies inside
another of at least its priority is suppressed. All of it is column
expressions, evaluated in one pass without a shuffle.

Besides the rules, the four base phrases are counted wherever they stand.

Nulls: a null text is an empty one; a null id stays null; repeated rows are
scanned each; an empty table gives no rows. An interval that equals another
one of the same priority goes to the rule that comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import text_or_empty

#: The base phrases and labels that the contract fixes.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families: label, keyword, the names a text uses for it (over words), identifier words.
FAMILIES = (
    ("gpl-2.0", "gnu", "gnu general public license (?:gpl )?(?:v|version )?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", "gnu general public license (?:gpl )?(?:v|version )?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: v?[123](?: 0)?)?", "gpl 1 0(?: only| or later)?"),
    ("gpl", "gnu general", "gnu general public licen[cs]e", "gpl"),
    ("lgpl", "lesser general", "gnu lesser general public licen[cs]e(?: (?:v|version )?[23](?: [01])?)?", "lgpl [23] [01](?: only| or later)?"),
    ("lgpl", "lgpl", "lgpl(?: v?[23](?: [01])?)?", "lgpl"),
    ("agpl", "affero", "gnu affero general public licen[cs]e(?: (?:v|version )?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", "agpl(?: v?3(?: 0)?)?", "agpl"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e(?: (?:version )?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("apache-2.0", "apache", "apache licen[cs]e (?:v|version )?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:v|version )?1 1", "apache 1 1"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "apache 1 0"),
    ("mit", "mit", "mit(?: x11)? licen[cs]e", "mit"),
    ("mit", "expat", "expat licen[cs]e", "expat"),
    ("x11", "x11", "x11 licen[cs]e", "x11"),
    ("bsd-2-clause", "bsd", "(?:simplified|2 clause|freebsd) bsd licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause) bsd licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|4 clause) bsd licen[cs]e", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "0bsd"),
    ("isc", "isc", "isc licen[cs]e", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e (?:v |version )?2 0", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:v |version )?1 1", "mpl 1 1"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl 1 0"),
    ("epl", "eclipse", "eclipse public licen[cs]e(?: (?:v |version )?[12] 0)?", "epl [12] 0"),
    ("cddl", "distribution licen", "common development and distribution licen[cs]e(?: (?:version )?1 [01])?", "cddl 1 [01]"),
    ("cpl", "common public", "common public licen[cs]e(?: (?:version )?1 0)?", "cpl 1 0"),
    ("artistic", "artistic", "artistic licen[cs]e(?: (?:version )?[12] 0)?", "artistic [12] 0"),
    ("boost", "boost", "boost software licen[cs]e(?: (?:version )?1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python", "python", "python software foundation licen[cs]e", "psf 2 0"),
    ("eupl", "european union", "european union public licen[cs]e(?: (?:v |version )?1 [12])?", "eupl 1 [12]"),
    ("ofl", "open font", "sil open font licen[cs]e(?: (?:version )?1 [01])?", "ofl 1 [01]"),
    ("odbl", "open database", "open database licen[cs]e", "odbl 1 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] 0)?", "cc by nc nd [1-4] 0"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] 0)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] 0)?", "cc by nc [1-4] 0"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] 0)?", "cc by nd [1-4] 0"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] 0)?", "cc by sa [1-4] 0"),
    ("cc-by", "cc by", "cc by(?: [1-4] 0)?", "cc by [1-4] 0"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] 0)?", "cc by nc"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] 0)?", "cc by sa"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] 0)?", "cc by"),
    ("public-domain", "public domain", "public domain", "public domain"),
)

#: Around a name N and an identifier I: pattern, priority, confidence.
FRAMES = (
    ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?N(?: licen[cs]e)?", 3, 0.95),
    ("(?:released|distributed|published|provided|available) (?:freely )?under (?:the )?(?:terms of (?:the )?)?N(?: licen[cs]e)?", 3, 0.95),
    ("(?:subject to|governed by|in accordance with|under) (?:the )?(?:terms of (?:the )?)?N", 2, 0.85),
    ("(?:see|read|view|consult) (?:the )?N(?: for (?:more )?details)?", 2, 0.8),
    ("spdx licen[cs]e identifier I", 4, 0.99),
    ("N", 1, 0.7),
)

#: Whole sentences of licence texts: label, keyword, pattern, priority, confidence.
SENTENCES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software", 5, 1.0),
    ("isc", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 5, 1.0),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 5, 1.0),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 5, 1.0),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license", 5, 0.95),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty", 5, 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 5, 1.0),
    ("boost", "boost", "distributed under the boost software license version 1 0", 5, 1.0),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license", 5, 1.0),
    ("proprietary", "all rights reserved", "all rights reserved", 1, 0.4),
    ("proprietary", "proprietary", "(?:proprietary and )?confidential(?: and proprietary)?", 1, 0.3),
)


@dataclass(frozen=True)
class Rule:
    keyword: str
    regex: str
    priority: int
    confidence: float
    label: str


def rules() -> list[Rule]:
    """All rules in order: families by frames, then sentences."""
    out = []
    for label, keyword, name, identifier in FAMILIES:
        for frame, priority, confidence in FRAMES:
            word = "spdx" if "I" in frame else keyword
            body = frame.replace("N", f"(?:{name})").replace("I", f"(?:{identifier})")
            out.append(Rule(word, f" {body}(?= )", priority, confidence, label))
    return out + [Rule(k, f" {p}(?= )", pr, c, label) for label, k, p, pr, c in SENTENCES]


#: A text in which none of these occurs has no rule to run; each keyword above contains one.
GATES = ("gnu", "gpl", "apache", "mit ", "expat", "x11", "bsd", "isc ", "zlib", "mozilla", "eclipse", "licen", "affero", "documentation", "artistic", "boost", "wtfpl", "python", "european union", "open font", "open database", "cc0", "cc by", "creative commons", "public domain", "spdx", "common public", "hereby granted", "redistribution", "free software", "as is", "unencumbered", "rights reserved", "proprietary")


def word_text(text_col: str) -> Column:
    """' w1 w2 ... ' of the lowered words; two blanks without words."""
    lowered = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _detections(words: Column, table: list[Rule]) -> Column:
    """array<struct(start, stop, priority, confidence, label)> in rule order."""
    def one(x: Rule) -> Column:
        return F.struct(*(F.lit(v).alias(k) for k, v in (("kw", x.keyword), ("re", x.regex), ("p", x.priority), ("c", x.confidence), ("l", x.label))))

    running = F.filter(F.array(*map(one, table)), lambda r: F.contains(words, r["kw"]))

    def places(r: Column) -> Column:
        hits = F.regexp_extract_all(words, r["re"], F.lit(0))
        between = F.slice(F.split(words, r["re"], F.lit(-1)), 1, F.size(hits))
        steps = F.zip_with(between, hits, lambda b, h: F.struct(_blanks(b).alias("skip"), _blanks(h).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,p:int,c:double,l:string>>)").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            first = acc["at"] + s["skip"]
            row = F.struct(first.alias("start"), (first + s["n"]).alias("stop"), r["p"].alias("p"), r["c"].alias("c"), r["l"].alias("l"))
            return F.struct((first + s["n"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(running, places))


def _surviving(found: Column, levels: list[int]) -> Column:
    """struct(labels, words, score) of the detections that no other one of at least
    their priority contains. Sorted by start, then longest first, whatever contains
    a detection comes before it, so the farthest end of each priority is enough."""
    order = lambda x: F.struct(x["start"].alias("a"), (-x["stop"]).alias("b"), (-x["p"]).alias("d"), x["l"].alias("l"), x["c"].alias("c"))
    rows = F.array_sort(F.transform(found, order))
    ends = [f"e{p}" for p in levels]
    start = F.struct(F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0).alias("words"), F.lit(0.0).alias("score"), *(F.lit(-1).alias(e) for e in ends))

    def step(acc: Column, x: Column) -> Column:
        stop, p = -x["b"], -x["d"]
        inside = F.lit(False)
        for level, e in zip(levels, ends):
            inside = inside | ((F.lit(level) >= p) & (acc[e] >= stop))
        keep = ~inside
        return F.struct(
            F.when(keep, F.array_union(acc["labels"], F.array(x["l"]))).otherwise(acc["labels"]).alias("labels"),
            (acc["words"] + F.when(keep, stop - x["a"]).otherwise(F.lit(0))).alias("words"),
            F.greatest(acc["score"], F.when(keep, x["c"]).otherwise(F.lit(0.0))).alias("score"),
            *(F.when(F.lit(level) == p, F.greatest(acc[e], stop)).otherwise(acc[e]).alias(e) for level, e in zip(levels, ends)),
        )

    return F.aggregate(rows, start, step, lambda acc: F.struct(acc["labels"], acc["words"], acc["score"]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, and license_words, the words that surviving
    detections span."""
    table = rules() if table is None else table
    levels = sorted({r.priority for r in table})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_text(text_col).alias("w"))
    w = F.col("w")
    gated = F.lit(False)
    for g in GATES:
        gated = gated | F.contains(w, F.lit(g))
    rows = rows.withColumn("n", F.when(w == "  ", F.lit(0)).otherwise(_blanks(w) - 1)).withColumn("gated", gated)
    none = F.expr("cast(null as struct<labels:array<string>,words:int,score:double>)")
    rows = rows.withColumn("found", F.when(F.col("gated"), _surviving(_detections(w, table), levels)).otherwise(none))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(w, F.lit(f" {phrase} "))
        counts.append(F.when(there, F.regexp_count(w, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)))
        firsts.append(F.when(there, _blanks(F.substring_index(w, f" {phrase} ", 1))))
        lasts.append(F.when(there, F.col("n") - _blanks(F.substring_index(w, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    n_base = sum(counts[1:], counts[0])
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.col("found.labels"), F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("found.score"), F.lit(0.0)), F.when(n_base > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce(F.col("found.words"), F.lit(0)).cast("long").alias("license_words"),
    )
