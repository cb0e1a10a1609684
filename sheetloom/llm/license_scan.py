"""License scans: ordered signature rules behind a keyword gate.

A text is lower-cased (A-Z) and cut into words.  Rules are regular expressions
over the words joined by one space.  They run only on pieces of a text in
which their keyword stands; a detection that lies within another of higher
rank (a smaller priority number, then a longer span, then an earlier rule) is
dropped.  All of it is one row-local native projection: no shuffle, no user
function, and nothing that grows with more than the text itself.

A piece owns the detections that start in its `PIECE` words and sees `REACH`
words beyond either end; no rule matches more than `REACH` words, so long
texts cost as much a word as short ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: no ASCII character but letters (upper case still in place) and digits.  Listed one by one,
#: the separators become a bit set in Java's matcher, which ranges do not.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
PIECE = 256
REACH = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Hand-written names of license families: label, keyword (see `Signature`), and patterns of names of three kinds.
# Tags mean a license wherever one is cited; titles are parts of a license's title; names are also those of
# organisations, programs or things, and mean a license only next to the word.
FAMILIES = {
    "mit": ("mit|x11|expat", "expat", "", "(?:mit x11|x11 mit|mit|x11)"),
    "apache": ("apache|asl", "(?:asl 2 0|apache 2 0)", "", "apache(?: software(?: foundation)?)?"),
    "gpl": ("gpl|gnu", "(?:gnu )?gpl(?:v[23]|(?: v?[23](?: 0)?))?", "gnu (?:general )?public", ""),
    "lgpl": ("lgpl|lesser|library", "(?:gnu )?lgpl(?:v[23](?: 1)?|(?: v?[23](?: [01])?))?", "(?:gnu )?(?:lesser|library) general public", ""),
    "agpl": ("agpl|affero", "(?:gnu )?agpl(?:v3|(?: v?3(?: 0)?))?", "(?:gnu )?affero general public", ""),
    "bsd": ("bsd|berkeley", "(?:bsd [234] clause|0bsd)", "(?:new|simplified|modified|revised|two clause|three clause|four clause) bsd", "(?:bsd|berkeley software distribution)"),
    "mpl": ("mpl|mozilla", "mpl(?:v2| 2 0| 1 1)", "mozilla public", "mpl"),
    "epl": ("epl|eclipse", "epl [12] 0", "eclipse (?:public|distribution)", "epl"),
    "cddl": ("cddl|common development", "cddl(?: 1 [01])?", "common development and distribution", ""),
    "isc": ("isc|internet systems", "", "internet systems consortium", "isc"),
    "zlib": ("zlib|libpng", "", "zlib libpng", "(?:zlib|libpng)"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "", ""),
    "cc0": ("cc0|zero", "cc0(?: 1 0)?", "creative commons (?:zero|cc0)", ""),
    "cc-by": ("cc by|attribution", "cc by(?: [1234] 0)?", "creative commons attribution", ""),
    "cc-by-sa": ("cc by sa|sharealike|share alike", "cc by sa(?: [1234] 0)?", "creative commons attribution share ?alike", ""),
    "cc-by-nc": ("cc by nc|noncommercial|non commercial", "cc by nc(?: [1234] 0)?", "creative commons attribution non ?commercial", ""),
    "cc-by-nd": ("cc by nd|noderiv|no deriv", "cc by nd(?: [1234] 0)?", "creative commons attribution no ?deriv(?:ative)?s", ""),
    "cc-by-nc-sa": ("cc by nc sa", "cc by nc sa(?: [1234] 0)?", "", ""),
    "cc-by-nc-nd": ("cc by nc nd", "cc by nc nd(?: [1234] 0)?", "", ""),
    "boost": ("boost|bsl", "bsl 1 0", "boost software", "boost"),
    "artistic": ("artistic", "artistic 2 0", "(?:perl|clarified) artistic", "artistic"),
    "wtfpl": ("wtfpl", "wtfpl", "", ""),
    "eupl": ("eupl|european union public", "eupl(?: 1 [12])?", "european union public", ""),
    "ofl": ("ofl|open font", "(?:ofl 1 1|sil ofl)", "(?:sil )?open font", "ofl"),
    "odbl": ("odbl|open database", "odbl(?: 1 0)?", "(?:open data commons )?open database", ""),
    "python": ("psf|python", "psf 2 0", "python software foundation", "(?:psf|python)"),
    "postgresql": ("postgresql", "", "", "postgresql"),
    "ms-pl": ("ms pl|microsoft", "ms pl", "microsoft (?:public|reciprocal)", ""),
    "openssl": ("openssl", "", "openssl and ssleay", "openssl"),
    "sspl": ("sspl|server side", "sspl(?: 1 0)?", "server side public", ""),
    "busl": ("busl|business source", "busl 1 1", "business source", "busl"),
    "elastic": ("elastic", "", "", "elastic(?: 2 0)?"),
    "proprietary": ("proprietary", "", "", "proprietary(?: software)?"),
}

_LICENSE = "licen[cs]es?"
_VERSION = "(?: v(?:ersion)?)? ?[0-9]+(?: [0-9]+)?"
# Hand-written ways of citing a name: priority, score, pattern around it.  Each holds "licen", "spdx" or "terms".
CITED_TAGS = (
    (0, 1.0, "spdx license identifier (?:{})(?: only| or later| plus)?"),
    (1, 0.95, "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}"),
    (1, 0.95, "dual licen[cs]ed (?:under )?(?:the )?{}"),
    (1, 0.95, "under (?:the )?terms of (?:the )?{}"),
    (1, 0.95, "either (?:the )?{} or (?:[^ ]+ ){{1,6}}licen[cs]e"),
    (2, 0.9, f"{{}}(?: or later)? {_LICENSE}{_VERSION}"),
    (2, 0.85, f"{{}}(?: or later)? {_LICENSE}"),
    (2, 0.85, f"{_LICENSE} (?:is )?(?:the )?{{}}"),
    (3, 0.7, "{} licen[cs]ed"),
    (3, 0.6, "{} with (?:[^ ]+ ){{1,4}}exception (?:[^ ]+ ){{0,4}}licen[cs]e"),
)
CITED_TITLES = (
    (0, 1.0, f"spdx license identifier {{}} {_LICENSE}"),
    (1, 0.95, f"under (?:the )?(?:terms of )?(?:the )?{{}} {_LICENSE}{_VERSION}"),
    (1, 0.95, f"under (?:the )?(?:terms of )?(?:the )?{{}} {_LICENSE}"),
    (2, 0.9, f"{{}} {_LICENSE}{_VERSION}"),
    (2, 0.85, f"{{}} {_LICENSE}"),
    (3, 0.7, "licen[cs]ed under (?:the )?{}"),
)
CITED_NAMES = (
    (0, 1.0, "spdx license identifier {}"),
    (1, 0.95, f"(?:licen[cs]ed|released|distributed|published|available|covered|provided) under (?:the )?(?:terms of )?(?:the )?{{}} {_LICENSE}{_VERSION}"),
    (1, 0.95, f"(?:licen[cs]ed|released|distributed|published|available|covered|provided) under (?:the )?(?:terms of )?(?:the )?{{}} {_LICENSE}"),
    (1, 0.9, "licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}"),
    (2, 0.8, f"{{}} {_LICENSE}{_VERSION}"),
    (2, 0.8, f"{{}} style {_LICENSE}"),
    (3, 0.7, f"{{}} {_LICENSE}"),
    (3, 0.7, "{} licen[cs]ed"),
)

# Hand-written sentences of license texts.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "apache org", "apache org licenses license 2 0"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify"),
    ("gpl", "gnu org", "gnu org licenses gpl(?: [0-9] [0-9])?"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "endorse", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "public domain", "released into the public domain"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty"),
    ("boost", "boost", "boost software license version 1 0"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [0-9] [0-9]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero [0-9] [0-9]"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str  # alternatives split by |, of which every match of the pattern holds one
    pattern: str
    priority: int
    score: float


def signatures() -> list[Signature]:
    """The rules in order: the base phrases, license sentences, citations of every name."""
    rules = [Signature(label, phrase, phrase, 3, 0.7) for phrase, label in BASE_PHRASES.items()]
    rules += [Signature(label, keyword, sentence, 0, 0.9) for label, keyword, sentence in SENTENCES]
    for kind, shapes in enumerate((CITED_TAGS, CITED_TITLES, CITED_NAMES), start=1):
        for priority, score, shape in shapes:
            for label, family in FAMILIES.items():
                if family[kind]:
                    rules.append(Signature(label, family[0], shape.format(family[kind]), priority, score))
    return rules


#: Every rule's pattern holds one of these, so that a text without them has no detection.
GATE = (
    "licen", "spdx", "terms", "permission", "redistribut", "warranty", "domain", "free", "reserved", "creativecommons", "apache",
    "gnu", "boost", "mozilla", "endorse", "copyright",
)


def _gated(lowered: Column) -> Column:
    return reduce(or_, (F.contains(lowered, F.lit(word)) for word in GATE))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(piece: Column, rule: Column) -> Column:
    """Spans of a rule in a piece, in words of the text: array<struct<start,end,...>>."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(piece["text"], pattern, F.lit(0))
    between = F.split(piece["text"], pattern, -1)
    located = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + _spaces(x["b"]) + _spaces(x["m"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (piece["first"] + acc["at"] + _spaces(x["b"])).alias("start"),
                    (piece["first"] + acc["at"] + _spaces(x["b"]) + _spaces(x["m"]) + 1).alias("end"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(
        located,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"),
            rule["score"].alias("score"), rule["priority"].alias("priority"),
        ),
    )


def _above(b: Column, a: Column) -> Column:
    """Whether detection `b` contains `a` and outranks it."""
    longer = (b["end"] - b["start"]) - (a["end"] - a["start"])
    outranks = (b["priority"] < a["priority"]) | (
        (b["priority"] == a["priority"]) & ((longer > 0) | ((longer == 0) & (b["rank"] < a["rank"])))
    )
    return (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & outranks


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, ``base`` and ``detections`` (arrays of spans in words, end exclusive).

    ``base`` has every place of a base phrase, also those that a detection of
    higher rank contains.  A null or empty text has no words and empty arrays;
    repeated rows get equal results.
    """
    ordered = signatures() if rules is None else rules
    table = F.array(
        *(
            F.struct(
                F.lit(i).alias("rank"), F.lit(r.label).alias("label"),
                F.array(*(F.lit(k) for k in r.keyword.split("|"))).alias("keywords"), F.lit(r.pattern).alias("pattern"),
                F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"),
            )
            for i, r in enumerate(ordered)
        )
    )
    whole = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id",
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("words"),
        _gated(F.lower(whole)).alias("gated"),
    )
    n = F.size("words")

    def piece(k: Column) -> Column:
        first = F.greatest(k * PIECE - REACH, F.lit(0))
        body = F.array_join(F.slice(F.col("words"), first + 1, (k + 1) * PIECE + REACH - first), " ")
        return F.struct(
            first.alias("first"), (k * PIECE).alias("from"), ((k + 1) * PIECE).alias("to"),
            F.concat(F.lit(" "), F.translate(body, UPPER, LOWER), F.lit(" ")).alias("text"),
        )

    gated = F.col("gated") & (n > 0)
    cut = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.when(
            gated,
            F.filter(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), piece), lambda p: _gated(p["text"])),
        )
        .otherwise(F.array())
        .alias("pieces"),
    )
    base = F.array(*(F.lit(p) for p in BASE_PHRASES))

    def owned(p: Column, found: Column) -> Column:
        return F.filter(found, lambda d: (d["start"] >= p["from"]) & (d["start"] < p["to"]))

    def hits(p: Column) -> Column:
        live = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(p["text"], k)))
        return F.struct(p["from"].alias("from"), p["to"].alias("to"), F.flatten(F.transform(live, lambda r: _detections(p, r))).alias("all"))

    found = cut.withColumn("hits", F.transform("pieces", hits)).drop("pieces")
    # out of a generator, so that no filter on the spans is moved below and computes them anew
    spans = F.struct(
        F.flatten(
            F.transform("hits", lambda p: owned(p, F.filter(p["all"], lambda d: d["rank"] < len(base_rules(ordered)))))
        ).alias("base"),
        F.flatten(
            F.transform(
                "hits",
                lambda p: F.filter(
                    owned(p, p["all"]), lambda a: ~F.exists(p["all"], lambda b: _above(b, a))
                ),
            )
        ).alias("detections"),
    )
    return found.select("doc_id", "n_words", F.inline(F.array(spans)))


def base_rules(rules: list[Signature]) -> list[Signature]:
    """The leading rules that are base phrases."""
    return [r for r in rules[: len(BASE_PHRASES)] if r.pattern in BASE_PHRASES]


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts, places and labels; ``score`` is the best score of a kept detection, else 0."""
    scanned = scan_licenses(docs, doc_id, text)
    first = F.transform("base", lambda d: d["start"])
    names = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    every = F.array_sort(
        F.array_distinct(F.concat(F.transform("base", lambda d: d["label"]), F.transform("detections", lambda d: d["label"])))
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)).cast("double").alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
