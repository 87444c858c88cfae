"""License scans by ordered signature rules, with built-in functions only.

A text is lower-cased (A-Z only) and read as words. Every rule is a regular expression over words joined by one space, with
one of its words as keyword. Documents without any keyword are done after one test; elsewhere only the rules of
the keyword that stands at a place are tried there, on the few words around it, so work is linear in a text. Of the
detections, one whose words all lie within those of a stronger one is suppressed: the stronger has the higher priority,
then the more words, then the earlier rule.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The base phrases and their labels; how sure each makes a document.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_CONFIDENCE = {"cc by": 0.6, "general public license": 0.6, "all rights reserved": 0.3}

#: Rules in order: label, priority (3: a grant, an identifier or a name with its version; 2: a name; 1: a mention), pattern.
#: The keyword stands in angle brackets; what comes before it is plain words.
SIGNATURES = r"""
mit 3 permission is <hereby> granted free of charge to any person obtaining a copy of this software
mit 3 licensed under the <mit> licen[sc]e
mit 3 released under the <mit> licen[sc]e
mit 3 distributed under the <mit> licen[sc]e
mit 2 the <mit> licen[sc]e
mit 2 <mit> licen[sc]ed?
mit 1 <expat> licen[sc]e
mit-0 3 <mit> no attribution
mit-0 3 <mit> 0 licen[sc]e
x11 2 <x11> licen[sc]e
x11 3 <mit> x11 licen[sc]e
isc 3 permission to use <copy> modify and( or)? distribute this software for any purpose with or without fee is hereby granted
isc 2 <isc> licen[sc]e
0bsd 3 <bsd> (zero|0) clause
0bsd 2 <0bsd> licen[sc]e
bsd 3 <redistribution> and use in source and binary forms with or without modification are permitted
bsd 2 <bsd> (style )?licen[sc]e
bsd 1 <bsd> licen[sc]ed
bsd-2-clause 3 <bsd> (2|two) clause
bsd-2-clause 3 simplified <bsd>
bsd-2-clause 3 <freebsd> licen[sc]e
bsd-3-clause 3 <bsd> (3|three) clause
bsd-3-clause 3 modified <bsd>
bsd-3-clause 3 new <bsd> licen[sc]e
bsd-3-clause 3 revised <bsd>
bsd-4-clause 3 <bsd> (4|four) clause
bsd-4-clause 3 original <bsd> licen[sc]e
bsd-4-clause 2 all advertising materials <mentioning> features or use of this software
apache-1.0 3 <apache> (software )?licen[sc]e (version )?1 0
apache-1.1 3 <apache> (software )?licen[sc]e (version )?1 1
apache-2.0 3 <apache> (software )?licen[sc]e (version |v )?(2 0|2|v2 0|v2)
apache-2.0 3 <apache> (2 0|v2|v2 0) licen[sc]e
apache-2.0 3 you may not use this file <except> in compliance with the license
apache-2.0 3 apache org <licenses> license 2 0
apache 2 <apache> (software )?licen[sc]e
apache 1 licensed under <apache>
gpl-1.0 3 gnu <general> public licen[sc]e (version |v )?(1|v1)( 0)?
gpl-2.0 3 gnu <general> public licen[sc]e (version |v )?(2|v2)( 0)?
gpl-3.0 3 gnu <general> public licen[sc]e (version |v )?(3|v3)( 0)?
gpl-2.0 3 version 2 of the gnu <general> public license
gpl-3.0 3 version 3 of the gnu <general> public license
gpl-2.0-or-later 3 <gpl> (version |v )?(2|v2)( 0)? or (any )?later
gpl-3.0-or-later 3 <gpl> (version |v )?(3|v3)( 0)? or (any )?later
gpl-2.0-or-later 3 gnu <general> public licen[sc]e (version )?2 or at your option any later version
gpl-2.0-or-later 3 <gplv2> (or later|plus)
gpl-3.0-or-later 3 <gplv3> (or later|plus)
gpl-1.0 3 <gpl> (version |v )?1( 0)?
gpl-2.0 3 <gpl> (version |v )?2( 0)?
gpl-3.0 3 <gpl> (version |v )?3( 0)?
gpl-2.0 3 <gplv2>
gpl-3.0 3 <gplv3>
gpl 2 gnu <general> public licen[sc]e
gpl 2 gnu <gpl>
gpl 1 <gpl> licen[sc]ed?
gpl 2 it under the terms of the gnu <general> public license as published by the free software foundation
lgpl-2.0 3 gnu <library> general public licen[sc]e (version |v )?2( 0)?
lgpl-2.1 3 gnu <lesser> general public licen[sc]e (version |v )?2 1
lgpl-3.0 3 gnu <lesser> general public licen[sc]e (version |v )?3( 0)?
lgpl-2.0 3 <lgpl> (version |v )?2( 0)?
lgpl-2.1 3 <lgpl> (version |v )?2 1
lgpl-3.0 3 <lgpl> (version |v )?3( 0)?
lgpl-2.1 3 <lgplv2> 1
lgpl-3.0 3 <lgplv3>
lgpl 2 gnu <lesser> general public licen[sc]e
lgpl 2 gnu <library> general public licen[sc]e
lgpl 1 <lgpl> licen[sc]ed?
agpl-1.0 3 <affero> general public licen[sc]e (version |v )?1( 0)?
agpl-3.0 3 <affero> general public licen[sc]e (version |v )?3( 0)?
agpl-3.0 3 <agpl> (version |v )?3( 0)?
agpl-3.0 3 <agplv3>
agpl 2 gnu <affero> general public licen[sc]e
agpl 1 <agpl> licen[sc]ed?
gfdl-1.1 3 gnu free <documentation> licen[sc]e (version |v )?1 1
gfdl-1.2 3 gnu free <documentation> licen[sc]e (version |v )?1 2
gfdl-1.3 3 gnu free <documentation> licen[sc]e (version |v )?1 3
gfdl 2 gnu free <documentation> licen[sc]e
gfdl 2 <gfdl>
mpl-1.0 3 <mozilla> public licen[sc]e (version |v )?1 0
mpl-1.1 3 <mozilla> public licen[sc]e (version |v )?1 1
mpl-2.0 3 <mozilla> public licen[sc]e (version |v )?2( 0)?
mpl-2.0 3 <mpl> (version |v )?2( 0)?
mpl 2 <mozilla> public licen[sc]e
epl-1.0 3 <eclipse> public licen[sc]e (version |v )?1( 0)?
epl-2.0 3 <eclipse> public licen[sc]e (version |v )?2( 0)?
epl 2 <eclipse> public licen[sc]e
edl-1.0 3 <eclipse> distribution licen[sc]e (version |v )?1 0
cddl-1.0 3 common <development> and distribution licen[sc]e (version |v )?1 0
cddl-1.1 3 common <development> and distribution licen[sc]e (version |v )?1 1
cddl 2 common <development> and distribution licen[sc]e
cpl-1.0 2 <common> public licen[sc]e( version)?( 1 0)?
cpal-1.0 2 common public <attribution> licen[sc]e( version)?( 1 0)?
eupl-1.1 3 <european> union public licen[sc]e (version |v )?1 1
eupl-1.2 3 <european> union public licen[sc]e (version |v )?1 2
eupl 2 <european> union public licen[sc]e
eupl 2 <eupl>
cecill-2.1 2 <cecill>( free software)?( licen[sc]e)?( agreement)?
afl-3.0 2 <academic> free licen[sc]e( version)?( 3 0)?
osl-3.0 2 <open> software licen[sc]e( version)?( 3 0)?
artistic-1.0 3 <artistic> licen[sc]e (version )?1 0
artistic-2.0 3 <artistic> licen[sc]e (version )?2( 0)?
artistic 2 <artistic> licen[sc]e
bsl-1.0 3 <boost> software licen[sc]e( version)?( 1 0)?
busl-1.1 3 <business> source licen[sc]e( version)?( 1 1)?
sspl-1.0 3 <server> side public licen[sc]e( version)?( 1)?
elastic-2.0 3 <elastic> licen[sc]e (version )?2( 0)?
elastic 2 <elastic> licen[sc]e
unlicense 3 this is free and <unencumbered> software released into the public domain
unlicense 2 the <unlicense>
wtfpl 3 do what the <fuck> you want to public licen[sc]e
wtfpl 2 <wtfpl>
zlib 3 this software is provided as is without any <express> or implied warranty in no event will the authors be held liable
zlib 2 <zlib> (libpng )?licen[sc]e
libpng 2 <libpng> licen[sc]e
openssl 2 <openssl> licen[sc]e
ssleay 2 <ssleay> licen[sc]e
psf-2.0 3 <python> software foundation licen[sc]e( version)?( 2)?
python-2.0 2 <python> licen[sc]e
php-3.01 3 <php> licen[sc]e (version )?3 01
php 2 <php> licen[sc]e
ruby 2 <ruby> licen[sc]e
vim 2 <vim> licen[sc]e
curl 2 <curl> licen[sc]e
ncsa 3 university of <illinois> ncsa open source licen[sc]e
ncsa 2 <ncsa> open source licen[sc]e
w3c 2 <w3c> software( notice)?( and)?( document)?( license)?
unicode 2 <unicode> (terms of use|licen[sc]e)
upl-1.0 2 <universal> permissive licen[sc]e
ms-pl 3 <microsoft> public licen[sc]e
ms-rl 3 <microsoft> reciprocal licen[sc]e
qpl-1.0 2 <q> public licen[sc]e
npl-1.1 2 <netscape> public licen[sc]e
ipl-1.0 2 <ibm> public licen[sc]e
spl-1.0 2 <sun> public licen[sc]e
apsl-2.0 2 apple public <source> licen[sc]e
rpl-1.5 2 <reciprocal> public licen[sc]e
sleepycat 2 <sleepycat> licen[sc]e
beerware 2 <beerware> licen[sc]e
beerware 3 the beer ware <license>
postgresql 2 <postgresql> licen[sc]e
mulanpsl-2.0 2 <mulan> (permissive software|psl) licen[sc]e
ofl-1.1 3 <sil> open font licen[sc]e( version)?( 1 1)?
ofl-1.1 2 open <font> licen[sc]e
odbl-1.0 3 <open> (data commons )?(open )?database licen[sc]e
odc-by-1.0 3 open data <commons> attribution licen[sc]e
pddl-1.0 3 public domain <dedication> and licen[sc]e
cdla-permissive 2 community <data> licen[sc]e agreement permissive
cdla-sharing 2 community <data> licen[sc]e agreement sharing
ogl-uk 2 open <government> licen[sc]e
etalab 2 <etalab> (open )?licen[sc]e
cc0 3 <cc0>( 1 0)?( universal)?
cc0 3 <creative> commons (cc0|zero)
cc 2 <creative> commons licen[sc]e
public-domain 2 released into the public <domain>
public-domain 2 dedicated to the public <domain>
public-domain 1 in the public <domain>
openrail 2 <openrail> licen[sc]e
openrail-m 3 <openrail> m
llama 2 <llama> (2 |3 )?community licen[sc]e
gemma 2 <gemma> terms of use
proprietary 2 <proprietary> and confidential
proprietary 2 unauthorized <copying> of this file via any medium is strictly prohibited
proprietary 2 <commercial> licen[sc]e agreement
non-commercial 2 for non <commercial> use only
non-commercial 2 <noncommercial> use only
copyright 1 <copyright> c [0-9]{4}
copyright 1 <copyright> [0-9]{4}
reserved 2 all rights <reserved>
reserved 1 no part of this publication may be <reproduced>
reserved 1 no part of this book may be <reproduced>
reserved 1 no part of this work may be <reproduced>
license-reference 1 see the <license> file
license-reference 1 license <txt> for (details|more information)
"""

#: Identifiers of licenses as machine-readable tags write them; each makes a rule of priority 3.
TAGS = """
MIT MIT-0 X11 ISC 0BSD BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0
GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later
GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only MPL-1.0 MPL-1.1 MPL-2.0
EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 CPAL-1.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 CECILL-2.1 AFL-3.0 OSL-3.0
Artistic-1.0 Artistic-2.0 BSL-1.0 BUSL-1.1 SSPL-1.0 Elastic-2.0 Unlicense WTFPL Zlib Libpng OpenSSL PSF-2.0 Python-2.0
PHP-3.0 PHP-3.01 Ruby Vim curl NCSA W3C UPL-1.0 MS-PL MS-RL QPL-1.0 NPL-1.0 NPL-1.1 IPL-1.0 SPL-1.0 APSL-2.0 RPL-1.5
Sleepycat Beerware PostgreSQL MulanPSL-2.0 OFL-1.0 OFL-1.1 ODbL-1.0 ODC-By-1.0 PDDL-1.0 CDLA-Permissive-2.0
CDLA-Sharing-1.0 CC0-1.0 HPND NTP TCL ZPL-2.1 Xnet JSON ICU LPPL-1.3c BlueOak-1.0.0
"""
#: The parts that attribution licenses combine, and their versions.
ATTRIBUTION = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?derivatives", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?derivatives"}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Most words that stand before a keyword, and most words of a rule in all.
BEFORE, LONGEST = 12, 24


@dataclass(frozen=True)
class Rule:
    """One signature: its keyword, how many words stand before it, and the pattern from its first word on."""

    label: str
    priority: int
    keyword: str
    before: int
    pattern: str


def _spoken(identifier: str) -> str:
    return " ".join(re.split(r"[-.+]", identifier.lower()))


def _rules() -> list[Rule]:
    lines = [line.split(" ", 2) for line in SIGNATURES.strip().splitlines()]
    lines += [(tag.lower(), 3, f"<spdx> license identifier {_spoken(tag)}") for tag in TAGS.split()]
    for part, name in ATTRIBUTION.items():
        for v in VERSIONS:
            lines.append((f"cc-{part}-{v}", 3, f"<cc> {_spoken(part)} {_spoken(v)}"))
            lines.append((f"cc-{part}-{v}", 3, f"creative <commons> {name} {_spoken(v)}"))
            lines.append((f"cc-{part}-{v}", 3, rf"creativecommons org <licenses> {_spoken(part)} {_spoken(v)}"))
        lines.append((f"cc-{part}", 2, f"<cc> {_spoken(part)}"))
        lines.append((f"cc-{part}", 2, f"creative <commons> {name}"))
    out = []
    for label, priority, text in lines:
        left, keyword = re.match(r"(.*?)<(\w+)>", text).groups()
        out.append(Rule(label, int(priority), keyword, len(left.split()), text.replace("<", "").replace(">", "")))
    return out


RULES = _rules()
#: How sure a detection is, by its rule's priority.
CONFIDENCE = {1: 0.4, 2: 0.7, 3: 0.95}
UPPER, LOWER, APART = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOUND = "array<struct<start:int,end:int,rule:int,priority:int>>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _detections(norm: Column) -> Column:
    """Every rule's matches in words joined by one space, suppressed ones left out, sorted by start, end and rule."""
    keywords = sorted({r.keyword for r in RULES})
    table = {k: [{"no": no, "before": r.before, "priority": r.priority, "rx": rf"^(?:[^ ]* ){{{BEFORE - r.before}}}({r.pattern})(?: |$)"} for no, r in enumerate(RULES) if r.keyword == k] for k in keywords}
    by_keyword = F.from_json(F.lit(json.dumps(table)), "map<string,array<struct<no:int,before:int,priority:int,rx:string>>>")  # folded to a constant

    def here(padded: Column, word: Column, i: Column) -> Column:
        """What the rules of the keyword at word i match there."""
        around = F.array_join(F.slice(padded, i + 1, F.lit(BEFORE + LONGEST)), " ")
        hit = lambda text, r: F.struct((i - r["before"]).alias("start"), F.call_function("regexp_extract", text, r["rx"], F.lit(1)).alias("m"), r["no"].alias("no"), r["priority"].alias("priority"))
        hits = _let(around, lambda text: F.filter(F.transform(F.element_at(by_keyword, word), lambda r: hit(text, r)), lambda h: h["m"] != ""))
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + _spaces(h["m"]) + 1).alias("end"), h["no"].alias("rule"), h["priority"].alias("priority")))

    def beaten(d: Column, e: Column) -> Column:
        within = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
        rank = lambda x: F.struct(x["priority"], x["end"] - x["start"], -x["rule"])
        return within & (rank(e) > rank(d))

    def kept(found: Column) -> Column:
        """Matches of keywords further apart than the longest rule can't contain each other."""
        reach = BEFORE + LONGEST
        near = lambda j: F.flatten(F.slice(found, F.greatest(j + 1 - reach, F.lit(1)), F.lit(2 * reach + 1)))
        return F.flatten(F.transform(found, lambda own, j: _let(near(j), lambda others: F.filter(own, lambda d: ~F.exists(others, lambda e: beaten(d, e))))))

    def found(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(keywords))
        padded = F.concat(F.array_repeat(F.lit(""), BEFORE), words)
        return _let(padded, lambda pad: F.filter(F.transform(places, lambda p: here(pad, p["w"], p["i"])), lambda hits: F.size(hits) > 0))

    none = F.array().cast(_FOUND)
    gate = F.split(F.lit(" ".join(keywords)), " ")
    return _let(F.split(norm, " "), lambda words: F.when(F.arrays_overlap(words, gate), F.array_sort(_let(found(words), kept).cast(_FOUND))).otherwise(none))


def _places(padded: Column, n_words: Column) -> Column:
    """Of each base phrase, how often it stands in the text and the first word of its first and last place."""
    out = []
    for phrase, label in PHRASES.items():
        spaced = " " + phrase.replace(" ", "  ") + " "
        gone = F.length(padded) - F.length(F.replace(padded, F.lit(spaced), F.lit("")))
        first = _spaces(F.substring_index(padded, spaced, 1)) / 2
        last = n_words - _spaces(F.substring_index(padded, spaced, -1)) / 2 - len(phrase.split())
        holds = padded.contains(spaced)
        out.append(F.struct(F.lit(label).alias("label"), F.when(holds, gone / len(spaced)).otherwise(0).cast("long").alias("n"), F.when(holds, first).cast("long").alias("first"), F.when(holds, last).cast("long").alias("last"), F.lit(PHRASE_CONFIDENCE[phrase]).alias("confidence")))
    return F.filter(F.array(*out), lambda p: p["n"] > 0)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``phrases`` and ``licenses`` added.

    ``phrases`` has a struct (label, n, first, last, confidence) for each base phrase that stands in the text; ``licenses`` the
    detections that no stronger one contains: structs (start, end, rule, label, confidence), sorted; start and end count words
    from 0, the end exclusive. Ties between equal detections go to the earlier rule. Null text counts as empty and has none;
    repeated rows are each scanned; columns of those names are replaced, all others pass through; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # all ASCII: the same, and faster
    labels = F.split(F.lit(" ".join(r.label for r in RULES)), " ")
    sure = F.array(*[F.lit(CONFIDENCE[p]) for p in (1, 2, 3)])
    named = lambda d: F.struct(d["start"], d["end"], d["rule"], F.get(labels, d["rule"]).alias("label"), F.get(sure, d["priority"] - 1).alias("confidence"))

    def scanned(norm: Column) -> Column:
        n_words = F.when(norm == "", 0).otherwise(_spaces(norm) + 1).cast("long")
        padded = F.concat(F.lit(" "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit(" "))
        phrases = _let(F.struct(padded.alias("p"), n_words.alias("n")), lambda x: _places(x["p"], x["n"]))
        return F.struct(n_words.alias("n_words"), phrases.alias("phrases"), F.transform(_detections(norm), named).alias("licenses"))

    names = ("n_words", "phrases", "licenses")
    out = docs.withColumn("__scan", _let(F.trim(F.regexp_replace(lowered, APART, " ")), scanned))
    return out.withColumns({c: F.col(f"__scan.{c}") for c in names}).drop("__scan")


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the base phrases' places, all labels and the surest detection's confidence (0 without any)."""
    found = scan_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "phrases", "licenses")
    base = F.transform("phrases", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("phrases", lambda p: p["confidence"]), F.transform("licenses", lambda d: d["confidence"])))
    return found.select(
        "doc_id", "n_words", F.aggregate("phrases", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("phrases", lambda p: p["last"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("licenses", lambda d: d["label"]))).alias("labels"), sure.alias("score"),
    )


def license_sql() -> str:
    """DuckDB SQL for :func:`license_digest` over the table documents: rules as a table, joined by keyword."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(f"({no}, {quote(r.label)}, {r.priority}, {CONFIDENCE[r.priority]}, {quote(r.keyword)}, {r.before}, {quote(f'^({r.pattern})( |$)')})" for no, r in enumerate(RULES))
    phrases = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())}, {PHRASE_CONFIDENCE[p]})" for p, label in PHRASES.items())
    return f"""
WITH rule(no, label, priority, confidence, kw, before, rx) AS (VALUES {rules}),
phrase(p, label, n, confidence) AS (VALUES {phrases}),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT doc_id, w, i, w[i + 1] AS kw FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM doc)),
hit AS (SELECT doc_id, no, label, priority, confidence, i - before AS s, regexp_extract(array_to_string(w[i - before + 1 : i - before + {LONGEST}], ' '), rx, 1) AS m
        FROM word JOIN rule USING (kw) WHERE i >= before),
det AS (SELECT *, s + len(string_split(m, ' ')) AS e FROM hit WHERE m <> ''),
gone AS (SELECT DISTINCT d.doc_id, d.no, d.s FROM det d JOIN det x ON x.doc_id = d.doc_id AND x.s <= d.s AND x.e >= d.e
         AND (x.priority > d.priority OR x.priority = d.priority AND (x.e - x.s > d.e - d.s OR x.e - x.s = d.e - d.s AND x.no < d.no))),
kept AS (SELECT det.* FROM det ANTI JOIN gone USING (doc_id, no, s)),
place AS (SELECT doc_id, label, confidence, i FROM word JOIN phrase ON kw = string_split(p, ' ')[1] AND array_to_string(w[i + 1 : i + n], ' ') = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
named AS (SELECT doc_id, label, confidence FROM kept UNION ALL SELECT doc_id, label, confidence FROM place),
method AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM named GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)"""
