"""Licence recognition by rules over sentences.

Every sentence is normalised and mapped to the identifier of a known licence sentence; a licence rule
is an ordered run of identifiers, found in the document's sequence of known sentences. Everything is a
column expression on one row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Known sentences (normalised: lower case, marks as single blanks) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit.note",
    "licensed under the mit license": "mit.note",
    "this project is licensed under the mit license": "mit.note",
    "licensed under the apache license version 2 0": "apache2.note",
    "licensed under the apache license version 2 0 the license": "apache2.note",
    "you may not use this file except in compliance with the license": "apache2.use",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2.warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3.note",
    "licensed under the gnu general public license version 3": "gpl3.note",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "licensed under cc by nc 4 0": "ccbync4.note",
    "this work is licensed under cc by nc 4 0": "ccbync4.note",
    "licensed under cc by 4 0": "ccby4.note",
    "licensed under cc by sa 4 0": "ccbysa4.note",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.note",
    "all rights reserved": "reserved.note",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "this is free and unencumbered software released into the public domain": "unlicense.note",
}
# Licences and their ordered sentence identifiers.
RULES = [
    ("MIT", ["mit.note"]),
    ("MIT", ["mit.notice"]),
    ("Apache-2.0", ["apache2.note"]),
    ("Apache-2.0", ["apache2.note", "apache2.use", "apache2.copy", "apache2.warranty"]),
    ("GPL-3.0", ["gpl3.note"]),
    ("GPL-3.0", ["gpl3.grant", "gpl.warranty"]),
    ("GPL-2.0", ["gpl2.grant", "gpl.warranty"]),
    ("CC-BY-NC-4.0", ["ccbync4.note"]),
    ("CC-BY-4.0", ["ccby4.note"]),
    ("CC-BY-SA-4.0", ["ccbysa4.note"]),
    ("BSD-2-Clause", ["bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.source", "bsd.binary", "bsd.names"]),
    ("Unlicense", ["unlicense.note"]),
    ("Proprietary", ["reserved.note"]),
]
#: Every known sentence holds one of these inside a word, so raw text without them needs no normalisation,
#: however its words are spaced, wrapped or hyphenated.
ANCHORS = ["licen", "reserved", "permission", "redistribut", "warrant", "copyright", "domain"]


def _anchored(text: Column) -> Column:
    out = text.contains(ANCHORS[0])
    for word in ANCHORS[1:]:
        out = out | text.contains(word)
    return out


def _found(flow: Column) -> Column:
    """Identifiers of the known sentences of lower-case text, in order, as ``<a><b>``."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    sentences = F.filter(F.split(F.regexp_replace(flow, "([.!?])[ \\t]+", "$1\n"), "\n"), _anchored)
    named = F.transform(sentences, lambda s: F.element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))))
    return F.array_join(F.transform(F.filter(named, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licence, rule, sentences): one row per document and matched rule.

    Sentences end at a mark and a blank or at a line's end; a second reading joins the lines, for
    sentences that wrap. A rule matches if its identifiers follow one another among the known
    sentences of either reading. ``sentences`` is the larger number of known sentences. Null and empty
    texts match nothing; rows with null or repeated doc_id are treated like others.
    """
    low = docs.select("doc_id", F.lower("text").alias("_t")).where(_anchored(F.col("_t")))
    read = low.select("doc_id", _found(F.col("_t")).alias("_lines"), _found(F.regexp_replace("_t", "\\s+", " ")).alias("_flow"))
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{i}>" for i in ids)).alias("rule")) for name, ids in RULES])
    hits = F.filter(rules, lambda r: F.col("_lines").contains(r["rule"]) | F.col("_flow").contains(r["rule"]))
    count = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("<"), F.lit("")))
    return read.select("doc_id", F.explode(hits).alias("r"), F.greatest(count("_lines"), count("_flow")).cast("long").alias("sentences")).select("doc_id", "r.licence", "r.rule", "sentences")


def _sql() -> str:
    quoted = lambda s: "'" + s + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({quoted(n)}, {quoted(''.join(f'<{i}>' for i in ids))})" for n, ids in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(licence, rule) AS (VALUES {rules}),
texts AS (SELECT row_number() OVER () AS row, doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
readings AS (SELECT row, doc_id, 1 AS reading, t FROM texts UNION ALL SELECT row, doc_id, 2, regexp_replace(t, '\\s+', ' ', 'g') FROM texts),
cut AS (SELECT row, doc_id, reading, string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM readings),
each AS (SELECT row, doc_id, reading, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM cut),
named AS (SELECT row, doc_id, reading, n, id FROM each JOIN known ON trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence),
found AS (SELECT row, doc_id, reading, string_agg('<' || id || '>', '' ORDER BY n) AS ids, count(*) AS k FROM named GROUP BY ALL),
most AS (SELECT row, max(k) AS sentences FROM found GROUP BY row)
SELECT DISTINCT_ROWS.doc_id, licence, rule, sentences FROM (SELECT DISTINCT row, doc_id, licence, rule FROM found JOIN rules ON contains(ids, rule)) AS DISTINCT_ROWS JOIN most USING (row)
"""


SQL = _sql()
