"""License scans by sentence rules (DataFrame functions only).

A text is cut at line ends and after the signs that end a clause, and its pieces
are normalised. A known licence sentence is found wherever consecutive pieces
have its words, however it is wrapped over lines and whatever signs are inside
of it; so the pieces become a sequence of identifiers, which is matched against
ordered licence rules, with a bounded number of foreign pieces between two rule
sentences. Everything happens inside the row: no shuffle, no Python.

``n_sentences`` counts the pieces.

Defined cases: NULL and empty texts have no sentences and no licences; a
sentence that is repeated counts each time; a rule that matches several times
is reported once; other columns pass through ``scan``, and where one has the
name of a new column, the new one gets an underscore before its name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

# Sentences of public licences and licence notices, and the licences that ordered sentences make.
SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache_head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_as_is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache_line": "Licensed under the Apache License, Version 2.0.",
    "mit_line": "Released under the MIT License.",
    "mit_line_2": "Licensed under the MIT License.",
    "ccbync_line": "Licensed under CC BY-NC 4.0.",
    "ccby_line": "Licensed under CC BY 4.0.",
    "ccbysa_line": "Licensed under CC BY-SA 4.0.",
    "cc0_line": "This work is dedicated to the public domain under CC0 1.0.",
    "gpl3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl_implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost_line": "Distributed under the Boost Software License, Version 1.0.",
    "ccbynd_line": "Licensed under CC BY-ND 4.0.",
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "spdx_apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx_bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx_gpl3": "SPDX-License-Identifier: GPL-3.0-only",
}
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_line"]),
    ("MIT", ["mit_line_2"]),
    ("ISC", ["isc_grant"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("Apache-2.0", ["apache_head", "apache_comply", "apache_copy"]),
    ("Apache-2.0", ["apache_line"]),
    ("CC-BY-NC-4.0", ["ccbync_line"]),
    ("CC-BY-4.0", ["ccby_line"]),
    ("CC-BY-SA-4.0", ["ccbysa_line"]),
    ("CC0-1.0", ["cc0_line"]),
    ("GPL-3.0", ["gpl3_line"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("MPL-2.0", ["mpl_form"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["reserved"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("LGPL-2.1-or-later", ["lgpl_free", "lgpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    ("BSL-1.0", ["boost_line"]),
    ("CC-BY-ND-4.0", ["ccbynd_line"]),
    ("MIT", ["spdx_mit"]),
    ("Apache-2.0", ["spdx_apache"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("GPL-3.0", ["spdx_gpl3"]),
]
#: A rule that another contains is not reported where the longer one matches.
COVERED_BY = {"BSD-2-Clause": "BSD-3-Clause"}

MAX_GAP = 3
BREAK = r"[.!?;:]+(?=\s|$)|\n"


def _normal(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def normalised_sentences(text: Column) -> Column:
    """The sentences of a text, lower-cased, with each run of other characters than a-z and 0-9 made one space; empty ones go."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK)
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def sentence_ids(sentences: Column, known: dict[str, str] = SENTENCES) -> Column:
    """The pieces as a sequence: the number of a known sentence, from 1, for the pieces that make it up, and 0 for every other piece."""
    normal = {i: _normal(s) for i, s in enumerate(known.values(), 1)}
    flat = F.concat(F.lit(" "), F.array_join(sentences, " "), F.lit(" "))
    ids = F.concat(F.lit("|"), F.array_join(sentences, "|"), F.lit("|"))
    # longer sentences first: a shorter one may be the first line of a longer one
    for i, words in sorted(normal.items(), key=lambda x: (-len(x[1]), x[0])):
        ids = F.regexp_replace(ids, r"\|" + words.replace(" ", "[ |]") + r"(?=\|)", f"|#{i}")
    number = lambda p: F.when(F.startswith(p, F.lit("#")), F.substring(p, F.lit(2), F.lit(9)).cast("int")).otherwise(0)
    marked = F.transform(F.filter(F.split(ids, r"\|"), lambda p: p != ""), number)
    # patterns only for texts that hold the words of a known sentence; the array makes the text once for all of them
    holds = F.exists(F.array(flat), lambda t: reduce(or_, (F.contains(t, F.lit(f" {words} ")) for words in normal.values())))
    return F.when(holds, marked).otherwise(F.transform(sentences, lambda _: F.lit(0)))


def licences(ids: Column, rules: list[tuple[str, list[str]]] = RULES, known: dict[str, str] = SENTENCES, max_gap: int = MAX_GAP) -> Column:
    """Sorted names of the rules whose sentences follow one another in ``ids``, up to ``max_gap`` others between two."""
    number = {k: i for i, k in enumerate(known, 1)}
    sequence = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda i: i.cast("string")), " "), F.lit(" "))
    between = rf" (?:\d+ ){{0,{max_gap}}}"
    found = F.array_distinct(F.filter(F.array(*(F.when(sequence.rlike(" " + between.join(str(number[s]) for s in rule) + " "), F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull()))
    for short, longer in COVERED_BY.items():
        found = F.when(F.array_contains(found, longer), F.array_remove(found, short)).otherwise(found)
    return F.array_sort(found)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_sentences, licence_sentences (how many are known) and licences (array)."""
    pieces, ids = free_name("pieces", docs), free_name("ids", docs)
    cut = docs.withColumn(pieces, normalised_sentences(F.col(text)))
    cut = cut.withColumn(ids, sentence_ids(F.col(pieces)))
    known = F.size(F.filter(ids, lambda i: i > 0))
    names = F.when(known > 0, licences(F.col(ids))).otherwise(F.array().cast("array<string>"))
    new = {"n_sentences": F.size(pieces).cast("long"), "licence_sentences": known.cast("long"), "licences": names}
    return cut.withColumns({free_name(c, docs): x for c, x in new.items()}).drop(pieces, ids)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_sentences", "licence_sentences", F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    """Pieces stand between bars of their own, so that one pattern a sentence finds it over any number of whole pieces."""
    number = {k: i for i, k in enumerate(SENTENCES, 1)}
    normal = {number[k]: _normal(s) for k, s in SENTENCES.items()}
    marked = "p"
    for i, words in sorted(normal.items(), key=lambda x: (-len(x[1]), x[0])):
        marked = f"regexp_replace({marked}, '[|]{words.replace(' ', '( |[|][|])')}[|]', '|#{i}|', 'g')"
    between = rf" (?:\d+ ){{0,{MAX_GAP}}}"
    names = sorted({n for n, _ in RULES})
    of = {n: " OR ".join(f"regexp_matches(q, ' {between.join(str(number[s]) for s in r)} ')" for m, r in RULES if m == n) for n in names}
    for short, longer in COVERED_BY.items():
        of[short] = f"({of[short]}) AND NOT ({of[longer]})"
    cases = ", ".join(f"CASE WHEN {of[n]} THEN '{n}' END" for n in names)
    return rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[.!?;:]+(\s|$)', chr(10), 'g'), '\n'),
         lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s
  FROM documents),
p AS (SELECT doc_id, len(s) AS n, array_to_string(list_transform(s, lambda x: '|' || x || '|'), '') AS p FROM s),
m AS (SELECT doc_id, n, list_filter(string_split({marked}, '|'), lambda x: x <> '') AS m FROM p),
i AS (SELECT doc_id, n, list_transform(m, lambda x: CASE WHEN x[1] = '#' THEN x[2:]::INT ELSE 0 END) AS i FROM m),
t AS (SELECT doc_id, n, len(list_filter(i, lambda x: x > 0)) AS k, ' ' || array_to_string(list_transform(i, lambda x: x::VARCHAR), ' ') || ' ' AS q FROM i)
SELECT doc_id, n::BIGINT AS n_sentences, k::BIGINT AS licence_sentences, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS licences FROM t
"""


OP7_SQL = _sql()
