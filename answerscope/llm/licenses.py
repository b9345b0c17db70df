"""Operator 4: licences in texts, by sentences and then by rules over sentences. Native DataFrame functions.

A text is read twice, as lines (for notices that stand on a line of their own) and with its line breaks folded (for
licence texts wrapped at some width). Each reading is split into sentences, the sentences are normalised (ASCII lower
case, everything but letters, digits, dots and pluses one space, no dots at the ends), and known ones become their
identifiers, in order. A rule is a row of identifiers; it matches where a reading's known sentences hold that row with
nothing known between. A rule that only extends a shorter one replaces it (BSD-3-Clause over BSD-2-Clause, since the
shorter one's last sentences don't follow each other there).

Everything happens within the row: no shuffle, no group, and time in proportion to the text. Most texts are left out by
one search for words without which no known sentence is possible.

Nulls: a null or empty text has no sentences and no licences. Repeated rows get equal results; an empty table gives no
rows; other columns are not read by the query and kept by detected(), whose own results win over equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Names that notices use, and the identifier of the licence they mean.
NAMES = {
    "mit license": "MIT", "apache license version 2.0": "Apache-2.0", "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0", "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2.0": "MPL-2.0", "isc license": "ISC", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause",
    "cc by 4.0": "CC-BY-4.0", "cc by sa 4.0": "CC-BY-SA-4.0", "cc by nc 4.0": "CC-BY-NC-4.0", "cc by nd 4.0": "CC-BY-ND-4.0",
    "cc by nc sa 4.0": "CC-BY-NC-SA-4.0", "cc by nc nd 4.0": "CC-BY-NC-ND-4.0", "cc0 1.0": "CC0-1.0",
}
OPENINGS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under", "this software is licensed under", "this file is licensed under", "this project is licensed under", "this program is licensed under", "this document is licensed under")

# Sentences of licence texts.
SENTENCES = {
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.as_is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd.permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.as_is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache.under": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache.comply": "you may not use this file except in compliance with the License.",
    "gpl.redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2.version": "either version 2 of the License, or (at your option) any later version.",
    "gpl3.version": "either version 3 of the License, or (at your option) any later version.",
    # the usual notice has a comma before its version, so that both are one sentence
    "gpl3.redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl.subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense.domain": "This is free and unencumbered software released into the public domain.",
    "lgpl.redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21.version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3.redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl.warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "agpl3.redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl2.available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib.as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib.permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl1.grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc4.by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc4.by_sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc4.by_nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc4.by_nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc4.by_nc_sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc4.by_nc_nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

# Ordered rules over texts' sentences.
RULES = {
    "MIT": [("mit.grant", "mit.notice", "mit.as_is", "mit.liability"), ("mit.grant", "mit.notice", "mit.as_is")],
    "ISC": [("isc.grant", "isc.as_is")],
    "BSD-2-Clause": [("bsd.permit", "bsd.source", "bsd.binary", "bsd.as_is")],
    "BSD-3-Clause": [("bsd.permit", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.as_is")],
    "Apache-2.0": [("apache.under", "apache.comply")],
    "GPL-2.0-or-later": [("gpl.redistribute", "gpl2.version", "gpl.warranty")],
    "GPL-3.0-or-later": [("gpl3.redistribute", "gpl.warranty"), ("gpl.redistribute", "gpl3.version", "gpl.warranty")],
    "MPL-2.0": [("mpl.subject",)],
    "Unlicense": [("unlicense.domain",)],
    "LGPL-2.1-or-later": [("lgpl.redistribute", "lgpl21.version", "lgpl.warranty")],
    "LGPL-3.0-or-later": [("lgpl3.redistribute", "lgpl.warranty"), ("lgpl3.redistribute", "gpl.warranty"), ("lgpl.redistribute", "gpl3.version", "lgpl.warranty")],
    "AGPL-3.0-or-later": [("agpl3.redistribute", "gpl.warranty")],
    "EPL-2.0": [("epl2.available",)],
    "Zlib": [("zlib.as_is", "zlib.liability", "zlib.permission")],
    "BSL-1.0": [("bsl1.grant",)],
    "CC-BY-4.0": [("cc4.by",)],
    "CC-BY-SA-4.0": [("cc4.by_sa",)],
    "CC-BY-NC-4.0": [("cc4.by_nc",)],
    "CC-BY-ND-4.0": [("cc4.by_nd",)],
    "CC-BY-NC-SA-4.0": [("cc4.by_nc_sa",)],
    "CC-BY-NC-ND-4.0": [("cc4.by_nc_nd",)],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = r"([.!?;:])[ \t\r\n\f]+"
BLANK = r"\r?\n[ \t]*\r?\n\s*"
#: Single words, of which every known sentence has one: white space between words may vary in a text.
ANCHORS = r"(?i)licen[cs]e|permission|redistribut|software|warrant|released|distributed|available"
NOTICE = "notice."


def plain(sentence: str) -> str:
    """The normal form, in Python (for the fixed values)."""
    import re

    low = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in sentence)
    return re.sub(r"[^a-z0-9.+]+", " ", low).strip(" .")


def dictionary() -> dict[str, str]:
    """Known normalised sentences and their identifiers."""
    known = {plain(v): k for k, v in SENTENCES.items()}
    for name, licence in NAMES.items():
        for opening in OPENINGS:
            for the in ("", "the "):
                known[f"{opening} {the}{name}"] = NOTICE + licence
    return known


def _sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences of one reading."""
    if wrapped:
        # a blank line ends a sentence; other line breaks are folded
        text = F.array_join(F.transform(F.split(text, BLANK), lambda part: F.regexp_replace(part, r"[\r\n]+", " ")), "\n")
    broken = F.regexp_replace(text, ENDS, "$1\n")
    low = F.translate(broken, UPPER, LOWER)
    return F.transform(F.split(low, r"[\r\n]+"), lambda s: F.btrim(F.regexp_replace(s, r"[^a-z0-9.+]+", " "), F.lit(" .")))


def _identified(sentences: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences, in order."""
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.transform(F.filter(sentences, lambda s: s.isin(list(known))), lambda s: pairs[s])


def detected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with line_ids and wrapped_ids (identifiers in order) and licences (sorted, distinct)."""
    known = dictionary()
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    possible = text.rlike(ANCHORS)
    lines = F.when(possible, _identified(_sentences(text, False), known)).otherwise(none)
    folded = F.when(possible, _identified(_sentences(text, True), known)).otherwise(none)
    rows = docs.withColumn("line_ids", lines).withColumn("wrapped_ids", folded)
    notices = F.transform(F.filter(F.concat("line_ids", "wrapped_ids"), lambda x: x.startswith(NOTICE)), lambda x: F.substr(x, F.lit(len(NOTICE) + 1)))
    joined = F.concat(F.lit("|"), F.array_join("line_ids", "|"), F.lit("||"), F.array_join("wrapped_ids", "|"), F.lit("|"))
    texts = []
    for licence, options in RULES.items():
        hit = F.lit(False)
        for rule in options:
            hit = hit | joined.contains("|" + "|".join(rule) + "|")
        texts.append(F.when(hit, F.lit(licence)))
    return rows.withColumn("licences", F.array_sort(F.array_distinct(F.concat(notices, F.array_compact(F.array(*texts))))))


def op4_license_rules(spark, sf_dir: str) -> DataFrame:
    found = detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("line_ids", ",").alias("line_ids"),
        F.array_join("wrapped_ids", ",").alias("wrapped_ids"),
        F.array_join("licences", ",").alias("licences"),
        F.size("licences").cast("long").alias("n_licences"),
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in dictionary().items())
    rules = ", ".join(f"({q(licence)}, {q('|' + '|'.join(rule) + '|')})" for licence, options in RULES.items() for rule in options)
    norm = "regexp_replace(regexp_replace({}, '[^a-z0-9.+]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    return f"""
with known(s, id) as (values {known}), rules(licence, ids) as (values {rules}),
folds as (select doc_id, 'line' as kind, regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n\\f]+', E'\\\\1\\n', 'g') t from documents
  union all select doc_id, 'wrapped', regexp_replace(array_to_string(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n[ \\t]*\\r?\\n\\s*'), lambda p: regexp_replace(p, '[\\r\\n]+', ' ', 'g')), chr(10)), '([.!?;:])[ \\t\\r\\n\\f]+', E'\\\\1\\n', 'g') from documents),
parts as (select doc_id, kind, unnest(a) x, unnest(range(len(a))) i from (select doc_id, kind, string_split_regex(translate(t, '{UPPER}', '{LOWER}'), '[\\r\\n]+') a from folds)),
hits as (select doc_id, kind, i, id from (select doc_id, kind, i, {norm.format("x")} s from parts) join known using (s)),
seqs as (select doc_id, coalesce(string_agg(id, '|' order by i) filter (kind = 'line'), '') l, coalesce(string_agg(id, '|' order by i) filter (kind = 'wrapped'), '') w from hits group by doc_id),
lic as (select doc_id, substr(id, {len(NOTICE) + 1}) licence from hits where starts_with(id, '{NOTICE}')
  union select doc_id, licence from seqs join rules on contains('|' || l || '||' || w || '|', ids)),
names as (select doc_id, string_agg(licence, ',' order by licence) licences, count(*) n from (select distinct * from lic) group by doc_id)
select doc_id, replace(coalesce(l, ''), '|', ',') line_ids, replace(coalesce(w, ''), '|', ',') wrapped_ids, coalesce(licences, '') licences, cast(coalesce(n, 0) as bigint) n_licences
from documents left join seqs using (doc_id) left join names using (doc_id)
"""


OP4_SQL = _sql()
