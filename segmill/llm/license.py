"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences; normalised sentences that are known get identifiers, and the sequence of a text's
identifiers is matched against rules in their order: a rule that occurs takes its sentences, so that a licence's whole
text is not also reported by a shorter rule. Known sentences are cut as texts are, so one that holds an end is several
identifiers in a row. Sentences are read three times: with line ends as sentence ends, with line ends as spaces, as licence
texts are often wrapped, and so but with blank lines as sentence ends, as titles and copyright lines have no end of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of the notices that refer to them, by identifier.
SENTENCES = {
    "mit-ref": "Released under the MIT License",
    "mit-ref2": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ref": "Licensed under the BSD License",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-ref": "Licensed under the GNU General Public License, version 2",
    "lgpl21-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-ref": "Licensed under the GNU Affero General Public License, version 3",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-deed": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-ref2": "Licensed under the GNU General Public License, version 3",
    "gpl3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0",
    "cc-by-ref": "Licensed under CC BY 4.0",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0",
    "cc-by-nd-ref": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-ref": "Licensed under CC BY-NC-SA 4.0",
    "cc0-ref": "Licensed under CC0 1.0",
}
# Licences and the sequences of sentences that stand for them, the first to match first.
_RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-basis")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("AGPL-3.0-or-later", ("agpl3-header",)),
    ("LGPL-3.0-or-later", ("lgpl3-header",)),
    ("LGPL-2.1-or-later", ("lgpl21-header",)),
    ("GPL-3.0-or-later", ("gpl3-header",)),
    ("GPL-2.0-or-later", ("gpl2-header",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-header",)),
    ("BSL-1.0", ("boost-ref",)),
    ("CC0-1.0", ("cc0-deed",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("Apache-2.0", ("apache-ref",)),
    ("LicenseRef-BSD", ("bsd-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref2",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
)
#: Sentences end at these marks before white space, a quote or the end of the text.
ENDS = r"""[.;:!?]+["')]*(?:[ \t\r\n\f]+|\z)"""
LINES = ENDS + r"|[\r\n]+"
#: A line end before a line without letters and digits.
BLANK = r"(?>\r\n|\r|\n)[^a-z0-9\r\n]*+(?=[\r\n])"
#: Each known sentence has one of these, so a text without any has no known sentence.
ANCHORS = ("licen", "permission", "copyright", "redistribut", "warrant", "free software", "public domain", "2")


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _pieces(text: str) -> list[str]:
    """A text's normalised sentences."""
    return [p for p in map(normal, re.split(ENDS.replace(r"\z", r"\Z"), text)) if p]


#: Normalised sentences and their identifiers; the pieces of a known sentence that holds ends are numbered from the second on.
KNOWN: dict[str, str] = {}
for _name, _sentence in SENTENCES.items():
    for _n, _piece in enumerate(_pieces(_sentence)):
        KNOWN.setdefault(_piece, _name if _n == 0 else f"{_name}.{_n + 1}")  # a piece of several sentences keeps its first name
#: Licences and the identifiers that stand for them.
RULES = tuple((lic, tuple(KNOWN[p] for k in seq for p in _pieces(SENTENCES[k]))) for lic, seq in _RULES)
assert len({seq for _, seq in RULES}) == len(RULES) and all(any(a in s for a in ANCHORS) for s in KNOWN)


def _ids(text: Column, ends: str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    sentences = F.transform(F.split(text, ends, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(F.transform(sentences, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())


def _matched(ids: Column) -> Column:
    """Licences whose rules occur, in the rules' order, each once."""
    marks = lambda names: "".join(f"<{n}>" for n in names)
    rules = F.array(*(F.struct(F.lit(lic).alias("lic"), F.lit(marks(seq)).alias("seq")) for lic, seq in RULES))
    none = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"), F.expr("cast(array() as array<string>)").alias("got"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.struct(F.replace(acc["left"], rule["seq"], F.lit("<>")).alias("left"), F.array_append(acc["got"], rule["lic"]).alias("got"))
        return F.when(F.contains(acc["left"], rule["seq"]), hit).otherwise(acc)

    return F.aggregate(rules, none, step, lambda acc: acc["got"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, sentences (identifiers in text order, line ends read as sentence ends) and licenses.

    licenses are those of any reading, without repeats, sorted. Null and empty texts have none. Repeated rows give
    repeated rows; other columns are left out. No shuffle: each row is on its own.
    """
    d = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    some = F.lit(False)
    for a in ANCHORS:
        some = some | F.contains("text", F.lit(a))
    empty = F.expr("cast(array() as array<string>)")
    joined = F.regexp_replace("text", r"[\r\n]+", " ")
    parted = F.regexp_replace(F.regexp_replace("text", BLANK, ". "), r"[\r\n]+", " ")
    read = F.when(some, F.struct(_ids(F.col("text"), LINES).alias("a"), _ids(joined, ENDS).alias("b"), _ids(parted, ENDS).alias("c")))
    d = d.select(id_col, read.alias("ids"))
    found = F.when(F.col("ids").isNotNull(), F.array_sort(F.array_union(F.array_union(_matched(F.col("ids.a")), _matched(F.col("ids.b"))), _matched(F.col("ids.c")))))
    return d.select(id_col, F.coalesce("ids.a", empty).alias("sentences"), F.coalesce(found, empty).alias("licenses"))


def oracle(table: str) -> str:
    """The same for DuckDB: doc_id, sentences and licenses as lists."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    ids = lambda text, ends: f"list_filter(list_transform(string_split_regex({text}, {quote(ends)}), lambda s: {known}[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"
    steps, last = [], "i"
    for n, (lic, seq) in enumerate(RULES):
        mark = quote("".join(f"<{x}>" for x in seq))
        steps.append(f"r{n} AS (SELECT row, replace(seq, {mark}, '<>') AS seq, CASE WHEN contains(seq, {mark}) THEN list_append(got, {quote(lic)}) ELSE got END AS got FROM {last})")
        last = f"r{n}"
    # a run of line ends with lines without letters and digits between them ends a sentence
    lf = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
    parted = rf"regexp_replace(regexp_replace({lf}, '\n(?:[^a-z0-9\n]*\n)+', '. ', 'g'), '\n', ' ', 'g')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, lower(coalesce(text, '')) AS text FROM {table}),
        s AS (SELECT row, doc_id, {ids("text", LINES)} AS a, {ids(r"regexp_replace(text, '[\r\n]+', ' ', 'g')", ENDS)} AS b, {ids(parted, ENDS)} AS c FROM d),
        i AS (SELECT row, list_aggregate(list_transform(x, lambda y: '<' || y || '>'), 'string_agg', '') AS seq, []::VARCHAR[] AS got FROM (SELECT row, a AS x FROM s UNION ALL SELECT row, b FROM s UNION ALL SELECT row, c FROM s)),
        {", ".join(steps)},
        g AS (SELECT row, list_sort(list_distinct(flatten(list(got)))) AS licenses FROM {last} GROUP BY row)
        SELECT doc_id, a AS sentences, licenses FROM s JOIN g USING (row)
    """
