"""Each licence rule on the text it stands for, plain and as files have it."""

import textwrap

import duckdb
import pandas as pd

from segmill.llm import license


def test_rules_fire(spark):
    texts = [". ".join(license.SENTENCES[k] for k in seq) + "." for _, seq in license._RULES]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: [lic] for i, (lic, _) in enumerate(license._RULES)}


def test_files(spark):
    s = license.SENTENCES
    wrap = lambda *x: "\n\n".join(textwrap.fill(y, 72) for y in x)
    owner = "Copyright (c) 2020 Name"
    mit = wrap("MIT License", owner, s["mit-grant"] + ":", s["mit-notice"] + ".", s["as-is"] + ".")
    bsd = [owner, s["bsd-grant"] + ":", "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + ".", "3. " + s["bsd-names"] + "."]
    texts = {
        "MIT": [mit, mit.replace("\n", "\r\n"), "/*\n" + textwrap.indent(mit, " * ", lambda _: True) + "\n */"],
        "ISC": [wrap("ISC License", owner, s["isc-grant"] + ".", s["as-is"] + ".")],
        "BSD-3-Clause": [wrap(*bsd)],
        "BSD-2-Clause": [wrap(*bsd[:-1])],
        "GPL-3.0-or-later": [wrap(s["gpl3-header"] + ".")],
        "GPL-2.0-or-later": [wrap(s["gpl2-header"] + "."), "# " + wrap(s["gpl2-header"]).replace("\n", "\n# ")],
        "LGPL-2.1-or-later": [wrap(s["lgpl21-header"] + ".")],
        "AGPL-3.0-or-later": [wrap(s["agpl3-header"] + ".")],
        "Zlib": [wrap(owner, s["zlib-as-is"] + ".", s["zlib-grant"] + ":")],
        "Unlicense": [wrap(s["unlicense"] + ".")],
        "LicenseRef-BSD": ["Licensed under the BSD License."],
        "MPL-2.0": [wrap(s["mpl2-ref"] + ".")],
        "": ["This program is free software: you may not.", "Mozilla Public License, v. 2.0", "2.0", owner + "\n\n" * 20_000],
    }
    rows = [(x, lic) for lic, xs in texts.items() for x in xs]
    got = license.scan(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: ",".join(r.licenses) for r in got} == {i: lic for i, (_, lic) in enumerate(rows)}
    docs = pd.DataFrame({"doc_id": range(len(rows)), "text": [x for x, _ in rows]})  # noqa: F841  read by the SQL
    known = duckdb.connect().execute(f"SELECT doc_id, licenses FROM ({license.oracle('docs')})").fetchall()
    assert {i: ",".join(x) for i, x in known} == {i: lic for i, (_, lic) in enumerate(rows)}
