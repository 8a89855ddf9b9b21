import re

import pytest

from segmill.llm import common, license, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
TEXTS = [
    None, "", "nothing here", "secret=token:abcdefg", 'é😀 Password = "hunter22" x', "token=token=abcdef token: ab API_KEY:'abc123XYZ'",
    "AKIA" + "A1" * 8 + " AKIAshort AKIAAKIA" + "B2" * 10, "x" + "0123456789abcdef" * 3 + "g" + "f" * 24 + "G", "token = " + "ab12" * 12, "token = " + "ab12" * 12,
    "secret: changeme1 " * 300, "logo_" + "Zz9+" * 7 + "==", "passwd:" + "z" * 70_000,
]
DOCS = [(i, t, f"o{i % 4}" if i % 5 else None, "n") for i, t in enumerate(TEXTS)] + [(1, "", "o1", "n"), (None, "token = " + "ab12" * 12, "o9", "n")]
# one owner: copied into many repositories, and into many places of few
DOCS += [(100 + i, "secret = copied" + "c3" * 9, "one", "n") for i in range(12)] + [(200 + i, "secret = kept" + "k4" * 9 + "\nsecret = kept" + "k4" * 9, "one", "n") for i in range(10)] + [(200, "secret = kept" + "k4" * 9, "one", "n")]


def base(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def candidates(t):
    t, out = t or "", set()
    out |= {(m.end() - len(m[2]), m.end(), m[2]) for m in ASSIGN.finditer(t) if len(m[2]) >= 8}
    out |= {(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t)}
    return {c for c in out if re.search("[A-Za-z]", c[2]) and re.search("[0-9]", c[2])}


@pytest.mark.parametrize(("part", "least"), [(512, 1000), (7, 2)])
def test_secrets(spark, monkeypatch, part, least):
    monkeypatch.setattr(secrets, "_PART", part)
    monkeypatch.setattr(common, "HOT_LEAST", least)
    got = secrets.scan(spark.createDataFrame(DOCS, "doc_id long, text string, source string, owner string")).collect()
    owners, repositories = {}, {}
    for i, t, o, _ in DOCS:
        for c in candidates(t):
            owners.setdefault(c[2], set()).add(o or "")
            repositories.setdefault(c[2], set()).add(i)
    want = []
    for i, t, _, _ in DOCS:
        added = sorted((s, 3 if len(owners[v]) <= 2 and len(repositories[v]) <= 10 else 4, e) for s, e, v in candidates(t))
        want.append((i, base(t), added))
    assert {x for w in want for x in (y[1] for y in w[2])} == {3, 4}
    assert sorted(((r.doc_id, sorted(map(tuple, r.base)), sorted(map(tuple, r.added))) for r in got), key=str) == sorted(want, key=str)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


MIT = [license.SENTENCES[k] for k in ("mit-grant", "mit-notice", "as-is")]
CASES = [
    (None, "", ""), ("", "", ""), ("plain text. with a License in it", "", ""),
    ("x\nReleased under the MIT License.\ny", "mit-ref", "MIT"),
    ("Title\n\n" + ":\n".join(MIT) + ".", "mit-grant,mit-notice,as-is", "MIT"),
    ("Intro. " + re.sub(" ", "\n", ". ".join(MIT)) + ".", "", "MIT"),
    (MIT[1] + ". " + MIT[0] + ":", "mit-notice,mit-grant", ""),
    ("Licensed under CC BY-NC 4.0. licensed UNDER the apache license, version 2.0!", "cc-by-nc-ref,apache-ref", "Apache-2.0,CC-BY-NC-4.0"),
    ("I say: this is licensed under the MIT License or so.", "", ""),
    ("long text " * 20_000 + ". Released under the MIT License", "mit-ref", "MIT"),
]


def test_licenses(spark):
    rows = [(i, t, "s") for i, (t, _, _) in enumerate(CASES)] + [(3, CASES[3][0], None)]
    got = {r.doc_id: (",".join(r.sentences), ",".join(r.licenses)) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string, sentences string")).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(CASES)}
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
