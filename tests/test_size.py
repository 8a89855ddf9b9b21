"""Plans and steps that must grow no faster than their input."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from segmill.functions import text
from segmill.operators import classify, formulas, layout, paragraphs, validate
from segmill.plans import queries
from segmill.sources import pages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_glyphs_are_not_shuffled(spark):
    p = plan(queries.QUERIES["paragraph_assembly"](spark, SF))
    assert p.count("Exchange") == 1 and "Sort" not in p  # of texts, before they are glyphs
    assert p.index("Generate") < p.index("Exchange")


def test_pages_together(spark):
    """Pages in place give what shuffled ones do, whatever the batches."""
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("ab c.\n") for _ in range(rnd.choice([1, 30, 300, 900])))) for i in range(60)]
    g = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).select("doc_id", F.posexplode(F.split("text", "")).alias("seq", "text")).where("text != ''")
    g = g.select("doc_id", F.lit(0).alias("page_id"), F.lit(0).alias("container"), "seq", "text", F.when(F.col("seq") % 7 == 3, "CMMI10").otherwise("Times").alias("font"), F.lit(10.0).alias("size"), (F.col("seq") % 60 * 5.0).alias("x0"), (700 - F.expr("seq div 60") * 12.0).alias("y0"),
        (F.col("seq") % 60 * 5.0 + 5).alias("x1"), (710 - F.expr("seq div 60") * 12.0).alias("y1"), F.lit(2).alias("cls"), F.lit(True).alias("upright"), F.lit("0 g ").alias("color"), F.lit(600.0).alias("page_width"))
    want = sorted(map(repr, paragraphs.assemble(g).collect()))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for n in ("7", "10000"):
            spark.conf.set(key, n)
            assert sorted(map(repr, paragraphs.assemble(g, together=True).collect())) == want
    finally:
        spark.conf.set(key, was)


def test_texts_are_checked_once(spark):
    """Texts are read once, for rows and for counts of issues, and each pattern stands once for each text."""
    p = plan(queries.QUERIES["validation_issue_counts"](spark, SF))
    assert p.count("FileScan") == 1 and "Union" not in p
    p = spark.range(1).select(validate.issues(F.lit("a"), F.lit("b")).alias("i"))._jdf.queryExecution().analyzed().toString()
    assert p.count(validate._NUMBER) == 2 and p.count(validate._REFERENCE) == 1 and p.count("btrim") == 2


def plain_checks(s, t):
    s, t = s or "", t or ""
    n, m = len(s.strip()), len(t.strip())
    if m == 0:
        return [("empty", "error", "")]
    number, out = r"\b\d+(?:\.\d+)?%?\b", []
    a, b = (re.findall(r"</?b\d+>", x) for x in (s, t))
    if a != b:
        out.append(("placeholders", "error", "".join(a) + "|" + "".join(b)))
    if n and not 0.3 <= m / n <= 3:
        out.append(("short" if m / n < 0.3 else "long", "warning", f"{m}/{n}"))
    if lost := sorted({x for x in re.findall(number, s)} - set(re.findall(number, t))):
        out.append(("numbers", "warning", ",".join(lost)))
    for r in sorted(set(re.findall(r"(?i)(?:Figure|Table|Fig\.?)\s*\d+(?:[.-]\d+)?", s))):
        out += [("reference", "warning", f"{x} from {r}") for x in re.findall(r"\d+(?:[.-]\d+)?", r) if x not in t]
    if n > 20 and m > 2.5 * n:
        out.append(("hallucination", "warning", f"{m}/{n}"))
    return out


def test_checks_on_odd_texts(spark):
    texts = [None, "", " \u3000\n", "a", "15", "x15 15 15.5% 1.2.3 \u0661\u0662", "Fig. 3-2, FIGURE 7 table 1.2 fig2 Tabl 3", "<b0></b0> 15 mm", "\u2003Table 4.5\x85", "y" * 40, "y" * 200, "é 7ème 7 è"]
    rows = [(i * 100 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    got = {r.segment_id: [tuple(x) for x in r.issues] for r in validate.validate(spark.createDataFrame(rows, "segment_id long, source string, translation string")).collect()}
    assert got == {i: plain_checks(a, b) for i, a, b in rows}


def test_pages_grow_together(spark):
    """Pages of all sizes are folded in few calls, each as if alone."""
    rnd, rows = random.Random(8), []
    for page in range(300):
        for i in rnd.sample(range(50), rnd.choice([1, 1, 2, 3, 4, 7, 40])):
            x, y = rnd.choice([0.0, 3.0, 40.0, 200.0]), rnd.randrange(60) * 1.0
            rows.append((page, i, x, x + rnd.randrange(1, 150), y, y + rnd.randrange(1, 20), rnd.random() < 0.4))
    df = spark.createDataFrame(rows, "page_id long, para_id long, x0 double, x1 double, y0 double, y1 double, brk boolean")
    grown = layout.column_edges_in_order(df.repartition(5))
    assert "FlatMapGroups" not in plan(grown)
    want = {}
    for page in range(300):
        p = sorted([k, *rest] for q, k, *rest in rows if q == page)
        for a in p:
            if not a[5]:
                edge = max((b[2] for b in p if abs(b[1] - a[1]) <= 5 and (b[5] or b[2] > a[2] + 30)), default=a[2])
                stop = min((b[1] - 5 for b in p if b[1] > a[1] + 10 and b[4] >= a[3] - 2 and b[3] <= a[4] + 2), default=edge)
                a[2] = max(a[2], min(edge, stop))
        want |= {(page, a[0]): a[2] for a in p}
    assert {(r.page_id, r.para_id): r.right for r in grown.collect()} == want


def test_runs_of_arrays(spark):
    """Runs from arrays of a text are those of the plain rule, in parts of the batch."""
    rnd, widths, names = random.Random(1), {"i": 0.25, "m": 0.75, " ": 0.25}, ["t", "n"]
    first = dict.fromkeys("abcdeim .,-", "t")
    chars = formulas._Chars(dict.fromkeys(first, 0), 1, widths, 0.5)
    for _ in range(500):
        text = "".join(rnd.choice(["a", "i", "m", "é", "α", " ", " ", "{v1}", "{ V 2 }", "{v9}", "{v }", "{", "\n", "word ", "𝒜"]) for _ in range(rnd.choice([0, 1, 5, 60, 300])))
        x, x1, size, of = rnd.choice([50.0, 60.0, 300.0]), rnd.choice([50.0, 120.0, 400.5]), rnd.choice([8.0, 9.3]), {1: (12.0, 2.0), 2: (30.5, 0.0)} if rnd.random() < 0.8 else {}
        got = [(n, at, names[f] if f >= 0 else None, s, vid) for n, at, f, s, vid in zip(*formulas._runs(text, x, 50.0, x1, size, chars, of), strict=True)]
        assert got == list(formulas.runs_of(text, x, 50.0, x1, size, lambda c: first.get(c, "n"), lambda c: widths.get(c, 0.5), of))


def test_guards_hide_no_match(spark):
    """A pattern behind its guard fits the lines that it fits alone."""
    rnd, bits = random.Random(2), ["a", "B", "1", "23", "٣", " ", "     ", ".", "....", ". ", ",", "(", "1999)", "[", "]", "\x08", "�", "─", " ", " ", "xiv", "ISBN", "Doi.org", "HTTP://", "Ab, c (1999)", "1. ", "\x85", "é", "\n"]
    lines = ["1234", "[12] x", "a\u2002 12", "a\u2003xiv", "\u2500\u2500 12", "a      7", "Ab, c (1999)", "12. x", "𝟏𝟏𝟏𝟏", "𝟏𝟏𝟏𝟏 ", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9))) for _ in range(4000))]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    patterns = [*classify._NEEDED, *classify._COUNTED.values()]
    x = F.col("x")
    got = df.select(*[(classify._fits(x, p) != x.rlike(p)).cast("int").alias(f"c{i}") for i, p in enumerate(patterns)], *[x.rlike(p).cast("int").alias(f"h{i}") for i, p in enumerate(patterns)])
    total = got.agg(*(F.sum(c).alias(c) for c in got.columns)).first().asDict()
    assert {p: total[f"c{i}"] for i, p in enumerate(patterns) if total[f"c{i}"]} == {}
    assert [p for i, p in enumerate(patterns) if not total[f"h{i}"]] == []


def test_scan_by_batches(spark):
    """Pages of many files are one Arrow batch; broken, empty and null files are as before."""

    def reader(data):
        for x in data.decode().split("|"):
            if x == "bad":
                raise ValueError(x)
            if x:
                yield 6.0, 8.0, 0, x, [(1, [0.0, 0.0, 1.0, 2.0])] if x == "i" else []

    files = spark.createDataFrame([(1, b"a|i"), (2, b""), (3, None), (4, b"a|bad"), *((i, b"x") for i in range(5, 200))], "doc_id long, content binary").coalesce(1)
    out = pages.scan(files, reader)
    assert "MapInPandas" not in plan(out)
    got = {(r.doc_id, r.pageno): (r.text, r.error, len(r.blocks or [])) for r in out.collect()}
    want = {("1", 0): ("a", None, 0), ("1", 1): ("i", None, 1), ("4", 0): ("a", None, 0), ("4", -1): (None, "ValueError: bad", 0)}
    assert got == want | {(str(i), 0): ("x", None, 0) for i in range(5, 200)}


def test_texts_by_parts(spark):
    """A batch of texts is not made Python strings at once."""
    seen = []
    texts = pa.array(["e\u0301", None, ""] * 400)
    assert text._by_part(texts, lambda x: seen.append(x) or x).equals(texts) and len(seen) == 800
    df = spark.createDataFrame([(x,) for x in texts.to_pylist()], "x string").coalesce(1).select(text.nfc("x").alias("y"), text.html_unescape("x").alias("z"))
    assert sorted(map(repr, df.distinct().collect())) == sorted(["Row(y='é', z='e\u0301')", "Row(y=None, z=None)", "Row(y='', z='')"])
    assert "pandas" not in str(text.nfc.func.__annotations__)
