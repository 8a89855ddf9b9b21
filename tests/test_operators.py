import pytest
from pyspark.sql import functions as F

from segmill.operators import classify, engines, jobs, layout, outline, paragraphs, state, terms, validate
from segmill.sources import jsonl

PAGES = {
    "TOC": "Contents\nChapter 1 .......... 5\nChapter 2 .......... 20\n",
    "INDEX": "Index\nterm, 11",
    "NOMENCLATURE": "Nomenclature\n" + "\n".join(f"a{i}\nthe meaning of it" for i in range(8)),
    "REFERENCES": "References\n" + "\n".join(f"[{i}] Author, A. (20{i:02d}). https://doi.org/{i}" for i in range(6)),
    None: "A line of prose.\nAnother one with 5 words.",
}

def test_page_kinds(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(PAGES.values())] + [(9, None), (10, "  \n")], "page_id int, text string")
    got = {r.page_id: r.kind for r in classify.page_kinds(df).collect()}
    assert got == dict(enumerate(PAGES)) | {9: None, 10: None}
    plan = classify.page_kinds(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

def test_two_plans_agree(spark):
    lines = [(p, i, x) for p, text in enumerate(PAGES.values()) for i, x in enumerate(text.split("\n"))]
    rows = spark.createDataFrame(lines, "page_id int, pos int, line string")
    texts = spark.createDataFrame(list(enumerate(PAGES.values())), "page_id int, text string")
    one = {tuple(r) for r in classify.page_kinds_by_line(rows).collect()}
    assert one == {tuple(r) for r in classify.page_kinds(texts).select("page_id", "kind", "detail").collect()}

@pytest.mark.parametrize(("source", "translation", "codes"), [
    ("Hello", "", ["empty"]), ("Hello", "  ", ["empty"]), ("a <b0></b0>", "a <b0></b0>", []), ("a <b0></b0>", "a", ["placeholders", "short"]),
    ("a long source text", "ab", ["short"]), ("ab", "a long translation", ["long"]), ("15 mm and 45.5%", "15 mm", ["numbers"]),
    ("see Figure 3-2 and Table 1", "xem Hình 3-2 và", ["numbers", "reference"]), ("x" * 21, "y" * 60, ["hallucination"]), ("góc15mm", "góc", []), (None, "a", []),
])
def test_validation(spark, source, translation, codes):
    df = spark.createDataFrame([(1, source, translation)], "segment_id int, source string, translation string")
    assert [i.code for i in validate.validate(df).first().issues] == codes

def test_state(spark):
    make = lambda rows: spark.createDataFrame(rows, "segment_id int, source_text string")
    s = state.new_state(make([(0, "a"), (1, "b"), (2, "c")]))
    log = spark.createDataFrame([(0, 1, "completed", "A"), (1, 2, "failed", "e1"), (1, 3, "failed", "e2"), (2, 4, "failed", "x"), (2, 5, "completed", "C"), (2, 6, "seen", "?")], "segment_id int, seq int, event string, payload string")
    s = state.fold_events(s, log)
    rows = {r.segment_id: r for r in s.collect()}
    assert (rows[0].status, rows[0].translation, rows[1].status, rows[1].retry_count, rows[1].error, rows[2].status, rows[2].retry_count, rows[2].error) == ("completed", "A", "failed", 2, "e2", "completed", 1, "x")
    assert [r.segment_id for r in state.pending(s).collect()] == [1]
    again = state.reconcile(s, make([(0, "a"), (1, "b"), (2, "c")]))
    assert sorted(again.collect()) == sorted(s.collect())
    new = {r.segment_id: r for r in state.reconcile(s, make([(0, "changed"), (3, "new")])).collect()}
    assert (new[0].status, new[0].translation, new[0].timestamp, new[3].status, new[1].status) == ("pending", "", 1.0, "pending", "failed")
    assert set(r.segment_id for r in state.reconcile(s, make([(0, "a")]), prune=True).collect()) == {0}
    assert {r.status: r.segments for r in state.stats(s).collect()} == {"completed": 2, "failed": 1, "total": 3}
    assert state.is_complete(s).first().is_complete is False and state.is_complete(s.limit(0)).first().is_complete is True
    assert [r.line for r in state.export(s).orderBy("segment_id").collect()] == ['{"src":"a","dst":"A"}', '{"src":"c","dst":"C"}']
    assert {r.segment_id: r.model for r in state.skip_trivial(state.new_state(make([(0, " x\n"), (1, "xy")]))).collect()} == {0: "skip", 1: ""}

def test_terms(spark):
    g = spark.createDataFrame([("Mandible", "hàm dưới", "", 0, 1), ("MANDIBLE", "xương hàm dưới", "n", 1, 1), ("maxilla", "hàm trên", None, 0, 2), (" ", "x", "", 1, 9), ("a", None, "", 1, 9)], "en string, vi string, notes string, tier int, line_no int")
    m = terms.merge_glossaries(g)
    assert {(r.key, r.vi) for r in m.collect()} == {("mandible", "xương hàm dưới"), ("maxilla", "hàm trên")}
    assert terms.prompt_context(m).first().context == f"{terms.HEADER}\n  MANDIBLE = xương hàm dưới (n)\n  maxilla = hàm trên"
    assert terms.prompt_context(m.limit(0)).first().context == ""
    added = terms.add_terms(m, spark.createDataFrame([("Maxilla", "mới", "")], "en string, vi string, notes string"))
    assert {r.key: r.vi for r in added.collect()}["maxilla"] == "mới"
    rows = spark.createDataFrame([("a<b0>", "x", 1), ("b", " ", 2), ("c", "C1", 3), ("c", "C2", 4), ("d<b1></b1>", "<b1></b1>D", 5)], "src string, dst string, line_no int")
    memory = terms.clean_memory(rows)
    assert {tuple(r) for r in memory.collect()} == {("c", "C2"), ("d<b1></b1>", "<b1></b1>D")}
    seg = spark.createDataFrame([(0, "c"), (1, "z"), (2, "z"), (3, " ")], "id int, source string")
    assert {(r.id, r.translation, r.is_hit) for r in terms.translate(seg, memory).collect()} == {(0, "C2", True), (1, "z", False), (2, "z", False), (3, " ", False)}
    assert [tuple(r) for r in terms.misses(seg, memory, order_col="id").collect()] == [("z", 1)]

def test_outline(spark):
    o = spark.createDataFrame([(1, 1, 1, "Preface", 1), (1, 2, 1, " Chapter 1\nx", 3), (1, 3, 2, "2 - Two", 10), (1, 4, 2, "3 – dup", 10), (1, 5, 3, "Chapter 9", 12), (1, 6, 1, "Index", 99), (1, 7, 1, "Index", 20), (2, 1, 1, "1 - One", 1)], "doc_id int, ord int, level int, title string, page int")
    got = outline.chapters(o, spark.createDataFrame([(1, 25), (2, 7)], "doc_id int, total_pages int")).orderBy("doc_id", "index").collect()
    assert [(r.doc_id, r.title, r.start_page, r.end_page) for r in got] == [(1, "Front Matter", 1, 2), (1, "Chapter 1 x", 3, 9), (1, "2 - Two", 10, 19), (1, "Index", 20, 25), (2, "1 - One", 1, 7)]
    parts = spark.createDataFrame([(1, 1, "part_one", 10, True), (1, 2, "gone", 5, False), (1, 3, "three", 4, True)], "book_id int, idx int, stem string, page_count int, exists boolean")
    subs = spark.createDataFrame([(1, 1, 1, 1, "s", 2), (1, 2, 1, 1, "no", 1), (1, 3, 1, 1, "t", 1)], "book_id int, idx int, ord int, level int, title string, page int")
    assert {(r.level, r.title, r.page) for r in outline.merged_outline(parts, subs).collect()} == {(1, "part one", 1), (2, "s", 2), (1, "three", 11), (2, "t", 11)}

INK = [
    ({i: (-2.2, 7.8) for i in range(4)}, 3, None, [0, 11, 22, 33]),
    ({0: (-2.2, 7.8), 1: (-12, 7.8), 2: (-2.2, 7.8)}, 2, None, [0, 11, 30.8]),
    ({0: (-2.2, 7.8), 1: (-2.2, 16)}, 1, None, [0, 18.2]),
    ({}, 0, None, [0]), ({}, 2, None, [0, 11, 22]), ({0: (-2.2, 7.8), 1: (-2.2, 16)}, 1, 0.0, [0, 11]),
    ({0: (-12, 7.8), 1: (-12, 7.8), 2: (-2.2, 7.8)}, 2, 4.0, [0, 13, 26]),
]

@pytest.mark.parametrize(("ink", "lines", "budget", "want"), INK)
def test_line_offsets(spark, ink, lines, budget, want):
    i = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in ink.items()], "para_id int, lidx int, lo double, hi double")
    p = spark.createDataFrame([(1, lines, budget, 10.0, 1.1)], "para_id int, lines int, budget double, size double, leading double")
    assert [r.offset for r in layout.line_offsets(i, p).orderBy("line").collect()] == pytest.approx(want)

def test_scanned_and_rules(spark):
    df = spark.createDataFrame([(1, [(1, [0.0, 0.0, 80.0, 80.0])]), (2, [(1, [0.0, 0.0, 20.0, 20.0])]), (3, [(0, [0.0, 0.0, 80.0, 80.0])]), (4, [])], "id int, b array<struct<type: int, bbox: array<double>>>")
    assert [r[0] for r in df.orderBy("id").select(layout.is_scanned(F.col("b"), F.lit(10000.0))).collect()] == [True, False, False, False]
    assert spark.range(1).select(F.round(layout.scaled_width(F.lit(4.05), F.array(F.lit(0.1), F.lit(0.0))), 6)).first()[0] == 0.405
    inv = spark.range(1).select(layout.inverse_matrix(F.array(*map(F.lit, [2.0, 0.0, 0.0, 4.0, 6.0, 8.0])))).first()[0]
    assert inv == [0.5, -0.0, -0.0, 0.25, -3.0, -2.0]

def test_glyph_classes(spark):
    boxes = spark.createDataFrame([(1, 0, 10.0, 10.0, 50.0, 50.0, 0.9, 1), (1, 1, 30.0, 30.0, 80.0, 80.0, 0.5, 1), (1, 2, 60.0, 60.0, 90.0, 90.0, 0.3, 0), (1, 3, 0.0, 0.0, 99.0, 99.0, 0.25, 0)], "page_id int, seq int, x0 double, y0 double, x1 double, y1 double, conf double, cls int").withColumns({"width": F.lit(100.0), "height": F.lit(100.0)})
    b = layout.ranked_boxes(boxes, {0: "figure", 1: "text"})
    points = [(20, 70, "a", 2), (40, 60, "a", 2), (70, 60, "a", 3), (70, 30, "a", 0), (5, 5, "a", 1), (20, 70, "•", 0)]
    g = spark.createDataFrame([(1, i, float(x), float(y), s) for i, (x, y, s, _) in enumerate(points)], "page_id int, seq int, x0 double, y0 double, text string").withColumns({"width": F.lit(100.0), "height": F.lit(100.0)})
    out = layout.glyph_classes(g, b)
    assert [r.cls for r in out.orderBy("seq").collect()] == [p[3] for p in points]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    kept = layout.glyph_classes(g, b, spark.createDataFrame([(1,)], "page_id int"))
    assert {r.cls for r in kept.collect()} == {0}

def _glyphs(spark, texts, **over):
    rows = []
    for n, (x, y, text, font, size, cls) in enumerate(texts):
        rows.append((1, 1, 0, n, text, font, float(size), float(x), float(y), x + 5.0, y + float(size), cls, True, "0 g ", 600.0))
    return spark.createDataFrame(rows, "doc_id long, page_id long, container long, seq int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, cls int, upright boolean, color string, page_width double")

def test_paragraphs(spark):
    word = lambda s, x, y, font="Times", size=10, cls=2: [(x + 5 * i, y, c, font, size, cls) for i, c in enumerate(s)]
    page = word("one", 50, 700) + word("two", 70, 700) + word("three", 50, 688) + word("x=", 85, 688, "CMMI10") + word("end.", 98, 688) + word("Head", 50, 600, "Times-Bold", 14, 3)
    got = paragraphs.assemble(_glyphs(spark, page)).orderBy("kind", "para_id").collect()
    assert [(r.kind, r.text) for r in got] == [("formula", "x="), ("paragraph", "one two three {v0} end."), ("paragraph", "Head")]
    assert got[1].brk and not got[2].brk and got[2].is_bold and (got[1].x0, got[1].x1) == (50.0, 118.0)
    assert paragraphs.assemble(_glyphs(spark, page).limit(0)).count() == 0

def test_wrap():
    w = lambda s, x1=50.0: paragraphs.wrap(s, lambda c: 2.0 if len(c) > 1 else 0.5, 0.0, 0.0, x1, 10.0)
    assert w("aaaa bbbb cccc") == ["aaaa bbbb", "cccc"] and w("") == [""] and w("a" * 12 + " b") == ["a" * 12, "b"]
    assert w("aaa {v0} {v1} b") == ["aaa {v0}", "{v1} b"]

def test_engines(spark):
    def one(text):
        if "!" in text:
            raise ValueError("bad")
        return "" if "?" in text else f"1:{text}"

    def two(text):
        if "!!" in text:
            raise OSError("worse")
        return f"2:{text}"

    df = spark.createDataFrame([(0, "a"), (1, "b!"), (2, "c!!"), (3, "d?"), (4, " "), (5, "a"), (6, None)], "id int, source string")
    got = {r.id: (r.translation, r.error) for r in engines.translate_all(df, [one, two]).collect()}
    assert got == {0: ("1:a", None), 1: ("2:b!", None), 2: (None, "one: bad; two: worse"), 3: ("2:d?", None), 4: (" ", None), 5: ("1:a", None), 6: (None, None)}
    now, slept = [0.0], []
    lim = engines.Limiter(0.5, lambda: now[0], slept.append)
    lim.wait()
    now[0] = 0.2
    lim.wait()
    assert slept == [pytest.approx(0.3)]
    assert engines.engine_options({"a": "1", "b": "2"}, {"a": "", "b": "3"}, {"b": "4"}) == {"a": "1", "b": "4"}

def test_jsonl(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"en":"A","vi":"x"}\n\n{bad\n{"en":1,"vi":"y"}\n{"vi":"z"}\n{"en":"B ","vi":" w","notes":"n"}\n[1]\n')
    lines = jsonl.numbered_lines(spark, str(tmp_path / "g.jsonl"))
    p = {r.line_no: r.problem for r in jsonl.parsed(lines, ["en", "vi"]).collect()}
    assert p == {1: None, 3: "invalid JSON", 4: "type en", 5: "missing en", 6: None, 7: "invalid JSON"}
    assert {(r.en, r.vi, r.notes) for r in jsonl.glossary_rows(lines).collect()} == {("A", "x", ""), ("B", "w", "n")}
    e = jsonl.first_error(jsonl.parsed(lines, ["en", "vi"]), ["file"]).first()
    assert (e.line_no, e.problem) == (3, "invalid JSON")
    with pytest.raises(Exception, match="line 3: invalid JSON"):
        jsonl.strict(jsonl.parsed(lines, ["en", "vi"])).collect()
    s = jsonl.profile_summary(lines, ["file"]).first()
    assert (s.terms, s.error) == (1, "Line 3 invalid JSON")
    jsonl.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), f"{tmp_path}/out", "n")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a", "b"]

def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"xx%PDF-1.7")
    (tmp_path / "b.pdf").write_bytes(b"x" * 1024 + b"%PDF-")
    got = {r.name: r.ok for r in spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), jsonl.is_document(F.col("content"), F.col("path")).alias("ok")).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}
    names = spark.createDataFrame([("https://x",), ("gone.pdf",), ("here.pdf",)], "path string")
    assert [r.path for r in jsonl.missing(names, names.where("path = 'here.pdf'")).collect()] == ["gone.pdf"]
    assert {r.name for r in jsonl.files(spark, str(tmp_path), "*.pdf").collect()} == {"a.pdf", "b.pdf"}

def test_jobs(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "f int, pages int")
    assert jobs.page_total(df).first().pages == 0 and jobs.page_total(df.where("f = 1")).first().pages == 5 and jobs.page_total(df.limit(0)).first().pages == 0
    assert spark.range(1).select(jobs.fraction(F.lit(1), F.lit(1), F.lit(2), F.lit(3))).first()[0] == pytest.approx(0.5)

