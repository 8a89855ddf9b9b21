"""Stores, scans, runs and folds that SQL does not say, against what they should give."""

import random

import pytest
from pyspark.sql import functions as F

from segmill.functions import text as t
from segmill.operators import content, engines, formulas, jobs, layout, paragraphs, state, terms
from segmill.sources import jsonl, pages, store


def test_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/s", "k long, v string")
    assert s.version() is None and s.read().count() == 0
    s.create()
    s.create()
    assert s.version() == 1
    s.write(spark.createDataFrame([(1, "a")], "k long, v string"))
    held = s.read()
    s.write(s.read().unionByName(spark.createDataFrame([(2, "b")], "k long, v string")))
    assert s.version() == 3 and s.read().count() == 2 and held.count() == 1 and not (tmp_path / "s/v00000001").exists()
    (tmp_path / "s/v00000009").mkdir()  # a version without its mark does not count
    assert s.version() == 3
    (tmp_path / "s/v00000004.done").touch()
    late = store.Store(spark, f"{tmp_path}/s", "k long, v string")
    late.version = lambda: 3  # another writer has been faster
    with pytest.raises(Exception, match="exist"):
        late.write(held)
    (tmp_path / "s/v00000004.done").unlink()
    s.clear()
    assert s.version() == 4 and s.read().count() == 0


def test_publish_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    store.publish(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt")
    assert (tmp_path / "b.txt").read_text() == "one" and not (tmp_path / ".b.txt.tmp").exists()
    (tmp_path / "a.txt").write_text("two")
    with pytest.raises(FileExistsError):
        store.publish(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt")
    store.publish(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", overwrite=True)
    assert (tmp_path / "b.txt").read_text() == "two"
    (tmp_path / "empty").write_text("")
    assert store.reusable(spark, f"{tmp_path}/a.txt") and not store.reusable(spark, f"{tmp_path}/a.txt", True)
    assert not store.reusable(spark, f"{tmp_path}/empty") and not store.reusable(spark, f"{tmp_path}/gone")
    (tmp_path / "env").write_text("# c\n\nA=1\nexport B = 'x y'\nC=\"q=r\"\nbad\n")
    assert store.environment(spark, f"{tmp_path}/env") == {"A": "1", "B": "x y", "C": "q=r"}
    one = spark.createDataFrame([("x",)], "path string")
    assert store.single(one).path == "x"
    for rows in (one.limit(0), one.union(one)):
        with pytest.raises(ValueError, match="expected one"):
            store.single(rows)
    log = spark.createDataFrame([("l1",)], "line string")
    store.append_lines(log, f"{tmp_path}/log")
    store.append_lines(log, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2


def test_page_scan(spark):
    def reader(data):
        if data == b"bad":
            raise ValueError("no pages")
        for x in data.split(b"\f"):
            yield 10, 20, 90, x.decode(), [(1, [0.0, 1.0, 2.0, 3.0])]

    files = spark.createDataFrame([("a", bytearray(b"p\fq\fr")), ("b", bytearray(b"bad")), ("c", None), ("d", bytearray(b""))], "doc_id string, content binary")
    got = sorted((r.doc_id, r.pageno, r.text, r.error) for r in pages.scan(files, reader).collect() if r.error is None)
    assert got == [("a", 0, "p", None), ("a", 1, "q", None), ("a", 2, "r", None), ("d", 0, "", None)]
    some = pages.scan(files, reader, F.lit("1,3-9")).orderBy("doc_id", "pageno").collect()
    assert [(r.doc_id, r.pageno) for r in some] == [("a", 0), ("a", 2), ("b", -1), ("d", 0)] and some[2].error == "ValueError: no pages"
    assert some[0].blocks[0].bbox == [0.0, 1.0, 2.0, 3.0] and some[0].rotate == 90

    def load():
        return lambda image: [(0, 0, len(image), 1, 0.5, 3), (1, 1, 2, 2, 0.9, 0)]

    images = spark.createDataFrame([("a", 0, bytearray(b"xyz")), ("a", 1, None)], "doc_id string, pageno int, image binary")
    assert [tuple(r) for r in pages.detected(images, "m", load).orderBy("seq").collect()] == [("a", 0, 0, 0.0, 0.0, 3.0, 1.0, 0.5, 3), ("a", 0, 1, 1.0, 1.0, 2.0, 2.0, pytest.approx(0.9), 0)]


def test_long_numbers(spark):
    specs = ["1-99999999999999999999", "99999999999999999999-1", "3", "", None, "2-x", "5-4"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(specs)], "i int, c string").orderBy("i")
    c = F.col("c")
    got = [tuple(r) for r in df.select(t.is_page_selection(c), t.in_selection(F.lit(2), c), t.page_indices(c).isNull()).collect()]
    assert got == [(True, True, True), (False, False, True), (True, True, False), (False, True, True), (None, True, True), (False, False, True), (False, False, True)] or got[4][1:] == (True, True)
    tags = spark.createDataFrame([("v99999999999999999999.1", "99999999999999999999"), ("9" * 60, "1"), ("1.0", "1")], "a string, b string")
    assert [r[0] for r in tags.select(t.is_newer(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    boxes = spark.createDataFrame([(float("nan"),), (1e300,), (-1e300,), (5.9,)], "x double")
    assert [r[0] for r in boxes.select(layout._clip(F.col("x"), F.lit(100.0))).collect()] == [0, 99, 0, 5]
    assert t.option_problem and spark.range(1).select(t.valid_threads(F.lit("99999999999999"))).first()[0] is False


def test_state_without_status(spark):
    s = state.new_state(spark.createDataFrame([(1, "a"), (2, "b")], "segment_id long, source_text string")).withColumn("status", F.when(F.col("segment_id") == 1, "completed"))
    assert {r.status: r.segments for r in state.stats(s).collect()} == {"completed": 1, "unknown": 1, "total": 2}
    assert state.is_complete(s).first().is_complete is False


def test_runs_end_once(spark):
    rows = [(1, 1, n, n, "exception", f"e{n}") for n in range(1, 5)] + [(2, 1, 1, 9, "invalid", "short"), (2, 1, 2, 10, "ok", "x"), (3, 1, 1, 11, "exception", "e"), (4, 1, 1, 12, "exception", "e"), (4, 1, 2, 13, "ok", "T")]
    a = spark.createDataFrame(rows, "segment_id long, run int, attempt int, seq long, outcome string, payload string")
    assert sorted(tuple(r) for r in state.run_events(a).collect()) == [(1, 1, 4, "failed", "e4"), (2, 1, 9, "failed", "validation: short"), (4, 1, 13, "completed", "T")]


def test_cache_is_bypassed(spark):
    kind = "translate_engine string, translate_engine_params string, original_text string"
    asks = spark.createDataFrame([("google", "{}", "a"), ("google", "{}", "b"), ("google", "{}", "a"), ("handoff", "{}", "a"), ("google", "{}", "no")], kind)
    cache = spark.createDataFrame([("google", "{}", "a", "A"), ("handoff", "{}", "a", "stale")], kind + ", translation string")
    seen = []

    def make(df):
        seen.append(sorted(r.original_text for r in df.collect()))
        return df.withColumn("translation", F.when(F.col("original_text") != "no", F.upper("original_text")))

    answers, after = terms.read_through(asks, cache, make)
    assert sorted((r.translate_engine, r.original_text, r.translation) for r in answers.collect() if r.translation) == [("google", "a", "A"), ("google", "a", "A"), ("google", "b", "B"), ("handoff", "a", "A")]
    assert seen == [["a", "b", "no"]] and sorted((r.translate_engine, r.original_text, r.translation) for r in after.collect()) == [("google", "a", "A"), ("google", "b", "B"), ("handoff", "a", "stale")]
    _, kept = terms.read_through(asks, cache, make, bypass=True)
    assert kept.count() == 2 and seen[1] == ["a", "a", "b", "no"]


def test_errors_in_a_line():
    try:
        try:
            raise KeyError("inner")
        except KeyError as e:
            raise ValueError("outer") from e
    except ValueError as e:
        assert engines.described(e) == "ValueError: outer <- KeyError: 'inner'"
    loop = OSError()
    loop.__context__ = loop
    assert engines.described(loop) == "OSError"


def test_cancellable(spark):
    c = jobs.Cancellable(spark, "segmill-test")
    assert c.run(lambda: spark.range(5).count()) == 5 and c.cancel() == [] and c.fraction() == 0


def test_edges_in_order(spark):
    rnd = random.Random(9)
    rows = [(p, i, float(rnd.choice([50, 53, 300])), 0.0, float(y := rnd.randrange(0, 200)), y + 10.0, rnd.random() < 0.3) for p in range(60) for i in range(rnd.randrange(1, 9))]
    rows = [(p, i, x0, x0 + rnd.choice([40, 90, 200, 245]), y0, y1, b) for p, i, x0, _, y0, y1, b in rows]
    got = {(r.page_id, r.para_id): r.right for r in layout.column_edges_in_order(spark.createDataFrame(rows, "page_id long, para_id long, x0 double, x1 double, y0 double, y1 double, brk boolean")).collect()}
    for p in range(60):
        page = [list(r[1:]) for r in rows if r[0] == p]
        for me in page:
            if not me[5]:
                reach = max([q[2] for q in page if abs(q[1] - me[1]) <= 5 and (q[5] or q[2] > me[2] + 30)], default=me[2])
                wall = [q[1] - 5 for q in page if q is not me and q[1] > me[1] + 10 and not (q[4] < me[3] - 2 or q[3] > me[4] + 2)]
                me[2] = max(me[2], min([reach, *wall]))
        assert {q[0]: q[2] for q in page} == {k[1]: v for k, v in got.items() if k[0] == p}


def walked(text, x, x0, x1, size, font, width, known):
    """Runs by a walk over the tokens of each wrapped line."""
    tokens, out, line = None, [], -1
    wide = lambda c: known[int(c[2:-1])][0] if len(c) > 1 and int(c[2:-1]) in known else 0.0 if len(c) > 1 else width(c) * size
    for k, whole in enumerate(paragraphs.wrap(text, lambda c: wide(c) / size, x, x0, x1, size)):
        line, at, run = line + 1, x if k == 0 else x0, None
        tokens = [c for c in paragraphs._TOKEN.findall(whole) if len(c) == 1 or int(c[2:-1]) in known]
        fresh = True
        for c in tokens:
            if at + wide(c) > x1 + 0.1 * size and not fresh and " " in text.strip():
                line, at, run, fresh = line + 1, x0, None, True
            if fresh and at == x0 and c == " ":
                continue
            if len(c) > 1:
                out.append([line, at, None, None, int(c[2:-1])])
                at += wide(c) - known[int(c[2:-1])][1]
                run = None
            else:
                if run is None or run[2] != font(c):
                    run = [line, at, font(c), "", None]
                    out.append(run)
                run[3] += c
                at += wide(c)
            fresh = False
    return [tuple(r) for r in out]


def test_font_runs(spark):
    rnd = random.Random(4)
    known = {1: (12.0, 2.0), 2: (30.0, 0.0)}
    width = lambda c: {"i": 0.25, " ": 0.25}.get(c, 0.5)
    font = lambda c: "greek" if c in "αβ" else "tiro"
    texts = ["", " ", "{v1}", "{v9}", "a" * 60, "a" * 60 + " b", "  lead"] + ["".join(rnd.choice(["a", "i", "α", "β", " ", "{v1}", "{v2}", "{v7}"]) for _ in range(rnd.randrange(120))) for _ in range(200)]
    for s in texts:
        for x in (0.0, 20.0):
            got = [(a, round(b, 6), *r) for a, b, *r in formulas.runs_of(s, x, 0.0, 60.0, 8.0, font, width, known)]
            assert got == [(a, round(b, 6), *r) for a, b, *r in walked(s, x, 0.0, 60.0, 8.0, font, width, known)], s
    p = spark.createDataFrame([(i, i % 3, s, 0.0, 0.0, 60.0, 8.0) for i, s in enumerate(texts[:40])] + [(90, 7, None, 0.0, 0.0, 60.0, 8.0)], "para_id long, page_id long, text string, x double, x0 double, x1 double, size double")
    f = spark.createDataFrame([(p, v, *k) for p in range(3) for v, k in known.items()], "page_id long, vid int, width double, overhang double")
    rows = formulas.font_runs(p, f, {"greek": "αβ"}, "tiro", {"i": 0.25, " ": 0.25}).orderBy("para_id", "seq").collect()
    want = [(i, *r) for i, s in enumerate(texts[:40]) for r in walked(s, 0.0, 0.0, 60.0, 8.0, font, width, known)]
    assert [(r.para_id, r.line, round(r.x, 6), r.font, r.text, r.vid) for r in rows] == [(i, a, round(b, 6), *r) for i, a, b, *r in want]


def test_fill(spark):
    p = spark.createDataFrame([(1, "a {v0} { V 1 }b{v 1 0}{v5}"), (1, None), (2, "{v0}"), (1, "plain {x}")], "page long, text string")
    f = spark.createDataFrame([(1, 0, "x=1"), (1, 1, "$y"), (1, 10, "ten")], "page long, vid int, text string")
    assert sorted((r.page, r.text) for r in formulas.fill(p, f, ["page"]).collect() if r.text is not None) == [(1, "a x=1 $ybten"), (1, "plain {x}"), (2, "")]


def test_forms_within_themselves(spark):
    one = [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    uses = spark.createDataFrame([(1, 2, one), (2, 1, one), (2, 3, one), (3, 3, one)], "parent_id long, form_id long, matrix array<double>")
    roots = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "root_id long, ctm array<double>")
    assert sorted((r.form_id, r.depth, r.ctm[4]) for r in content.frames(roots, uses).collect()) == [(2, 1, 1.0), (3, 2, 2.0)]
    assert content.frames(roots, uses.limit(0)).count() == 0


def test_segments_in_order(spark):
    lines = spark.createDataFrame([("f", 1, '{"src":"a"}'), ("f", 2, ""), ("f", 3, '{"src":"b"}')], "file string, line_no long, line string")
    assert sorted((r.segment_id, r.source) for r in jsonl.segments(lines).collect()) == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="line 4"):
        jsonl.segments(lines.union(spark.createDataFrame([("f", 4, '{"src":5}')], lines.schema))).collect()
