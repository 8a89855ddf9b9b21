"""Queries of stores, runs, caches, options, content streams, formulas and page scans, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import content, formulas, jobs, layout, outline, state, terms, typeset
from ..sources import jsonl, pages, store
from .fixtures import dealt, fixture, tables
from .registry import query

_STATE = "segment_id long, source_text string, source_hash string, status string, translation string, model string, timestamp double, retry_count int, tokens_in int, tokens_out int, error string"
_RUNS = """
    SELECT user_id AS segment_id, event_id // 500 AS run, row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) AS attempt, event_id AS seq,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'exception' WHEN 'view' THEN 'exception' WHEN 'click' THEN 'exception' ELSE 'invalid' END AS outcome, event_type || event_id AS payload FROM events
"""
_RUN_EVENTS = f"""
    SELECT segment_id, run, arg_min(seq, attempt) AS seq, CASE WHEN arg_min(outcome, attempt) = 'ok' THEN 'completed' ELSE 'failed' END AS event,
        CASE WHEN arg_min(outcome, attempt) = 'invalid' THEN 'validation: ' ELSE '' END || arg_min(payload, attempt) AS payload
    FROM ({_RUNS}) WHERE outcome IN ('ok', 'invalid') OR attempt > 3 GROUP BY segment_id, run
"""


def _runs(spark, sf_dir) -> DataFrame:
    e = tables(spark, sf_dir, "events")["events"]
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type").isin("error", "view", "click"), "exception").otherwise("invalid")
    a = e.select(F.col("user_id").alias("segment_id"), F.expr("event_id div 500").alias("run"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.concat("event_type", F.col("event_id").cast("string")).alias("payload"))
    return terms.chunk_order(a, ["segment_id", "run"], ["seq"], "attempt").withColumn("attempt", F.col("attempt") + 1)


@query("run_outcomes", _RUN_EVENTS)
def run_outcomes(spark, sf_dir):
    return state.run_events(_runs(spark, sf_dir))


@query("event_fold_full", f"""
    WITH e AS (SELECT *, seq / 4.0 AS tm, 'm' || segment_id % 3 AS model, (seq % 50)::INTEGER AS ti, (seq % 70)::INTEGER AS tk FROM ({_RUN_EVENTS}))
    SELECT s.segment_id, coalesce(arg_max(event, seq), 'pending') AS status, coalesce(arg_max(payload, seq) FILTER (event = 'completed'), '') AS translation, coalesce(arg_max(payload, seq) FILTER (event = 'failed'), '') AS error,
        coalesce(arg_max(model, seq) FILTER (event = 'completed'), '') AS model, coalesce(max(tm), 0)::DOUBLE AS timestamp, (count(*) FILTER (event = 'failed'))::INTEGER AS retry_count,
        coalesce(arg_max(ti, seq) FILTER (event = 'completed'), 0) AS tokens_in, coalesce(arg_max(tk, seq) FILTER (event = 'completed'), 0) AS tokens_out
    FROM (SELECT DISTINCT user_id AS segment_id FROM events) s LEFT JOIN e USING (segment_id) GROUP BY s.segment_id
""")
def event_fold_full(spark, sf_dir):
    a = _runs(spark, sf_dir)
    log = state.run_events(a).withColumns({"at": F.col("seq") / 4, "model": F.concat(F.lit("m"), (F.col("segment_id") % 3).cast("string")), "tokens_in": F.col("seq") % 50, "tokens_out": F.col("seq") % 70})
    base = state.new_state(a.select("segment_id").distinct().withColumn("source_text", F.col("segment_id").cast("string")))
    return state.fold_events(base, log).select("segment_id", "status", "translation", "error", "model", "timestamp", "retry_count", "tokens_in", "tokens_out")


@query("store_round_trip", """
    SELECT segment_id, coalesce(text_v2, text_v1) AS source_text, CASE WHEN text_v1 IS NOT NULL AND (text_v2 IS NULL OR text_v1 = text_v2) THEN 'completed' ELSE 'pending' END AS status, 3 AS version
    FROM d_versions WHERE text_v1 IS NOT NULL OR text_v2 IS NOT NULL
""", "d_versions")
def store_round_trip(spark, sf_dir):
    """A store that is created, filled, and reconciled with a new list of segments, each step read from the one before."""
    v = fixture(spark, sf_dir, "d_versions")
    s = store.Store(spark, store.work_dir(spark, "state"), _STATE)
    s.create()
    first = state.new_state(v.where("text_v1 is not null").select("segment_id", F.col("text_v1").alias("source_text")))
    s.write(s.read().unionByName(first.withColumn("status", F.lit("completed"))))
    s.write(state.reconcile(s.read(), v.where("text_v2 is not null").select("segment_id", F.col("text_v2").alias("source_text"))))
    return s.read().select("segment_id", "source_text", "status", F.lit(s.version()).alias("version"))


_ASKS = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'openai' ELSE 'handoff' END AS e, text FROM conversations"


@query("cache_read_through", f"""
    WITH a AS ({_ASKS}), c AS (SELECT DISTINCT 'google' AS e, text FROM conversations WHERE conv_id % 3 = 0 UNION SELECT DISTINCT 'handoff', text FROM conversations WHERE conv_id % 2 = 0),
    made AS (SELECT DISTINCT a.e, a.text FROM a LEFT JOIN c ON a.e = c.e AND a.text = c.text WHERE (c.e IS NULL OR a.e = 'handoff') AND length(a.text) % 5 <> 0)
    SELECT 'answer' AS part, a.e AS engine, count(*) AS rows, count(*) FILTER (c.e IS NOT NULL AND a.e <> 'handoff') AS old, count(*) FILTER (made.e IS NOT NULL) AS new
        FROM a LEFT JOIN c ON a.e = c.e AND a.text = c.text LEFT JOIN made ON a.e = made.e AND a.text = made.text GROUP BY a.e
    UNION ALL SELECT 'cache', e, count(*), count(*) FILTER (k = 0), count(*) FILTER (k = 1) FROM (SELECT e, text, 0 AS k FROM c UNION ALL SELECT e, text, 1 FROM made WHERE e <> 'handoff') GROUP BY e
""")
def cache_read_through(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations")["conversations"]
    params = F.lit("{}").alias("translate_engine_params")
    engine = F.when(F.col("turn") % 3 == 0, "google").when(F.col("turn") % 3 == 1, "openai").otherwise("handoff")
    asks = c.select(engine.alias("translate_engine"), params, F.col("text").alias("original_text"))
    old = lambda name, n: c.where(F.col("conv_id") % n == 0).select(F.lit(name).alias("translate_engine"), params, F.col("text").alias("original_text"), F.concat(F.lit("old "), "text").alias("translation")).distinct()
    cache = old("google", 3).unionByName(old("handoff", 2))
    make = lambda df: df.withColumn("translation", F.when(F.length("original_text") % 5 != 0, F.concat(F.lit("new "), "original_text")))
    answers, after = terms.read_through(asks, cache, make)
    count = lambda df, part: df.groupBy(F.lit(part).alias("part"), F.col("translate_engine").alias("engine")).agg(F.count("*").alias("rows"), F.count_if(F.col("translation").startswith("old ")).alias("old"), F.count_if(F.col("translation").startswith("new ")).alias("new"))
    return count(answers, "answer").unionByName(count(after, "cache"))


@query("formula_fill", """
    SELECT page_id, seq AS para_id, 'a f' || seq || '-' || cls || ' b ' || coalesce('f' || (seq + 1) || '-' || lead(cls) OVER (PARTITION BY page_id ORDER BY seq), '') || ' c {w}' AS text FROM d_boxes
""", "d_boxes")
def formula_fill(spark, sf_dir):
    b = fixture(spark, sf_dir, "d_boxes")
    n = F.col("seq").cast("string")
    p = b.select("page_id", F.col("seq").alias("para_id"), F.concat(F.lit("a {v"), n, F.lit("} b { V "), (F.col("seq") + 1).cast("string"), F.lit(" }{v99999} c {w}")).alias("text"))
    f = b.select("page_id", F.col("seq").alias("vid"), F.concat(F.lit("f"), n, F.lit("-"), F.col("cls").cast("string")).alias("text"))
    return formulas.fill(p, f, ["page_id"])


@query("formula_backing", """
    SELECT page_id, cls AS vid, min(x0) - 3 AS "left", min(y0) - 3 AS bottom, max(x1) - min(x0) + 6 AS w, max(y1) - min(y0) + 6 AS h FROM d_boxes WHERE page_id % 2 = 0 GROUP BY page_id, cls
""", "d_boxes")
def formula_backing(spark, sf_dir):
    return formulas.backing(fixture(spark, sf_dir, "d_boxes").withColumnRenamed("cls", "vid").withColumn("is_scanned", F.col("page_id") % 2 == 0))


@query("font_runs")
def font_runs(spark, sf_dir):
    """Whole documents as runs of two fonts, with a formula behind each comma."""
    d = dealt(tables(spark, sf_dir, "documents")["documents"].select("doc_id", "text"), "doc_id")
    p = d.select(F.col("doc_id").alias("para_id"), F.col("doc_id").alias("page_id"), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(",{v1}")).alias("text"), F.lit(60.0).alias("x"), F.lit(50.0).alias("x0"), F.lit(350.0).alias("x1"), F.lit(10.0).alias("size"))
    f = d.select(F.col("doc_id").alias("page_id"), F.lit(1).alias("vid"), F.lit(12.0).alias("width"), F.lit(2.0).alias("overhang"))
    return formulas.font_runs(p, f, {"tiro": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:!?'\"-()"}, "noto", {"i": 0.25, "l": 0.25, "m": 0.75, "w": 0.75, " ": 0.25})


@query("column_edges_in_order", """
    WITH RECURSIVE p AS (SELECT page_id, count(*) AS n, list(seq ORDER BY seq) AS ids, list(x0 ORDER BY seq) AS x0, list(x1 ORDER BY seq) AS x1, list(y0 ORDER BY seq) AS y0, list(y1 ORDER BY seq) AS y1, list(cls % 2 = 0 ORDER BY seq) AS brk FROM d_boxes GROUP BY page_id),
    r AS (SELECT page_id, n, ids, x0, x1, y0, y1, brk, 1 AS i FROM p UNION ALL
        SELECT page_id, n, ids, x0, list_transform(range(1, n + 1), lambda k: CASE WHEN k = i AND NOT brk[k] THEN greatest(x1[k], least(coalesce(edge, x1[k]), coalesce(stop - 5, edge, x1[k]))) ELSE x1[k] END), y0, y1, brk, i + 1
        FROM (SELECT *, list_max(list_transform(range(1, n + 1), lambda k: CASE WHEN abs(x0[k] - x0[i]) <= 5 AND (brk[k] OR x1[k] > x1[i] + 30) THEN x1[k] END)) AS edge,
            list_min(list_transform(range(1, n + 1), lambda k: CASE WHEN x0[k] > x0[i] + 10 AND y1[k] >= y0[i] - 2 AND y0[k] <= y1[i] + 2 THEN x0[k] END)) AS stop FROM r WHERE i <= n) q)
    SELECT page_id, unnest(ids) AS para_id, unnest(x1) AS "right" FROM r WHERE i = n + 1
""", "d_boxes")
def column_edges_in_order(spark, sf_dir):
    p = fixture(spark, sf_dir, "d_boxes").select("page_id", F.col("seq").alias("para_id"), "x0", "x1", "y0", "y1", (F.col("cls") % 2 == 0).alias("brk"))
    return layout.column_edges_in_order(p)


_CODES = "SELECT l_orderkey AS page_id, 0 AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate) AS seq, l_partkey % 130 AS code, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS font, l_quantity AS size FROM lineitem"
_FONTS = "SELECT DISTINCT p_partkey % 130 AS code, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS font FROM part"


@query("glyph_emission", f"""
    WITH g AS (SELECT c.*, CASE WHEN f.code IS NULL THEN '(cid:' || c.code || ')' ELSE 'u' || c.code END AS text, CASE WHEN f.code IS NULL THEN 0 ELSE (c.code % 4 + 1) / 4 END * size * 0.5 AS advance FROM ({_CODES}) c LEFT JOIN ({_FONTS}) f ON c.code = f.code AND c.font = f.font),
    p AS (SELECT *, 50 + coalesce(sum(advance) OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM g)
    SELECT page_id, seq, text, round(x0, 6) AS x0, round(x0 + advance, 6) AS x1 FROM p
""")
def glyph_emission(spark, sf_dir):
    li, part = (tables(spark, sf_dir, n)[n] for n in ("lineitem", "part"))
    c = terms.chunk_order(li.withColumnRenamed("l_orderkey", "page_id"), ["page_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"], "seq")
    c = c.select("page_id", F.lit(0).alias("run"), (F.col("seq") + 1).alias("seq"), (F.col("l_partkey") % 130).alias("code"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("font"), F.col("l_quantity").alias("size"), F.lit(0.5).alias("scaling"), F.lit(50.0).alias("x"), F.lit(700.0).alias("y"))
    f = part.select((F.col("p_partkey") % 130).alias("code"), F.when(F.col("p_partkey") % 3 == 0, "A").otherwise("B").alias("font")).distinct()
    f = f.select("font", "code", F.concat(F.lit("u"), F.col("code").cast("string")).alias("text"), ((F.col("code") % 4 + 1) / 4).alias("width"))
    return content.glyphs(c, f).select("page_id", "seq", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


_OPS = """
    SELECT page_id AS stream_id, seq, ['Tj', 'm', 'l', 'f', 'cm', 'BDC', 'S', 'T*', 're', 'q'][1 + (seq + cls) % 10] AS op, cls AS a, seq AS b FROM d_boxes
"""


def _ops(spark, sf_dir) -> DataFrame:
    b = fixture(spark, sf_dir, "d_boxes")
    names = F.array(*map(F.lit, ["Tj", "m", "l", "f", "cm", "BDC", "S", "T*", "re", "q"]))
    op = F.element_at(names, (1 + (F.col("seq") + F.col("cls")) % 10).cast("int"))
    operands = F.array(F.concat(F.col("cls").cast("string"), F.lit(".5")), F.concat(F.lit("'"), F.col("seq").cast("string"), F.lit("'")))
    return b.select(F.col("page_id").alias("stream_id"), "seq", op.alias("op"), operands.alias("operands"))


@query("content_background", f"""
    SELECT stream_id, coalesce(string_agg(a || '.500000 ' || b || ' ' || op || ' ', '' ORDER BY seq) FILTER (op NOT IN ('Tj', 'T*', 'BDC')), '') AS ops FROM ({_OPS}) GROUP BY stream_id
""", "d_boxes")
def content_background(spark, sf_dir):
    return content.background(_ops(spark, sf_dir))


@query("content_paths", f"""
    WITH o AS (SELECT *, (op IN ('f', 'S'))::INT AS e FROM ({_OPS})), p AS (SELECT *, sum(e) OVER (PARTITION BY stream_id ORDER BY seq) - e AS path FROM o)
    SELECT stream_id, path::BIGINT AS path, max(op) FILTER (e = 1) AS painter, coalesce(string_agg(op, ',' ORDER BY seq) FILTER (e = 0), '') AS built FROM p WHERE op IN ('m', 'l', 're', 'f', 'S') GROUP BY stream_id, path
""", "d_boxes")
def content_paths(spark, sf_dir):
    p = content.paths(_ops(spark, sf_dir))
    return p.select("stream_id", F.col("path").cast("long").alias("path"), "painter", F.array_join(F.transform("segments", lambda x: x["op"]), ",").alias("built"))


@query("form_frames", """
    WITH RECURSIVE u AS (SELECT p_partkey AS parent, p_partkey * 2 + k AS child, (p_size % 3 + 1)::DOUBLE AS s, (p_partkey % 5)::DOUBLE AS e, k::DOUBLE AS f FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_partkey * 2 + k <= (SELECT max(p_partkey) FROM part)),
    r AS (SELECT p_partkey AS root, p_partkey AS form, 0 AS depth, 1.0::DOUBLE AS s, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f FROM part WHERE p_partkey BETWEEN 1 AND 3
        UNION ALL SELECT root, child, depth + 1, u.s * r.s, u.e * r.s + r.e, u.f * r.s + r.f FROM r JOIN u ON form = parent)
    SELECT root AS root_id, form AS form_id, depth, s AS a, e, f FROM r WHERE depth > 0
""")
def form_frames(spark, sf_dir):
    p = tables(spark, sf_dir, "part")["part"]
    most = p.agg(F.max("p_partkey").alias("most"))
    u = p.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).join(F.broadcast(most), F.col("p_partkey") * 2 + F.col("k") <= F.col("most"))  # one row
    s, zero = (F.col("p_size") % 3 + 1).cast("double"), F.lit(0.0)
    uses = u.select(F.col("p_partkey").alias("parent_id"), (F.col("p_partkey") * 2 + F.col("k")).alias("form_id"), F.array(s, zero, zero, s, (F.col("p_partkey") % 5).cast("double"), F.col("k").cast("double")).alias("matrix"))
    unit = F.array(*map(F.lit, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]))
    out = content.frames(p.where("p_partkey between 1 and 3").select(F.col("p_partkey").alias("root_id"), unit.alias("ctm")), uses)
    return out.select("root_id", "form_id", "depth", F.col("ctm")[0].alias("a"), F.col("ctm")[4].alias("e"), F.col("ctm")[5].alias("f"))


@query("stream_resources", """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CASE p_partkey % 4 WHEN 1 THEN p_size WHEN 2 THEN 2 ELSE 4 END END::INTEGER AS components, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE END AS descent FROM part
""")
def stream_resources(spark, sf_dir):
    k = F.col("p_partkey") % 4
    p = tables(spark, sf_dir, "part")["part"].select("p_partkey", F.when(k == 0, "Font").otherwise("ColorSpace").alias("kind"), F.when(k == 1, "ICCBased").when(k == 2, "DeviceN").when(k == 3, "DeviceCMYK").alias("spec"), F.when(k == 1, F.col("p_size")).alias("declared"), F.when(k == 2, F.array(F.lit("x"), F.lit("y"))).alias("names"))
    return content.resources(p).select("p_partkey", "components", "descent")


def forty_lines(data: bytes):
    """A reader of texts: pages of forty lines, with an image block on pages that begin with a capital letter."""
    lines = data.decode().split("\n")
    for at in range(0, len(lines), 40):
        text = "\n".join(lines[at : at + 40])
        yield 600.0, 800.0, 0, text, [(1, [0.0, 0.0, 600.0, 500.0])] if text[:1].isupper() else []


@query("page_scan", """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    p AS (SELECT doc_id, i // 40 AS pageno, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2)
    SELECT doc_id::VARCHAR AS doc_id, pageno::INTEGER AS pageno, sha256(text) AS digest FROM p WHERE doc_id % 3 = 0 OR pageno IN (0, 2, 3)
""")
def page_scan(spark, sf_dir):
    d = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.encode("text", "UTF-8").alias("content"))
    selection = F.when(F.col("doc_id").cast("long") % 3 != 0, "1,3-4")
    return pages.scan(d, forty_lines, selection).select("doc_id", "pageno", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("segments_jsonl", """
    SELECT file_id::VARCHAR AS file, (row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1)::BIGINT AS segment_id, json_extract_string(line, '$.en') AS source FROM d_json WHERE line_no % 9 IN (2, 4, 5, 6, 7, 8)
""", "d_json")
def segments_jsonl(spark, sf_dir):
    d = fixture(spark, sf_dir, "d_json").where("line_no % 9 in (0, 2, 4, 5, 6, 7, 8)")
    return jsonl.segments(d.select(F.col("file_id").cast("string").alias("file"), "line_no", F.replace("line", F.lit('"en"'), F.lit('"src"')).alias("line")))


@query("option_checks", """
    SELECT p_partkey, p_size BETWEEN 1 AND 8 AS threads, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'an output directory is needed unless segments are emitted'
        WHEN p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 THEN 'handoff needs segments, a path to emit them to, or both'
        WHEN p_partkey % 5 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 3 = 0) THEN 'segments are for handoff only' END AS problem FROM part
""")
def option_checks(spark, sf_dir):
    n = F.col("p_partkey")
    given = lambda k: F.when(n % k == 0, "x")
    problem = t.option_problem(F.when(n % 5 == 0, "handoff").otherwise("google"), F.when(n % 2 != 0, "x"), given(7), given(3))
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", t.valid_threads(F.col("p_size").cast("string")).alias("threads"), problem.alias("problem"))


@query("resized_images", """
    WITH p AS (SELECT p_partkey, p_size * 17 + 3 AS h, p_partkey % 900 + 40 AS w FROM part), r AS (SELECT *, least(1024 / h, 1024 / w) AS r FROM p),
    z AS (SELECT *, round_even(h * r, 0)::INTEGER AS rh, round_even(w * r, 0)::INTEGER AS rw FROM r)
    SELECT p_partkey, rh AS h, rw AS w, ((1024 - rh) % 32) // 2 AS "top", (1024 - rh) % 32 - ((1024 - rh) % 32) // 2 AS bottom, ((1024 - rw) % 32) // 2 AS "left", (1024 - rw) % 32 - ((1024 - rw) % 32) // 2 AS "right" FROM z
""")
def resized_images(spark, sf_dir):
    size = typeset.resized((F.col("p_size") * 17 + 3).cast("double"), (F.col("p_partkey") % 900 + 40).cast("double"), F.lit(1024.0), F.lit(1024.0))
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


@query("canonical_json", """
    SELECT p_partkey, '{"a":[1,{"b":"' || p_brand || '","c":' || p_size || '}],"z":{"k":null,"n":true}}' AS line, '{"a":"' || p_brand || '","b":"2","c":"3"}' AS params FROM part
""")
def canonical_json(spark, sf_dir):
    raw = F.concat(F.lit('{"z": {"n": true, "k": null}, "a": [1, {"c": '), F.col("p_size").cast("string"), F.lit(', "b": "'), F.col("p_brand"), F.lit('"}]}'))
    params = t.merged_params(F.create_map(F.lit("c"), F.lit("3"), F.lit("a"), F.lit("old")), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("p_brand")))
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", t.canonical_json(raw).alias("line"), params.alias("params"))


@query("stage_summary", """
    WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') * 7 AS a, count(*) FILTER (event_type = 'purchase') * 11 AS b FROM events GROUP BY user_id)
    SELECT user_id, (a + b) // 60 || 'm ' || printf('%04.1f', ((a + b) % 60)::DOUBLE) || 's' AS total, 'translate: ' || b || '.00s (' || printf('%.1f', CASE WHEN a + b > 0 THEN round(b * 100.0 / (a + b), 1) ELSE 0 END) || '%) [n]' AS line FROM s
""")
def stage_summary(spark, sf_dir):
    s = tables(spark, sf_dir, "events")["events"].groupBy("user_id").agg((F.count_if(F.col("event_type") == "view") * 7).alias("a"), (F.count_if(F.col("event_type") == "purchase") * 11).alias("b"))
    return s.select("user_id", t.minutes(F.col("a") + F.col("b")).alias("total"), t.stage_line(F.lit("translate"), F.col("b"), F.col("a") + F.col("b"), F.lit("n")).alias("line"))


@query("vietnamese_fonts", """
    SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN 'SourceHanSerifJP-Regular.ttf' WHEN n_nationkey % 3 = 0 THEN '/mine.ttf' WHEN n_nationkey % 4 = 0 THEN '/Library/Fonts/Times New Roman.ttf' ELSE 'GoNotoKurrent-Regular.ttf' END AS regular,
        CASE WHEN n_nationkey % 2 = 0 THEN 'C:/Windows/Fonts/timesbd.ttf' END AS bold, NULL::VARCHAR AS italic FROM nation
""")
def vietnamese_fonts(spark, sf_dir):
    n = F.col("n_nationkey")
    bold = F.lit("C:/Windows/Fonts/timesbd.ttf")
    present = F.when(n % 3 == 0, F.array(F.lit("/mine.ttf"), F.lit("/Library/Fonts/Times New Roman.ttf"), bold)).when(n % 4 == 0, F.array(bold, F.lit("/Library/Fonts/Times New Roman.ttf"))).otherwise(F.array(bold))
    fonts = typeset.weighted_fonts(F.when(n % 2 == 0, "VI").otherwise("ja"), F.create_map(F.lit("regular"), F.lit("/mine.ttf")), present)
    return tables(spark, sf_dir, "nation")["nation"].select("n_nationkey", fonts.alias("f")).select("n_nationkey", *(F.try_element_at("f", F.lit(w)).alias(w) for w in ("regular", "bold", "italic")))


@query("font_scaling", """
    SELECT page_id, seq, round(CASE WHEN w > r * 1.05 THEN 10 * greatest(r / w, 0.5) ELSE 10 END, 6) AS size
    FROM (SELECT page_id, seq, conf * 100 AS w, (x1 - x0) * greatest(1, round_even((y1 - y0) / 11, 0)) AS r FROM d_boxes)
""", "d_boxes")
def font_scaling(spark, sf_dir):
    b = fixture(spark, sf_dir, "d_boxes")
    return b.select("page_id", "seq", F.round(layout.scaled_size(F.lit(10.0), F.col("conf") * 100, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), F.lit(1.1)), 6).alias("size"))


@query("form_inverse", """
    SELECT page_id, seq, CASE WHEN cls = 0 THEN NULL ELSE round(1 / cls, 9) END AS a, CASE WHEN cls = 0 THEN NULL ELSE round(-x0 / cls, 6) END AS e FROM d_boxes
""", "d_boxes")
def form_inverse(spark, sf_dir):
    s, zero = F.col("cls").cast("double"), F.lit(0.0)
    m = layout.inverse_matrix(F.array(s, zero, zero, s, F.col("x0"), F.col("y0")))
    return fixture(spark, sf_dir, "d_boxes").select("page_id", "seq", F.round(m[0], 9).alias("a"), F.round(m[4], 6).alias("e"))


@query("untranslated_counts", """
    SELECT turn, count(*) AS segments, count(*) FILTER (conv_id % 5 NOT IN (1, 2) AND conv_id % 3 = 0) AS untranslated FROM conversations GROUP BY turn
""")
def untranslated_counts(spark, sf_dir):
    c, n = tables(spark, sf_dir, "conversations")["conversations"], F.col("conv_id") % 5
    source = F.when(n == 1, "{v3}").when(n == 2, " ").otherwise(F.concat(F.lit("x"), "text"))
    s = c.select("turn", "conv_id", source.alias("source")).withColumn("translation", F.when(F.col("conv_id") % 3 == 0, F.col("source")).otherwise("t"))
    return jobs.untranslated(s, ["turn"])


@query("queue_fraction", """
    SELECT user_id, round((count(*) FILTER (event_type = 'purchase') + CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') ELSE 0 END) / count(*), 6) AS fraction,
        CASE WHEN user_id % 3 = 0 THEN 0 ELSE sum(event_id % 90) END::BIGINT AS pages FROM events GROUP BY user_id
""")
def queue_fraction(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"]
    of = lambda k: F.count_if(F.col("event_type") == k)
    failed = F.count_if(F.col("user_id") % 3 == 0) > 0
    g = e.groupBy("user_id").agg(of("purchase").alias("a"), of("click").alias("b"), of("view").alias("c"), F.count("*").alias("n"), F.when(failed, 0).otherwise(F.sum(F.col("event_id") % 90)).cast("long").alias("pages"))
    return g.select("user_id", F.round(jobs.fraction(F.col("a"), F.col("b"), F.col("c"), F.col("n")), 6).alias("fraction"), "pages")


@query("glossary_additions", """
    WITH g AS (SELECT lower(p_name) AS key, max(struct_pack(p_partkey, en := p_name, vi := p_type)) AS r FROM part GROUP BY 1), a AS (SELECT upper(p_name) AS en, 'new ' || min(p_type) AS vi FROM part WHERE p_partkey % 5 = 0 GROUP BY 1)
    SELECT coalesce(lower(a.en), g.key) AS key, coalesce(a.en, g.r.en) AS en, coalesce(a.vi, g.r.vi) AS vi FROM g FULL JOIN a ON lower(a.en) = g.key
""")
def glossary_additions(spark, sf_dir):
    p = tables(spark, sf_dir, "part")["part"]
    g = terms.merge_glossaries(p.select(F.col("p_name").alias("en"), F.col("p_type").alias("vi"), F.lit("").alias("notes"), F.lit(0).alias("tier"), F.col("p_partkey").alias("line_no")))
    a = p.where("p_partkey % 5 = 0").groupBy(F.upper("p_name").alias("en")).agg(F.concat(F.lit("new "), F.min("p_type")).alias("vi"), F.lit("").alias("notes"))
    return terms.add_terms(g, a).select("key", "en", "vi")


@query("payload_checks", """
    SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 2 AS is_document FROM part
""")
def payload_checks(spark, sf_dir):
    n = F.col("p_partkey")
    body = F.when(n % 3 == 0, "%PDF-1.7 x").when(n % 3 == 1, F.concat(F.repeat(F.lit("x"), 1000), F.lit("%PDF-"))).otherwise(F.concat(F.repeat(F.lit("x"), 1024), F.lit("%PDF-")))
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", jsonl.is_document(body.cast("binary"), F.when(n % 2 == 0, "a.PDF").otherwise("a.txt")).alias("is_document"))


@query("missing_files", "SELECT DISTINCT p_name AS path FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)")
def missing_files(spark, sf_dir):
    p = tables(spark, sf_dir, "part")["part"]
    names = p.select(F.col("p_name").alias("path")).unionByName(p.select(F.concat(F.lit("https://x/"), "p_name").alias("path")))
    return jsonl.missing(names, p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("path"))).distinct()


@query("waits", "SELECT p_partkey, least(2.0 ** (p_size % 8), 15)::DOUBLE AS within, least(2.0 ** (p_size % 9), 60)::DOUBLE AS calls FROM part")
def waits(spark, sf_dir):
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", t.retry_wait(F.col("p_size") % 8).alias("within"), t.call_wait(F.col("p_size") % 9 + 1).alias("calls"))


@query("skipped_segments", """
    SELECT turn, count(*) FILTER (conv_id % 4 IN (0, 1, 2)) AS skipped, any_value('<b' || turn || '></b' || turn || '>') AS placeholder FROM conversations GROUP BY turn
""")
def skipped_segments(spark, sf_dir):
    k = F.col("conv_id") % 4
    s = tables(spark, sf_dir, "conversations")["conversations"].withColumn("source_text", F.when(k == 0, " \t").when(k == 1, "{v12}").when(k == 2, "").otherwise(F.concat(F.lit("{v1} "), "text")))
    return s.groupBy("turn").agg(F.count_if(state.blank_or_formula()).alias("skipped"), F.first(t.formula_placeholder(F.col("turn"))).alias("placeholder"))


@query("chapter_files", """
    SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5) GROUP BY l_orderkey
""")
def chapter_files(spark, sf_dir):
    c = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("index"), F.lit(False).alias("failed")).distinct()
    kept = outline.batch(c, c.limit(0).select("doc_id", "index"), 2, 5)
    return kept.groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("index")), lambda x: x.cast("string")), ",").alias("lines"))


@query("glyph_flags", """
    SELECT p_partkey, p_partkey % 3 = 0 AND p_size % 2 = 0 AS vertical, p_partkey % 4 = 1 AND length(trim(CASE WHEN p_partkey % 5 = 0 THEN ' a ' ELSE p_name END)) > 1 AND p_size < 30 * 0.79 AND p_partkey % 2 = 1 AND p_partkey % 7 <> 0 AS script FROM part
""")
def glyph_flags(spark, sf_dir):
    n = F.col("p_partkey")
    zero_if = lambda c: F.when(c, 0.0).otherwise(1.0)
    script = layout.is_script(F.when(n % 4 == 1, 2).otherwise(3), F.lit(2), F.when(n % 5 == 0, " a ").otherwise(F.col("p_name")), F.col("p_size").cast("double"), F.lit(30.0), F.when(n % 7 == 0, "é").otherwise("2"))
    return tables(spark, sf_dir, "part")["part"].select("p_partkey", layout.is_vertical(zero_if(n % 3 == 0), zero_if(F.col("p_size") % 2 == 0)).alias("vertical"), script.alias("script"))
