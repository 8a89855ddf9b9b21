"""Layout of pages: classes of boxes and glyphs, columns, ink and line offsets, matrices.

Joins carry the page as an equality, with the geometry as a condition beside it, so that they are hash or merge joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_bullet, utrim

# Fixed values.
PROTECTED = ("abandon", "figure", "table", "isolate_formula", "formula_caption")
LEAST_CONFIDENCE = 0.25
COLUMN_TOLERANCE, COLUMN_EXTRA, OBSTACLE_GAP, OBSTACLE_OVERLAP, OBSTACLE_MARGIN = 5.0, 30.0, 10.0, 2.0, 5.0
DESCENT, ASCENT, SMALL = 0.22, 0.78, 0.79


def is_scanned(blocks: Column, page_area: Column) -> Column:
    """Whether an image block (type 1, four numbers) covers more than half of the page."""
    side = lambda b, i: F.greatest(F.lit(0.0), b["bbox"][i + 2] - b["bbox"][i])
    return (page_area > 0) & F.exists(blocks, lambda b: (b["type"] == 1) & (F.size(b["bbox"]) == 4) & (side(b, 0) * side(b, 1) > page_area * 0.5))


def _clip(c: Column, most: Column) -> Column:
    """A coordinate as a whole number within 0 and most; numbers of any size are clipped, what is no number counts as 0."""
    return F.least(F.greatest(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), (most.cast("int") - 1).cast("double")).cast("int")


def ranked_boxes(boxes: DataFrame, names: dict[int, str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Boxes of enough confidence with id (2 for the surest of a page, and so on), is_protected and pixel edges.

    boxes: (page_id, seq, x0, y0, x1, y1, conf, cls, width, height). Edges are widened by one, turned upside down and clipped.
    """
    name = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    rank = Window.partitionBy("page_id").orderBy(F.desc("conf"), "seq")
    w, h = F.col("width"), F.col("height")
    return boxes.where(F.col("conf") > least).select(
        "page_id", "seq", (F.row_number().over(rank) + 1).alias("id"), F.coalesce(F.try_element_at(name, F.col("cls")).isin(*PROTECTED), F.lit(False)).alias("is_protected"),
        _clip(F.col("x0") - 1, w).alias("px0"), _clip(h - F.col("y1") - 1, h).alias("py0"), _clip(F.col("x1") + 1, w).alias("px1"), _clip(h - F.col("y0") + 1, h).alias("py1"),
    )


def glyph_classes(glyphs: DataFrame, boxes: DataFrame, protected_pages: DataFrame | None = None) -> DataFrame:
    """glyphs (page_id, seq, x0, y0, text, width, height) with cls: 0 in protected boxes and for bullets, the surest other box's id, else 1.

    Boxes are those of ranked_boxes; a box's right and upper edges are outside of it. On protected pages all is 0.
    """
    g = glyphs.withColumn("gx", _clip(F.col("x0"), F.col("width"))).withColumn("gy", _clip(F.col("y0"), F.col("height")))
    b = boxes.drop("seq")
    inside = (F.col("gx") >= F.col("px0")) & (F.col("gx") < F.col("px1")) & (F.col("gy") >= F.col("py0")) & (F.col("gy") < F.col("py1"))
    hits = g.join(b, (g.page_id == b.page_id) & inside).groupBy(g.page_id, g.seq).agg(F.bool_or("is_protected").alias("stop"), F.min("id").alias("id"))
    j = g.join(hits, ["page_id", "seq"], "left")
    cls = F.when(is_bullet(F.col("text")) | F.coalesce("stop", F.lit(False)), 0).otherwise(F.coalesce("id", F.lit(1)))
    if protected_pages is not None:
        j = j.join(protected_pages.select("page_id", F.lit(True).alias("kept")), "page_id", "left")
        cls = F.when(F.col("kept"), 0).otherwise(cls)
    return j.withColumn("cls", cls).drop("gx", "gy", "stop", "id", "kept")


def column_edges(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (page_id, para_id, x0, x1, y0, y1, brk) with right: how far single-line ones may grow.

    A column's edge is the furthest of paragraphs that begin at the same x and are wrapped or clearly wider; what stands to the
    right at the same height is an obstacle. All edges are judged by the input, in no order of paragraphs.
    """
    p, q = paragraphs.alias("p"), paragraphs.select("page_id", *(F.col(c).alias(f"q{c}") for c in ("para_id", "x0", "x1", "y0", "y1", "brk"))).alias("q")
    column = (F.abs(F.col("qx0") - F.col("p.x0")) <= COLUMN_TOLERANCE) & (F.col("qbrk") | (F.col("qx1") > F.col("p.x1") + COLUMN_EXTRA))
    block = (F.col("qpara_id") != F.col("p.para_id")) & (F.col("qx0") > F.col("p.x0") + OBSTACLE_GAP) & ~((F.col("qy1") < F.col("p.y0") - OBSTACLE_OVERLAP) | (F.col("qy0") > F.col("p.y1") + OBSTACLE_OVERLAP))
    near = p.where("not brk").join(q, (F.col("p.page_id") == F.col("q.page_id")) & (column | block))
    e = near.groupBy(F.col("p.page_id").alias("page_id"), "para_id").agg(F.max(F.when(column, F.col("qx1"))).alias("col"), F.min(F.when(block, F.col("qx0"))).alias("stop"))
    j = paragraphs.join(e, ["page_id", "para_id"], "left")
    edge = F.coalesce("col", "x1")
    right = F.greatest(F.col("x1"), F.least(edge, F.coalesce(F.col("stop") - OBSTACLE_MARGIN, edge)))
    return j.withColumn("right", F.when(F.col("brk"), F.col("x1")).otherwise(right)).drop("col", "stop")


def column_edges_in_order(paragraphs: DataFrame) -> DataFrame:
    """As column_edges, but paragraphs grow one after the other (by para_id) and later ones see how far earlier ones have grown.

    A page is folded in one task, many pages at once; each step is an operation on the columns of all pages that have as many paragraphs.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += pc.sum(pc.list_value_length(part.column("paras"))).as_py() or 0
            if size >= _AT_ONCE:
                yield _grown(held)
                held, size = [], 0
        if held:
            yield _grown(held)

    p = paragraphs.select(F.col("page_id").cast("long").alias("page_id"), F.struct(F.col("para_id").cast("long").alias("para_id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")), "brk").alias("para"))
    return p.groupBy("page_id").agg(F.collect_list("para").alias("paras")).mapInArrow(run, "page_id long, para_id long, right double")


#: Paragraphs that are folded at once, at least; a page is never parted.
_AT_ONCE = 1 << 17


def _grown(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(page_id, para_id, right) of whole pages (page_id, paras), in the order of column_edges_in_order."""
    t = pa.Table.from_batches(parts).combine_chunks()
    lists = t.column("paras").combine_chunks()
    paras = lists.flatten()
    # pages with more paragraphs first: those that have an i-th one stand at the beginning
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    para = paras.field("para_id").to_numpy()
    order = np.lexsort((para, np.repeat(rank, n)))
    x0, x1, y0, y1 = (paras.field(c).to_numpy()[order] for c in ("x0", "x1", "y0", "y1"))
    wrapped = paras.field("brk").to_numpy(zero_copy_only=False)[order]
    n = n[np.argsort(rank)]
    starts = np.cumsum(n) - n
    for i in range(int(n[0]) if len(n) else 0):
        pages = np.flatnonzero(n[: np.searchsorted(-n, -i)] > i)
        pages = pages[~wrapped[starts[pages] + i]]
        if not len(pages):
            continue
        own, many = starts[pages] + i, n[pages]
        first = np.cumsum(many) - many
        at = np.arange(many.sum()) + np.repeat(starts[pages] - first, many)
        of = lambda c: np.repeat(c[own], many)  # noqa: E731,B023
        a0, a1 = x0[at], x1[at]
        column = (np.abs(a0 - of(x0)) <= COLUMN_TOLERANCE) & (wrapped[at] | (a1 > of(x1) + COLUMN_EXTRA))
        beside = (a0 > of(x0) + OBSTACLE_GAP) & (y1[at] >= of(y0) - OBSTACLE_OVERLAP) & (y0[at] <= of(y1) + OBSTACLE_OVERLAP)
        edge = np.maximum.reduceat(np.where(column, a1, -np.inf), first)
        edge = np.where(np.logical_or.reduceat(column, first), edge, x1[own])
        x1[own] = np.maximum(x1[own], np.minimum(edge, np.minimum.reduceat(np.where(beside, a0, np.inf), first) - OBSTACLE_MARGIN))
    page = np.repeat(t.column("page_id").to_numpy()[np.argsort(rank)], n)
    return pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(para[order], pa.int64()), pa.array(x1, pa.float64())], names=["page_id", "para_id", "right"])


def ink(ops: DataFrame) -> DataFrame:
    """(para_id, lidx, lo, hi): how far a line's operations (para_id, lidx, dy, ylen, size) reach below and above its baseline."""
    lo = F.col("dy") + F.least(F.lit(0.0), F.col("ylen")) - F.col("size") * DESCENT
    hi = F.col("dy") + F.greatest(F.lit(0.0), F.col("ylen")) + F.col("size") * ASCENT
    return ops.groupBy("para_id", "lidx").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def line_offsets(ink_: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(para_id, line, offset) of each baseline from (para_id, lidx, lo, hi) and (para_id, lines, size, leading, budget).

    Lines are a leading apart, more where ink needs it; extra room beyond the budget (null: none) is shared out. Lines
    without ink have none to make room for. There is one offset more than lines, the first 0.
    """
    p = paragraphs.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines").cast("int"))))
    j = p.join(ink_, (p.para_id == ink_.para_id) & (F.col("line") == F.col("lidx")), "left").select(p["*"], F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))
    order, para = Window.partitionBy("para_id").orderBy("line"), Window.partitionBy("para_id")
    base = F.col("size") * F.col("leading")
    j = j.withColumn("want", F.when(F.col("line") < F.col("lines"), F.greatest(F.lit(0.0), F.coalesce(F.lead("hi").over(order), F.lit(0.0)) - F.col("lo") - base)).otherwise(0.0))
    total = F.sum("want").over(para)
    share = F.when(F.col("budget").isNotNull() & (total > F.col("budget")), F.greatest(F.lit(0.0), F.col("budget")) / total).otherwise(1.0)
    j = j.withColumn("step", base + F.col("want") * share)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return j.select("para_id", "line", F.coalesce(F.sum("step").over(before), F.lit(0.0)).alias("offset"))


def formula_width(glyphs: DataFrame) -> DataFrame:
    """(page_id, vid, width) of formulas from their glyphs (page_id, vid, seq, x0, x1): from the first's left to the rightmost edge."""
    return glyphs.groupBy("page_id", "vid").agg((F.max("x1") - F.min_by("x0", "seq")).alias("width"))


def backing(paragraphs: DataFrame, pad: float = 3.0) -> DataFrame:
    """White rectangles behind translated paragraphs of scanned pages: (page_id, para_id, left, bottom, w, h)."""
    p = paragraphs.where(F.col("is_scanned") & (F.col("old") != F.col("new")))
    return p.select("page_id", "para_id", (F.col("x0") - pad).alias("left"), (F.col("y0") - pad).alias("bottom"), (F.col("x1") - F.col("x0") + 2 * pad).alias("w"), (F.col("y1") - F.col("y0") + 2 * pad).alias("h"))


def is_vertical(m0: Column, m3: Column) -> Column:
    """Whether a glyph's matrix turns it on its side."""
    return (m0 == 0) & (m3 == 0)


def is_script(cls: Column, last_cls: Column, said: Column, size: Column, text_size: Column, text: Column) -> Column:
    """Whether a glyph is a raised or lowered sign of the text before it: of its class, much smaller, and no letter."""
    return (cls == last_cls) & (F.length(utrim(said)) > 1) & (size < text_size * SMALL) & ~text.rlike(r"^\p{L}+$")


def start_x(x: Column, x0: Column, x1: Column) -> Column:
    """Where a translated line begins: at the paragraph's left if its first glyph stood far to the right."""
    return F.when((x > x0 + 30) & (x1 > x0 + 50), x0).otherwise(x)


def scaled_size(size: Column, text_width: Column, x0: Column, x1: Column, y0: Column, y1: Column, leading: Column) -> Column:
    """A font size that lets a translation of text_width fit; never below half."""
    rows = F.greatest(F.lit(1.0), F.bround((y1 - y0) / (size * leading)))
    room = (x1 - x0) * rows
    return F.when(text_width > room * 1.05, size * F.greatest(room / text_width, F.lit(0.5))).otherwise(size)


def page_matrix(rotate: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The matrix of six numbers that turns a page upright."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(rotate == 90, F.array(zero, -one, one, zero, -y0, x1))
        .when(rotate == 180, F.array(-one, zero, zero, -one, x1, y1))
        .when(rotate == 270, F.array(zero, one, -one, zero, y1, -x0))
        .otherwise(F.array(one, zero, zero, one, -x0, -y0))
    )


def inverse_matrix(m: Column) -> Column:
    """The inverse of a matrix of six numbers; null if it has none."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    det = a * d - b * c
    inv = [F.try_divide(d, det), F.try_divide(-b, det), F.try_divide(-c, det), F.try_divide(a, det)]
    return F.when(det != 0, F.array(*inv, -(e * inv[0] + f * inv[2]), -(e * inv[1] + f * inv[3])))


def scaled_width(width: Column, m: Column) -> Column:
    return width * F.hypot(m[0], m[1])


def rescaled_box(x: Column, y: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> tuple[Column, Column]:
    """A point of a padded, resized image in the coordinates of the page."""
    gain = F.least(from_h / to_h, from_w / to_w)
    pad = lambda size, to: F.bround((size - to * gain) / 2 - 0.1)
    return (x - pad(from_w, to_w)) / gain, (y - pad(from_h, to_h)) / gain


def is_fraction_rule(points: Column, color: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a stroked path of two points is a black horizontal line; no colour counts as black."""
    y = lambda p: p["x"] * b + p["y"] * d
    black = color.isNull() | (F.aggregate(color, F.lit(0.0), lambda s, x: s + x) == 0)
    return (F.size(points) == 2) & (y(points[0]) == y(points[1])) & black


def drawn_rules(lines: DataFrame, most: float = 5.0) -> DataFrame:
    """Rule lines that are thin enough to be drawn."""
    return lines.where(F.col("linewidth") < most)
