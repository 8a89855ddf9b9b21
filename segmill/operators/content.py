"""Content streams as tables: glyphs from codes, operators that stay, paths, forms within forms, fonts and colour spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .typeset import components

# Operators that are left out, beside all that begin with T; those that end a path without drawing it anew.
DROPPED = ('"', "'", "EI", "MP", "DP", "BMC", "BDC", "BI", "ID", "EMC")
CLEARING = ("f", "f*", "B", "B*", "S", "s", "n", "b", "b*")
BUILDING = ("m", "l", "c", "v", "y", "h", "re")


def glyphs(codes: DataFrame, fonts: DataFrame) -> DataFrame:
    """Glyphs (page_id, run, seq, text, x0, x1, y0, advance) from codes (page_id, run, seq, code, font, size, scaling, x, y) and fonts (font, code, text, width).

    A code that its font does not know is shown as (cid:n) and has no width. x is where a run begins; each glyph stands
    behind the advances of those before it.
    """
    f = fonts.select("font", "code", "text", "width")
    j = codes.join(f, ["font", "code"], "left")
    j = j.withColumns({"text": F.coalesce("text", F.concat(F.lit("(cid:"), F.col("code").cast("string"), F.lit(")"))), "advance": F.coalesce("width", F.lit(0.0)) * F.col("size") * F.col("scaling")})
    before = Window.partitionBy("page_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x0 = F.col("x") + F.coalesce(F.sum("advance").over(before), F.lit(0.0))
    return j.select("page_id", "run", "seq", "text", x0.alias("x0"), (x0 + F.col("advance")).alias("x1"), F.col("y").alias("y0"), "advance")


def is_kept(op: Column) -> Column:
    """Whether an operator stays in a page's background: text and marked content do not."""
    return ~(op.startswith("T") | op.isin(*DROPPED))


def op_text(op: Column, operands: Column) -> Column:
    """An operator behind its operands (texts; what looks like a fraction has six places, quotes go)."""
    number = lambda x: F.when(x.rlike(r"^-?[0-9]*\.[0-9]+$"), F.format_string("%.6f", x.try_cast("double"))).otherwise(F.replace(x, F.lit("'"), F.lit("")))
    return F.concat(F.array_join(F.transform(operands, number), " "), F.lit(" "), op, F.lit(" "))


def background(ops: DataFrame) -> DataFrame:
    """(stream_id, ops): the operators (stream_id, seq, op, operands) of each stream that stay, in order, as one text."""
    kept = ops.select("stream_id", F.when(is_kept(F.col("op")), F.struct("seq", op_text(F.col("op"), F.col("operands")).alias("t"))).alias("k"))
    return kept.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["t"]), "").alias("ops"))


def paths(ops: DataFrame) -> DataFrame:
    """(stream_id, path, painted by, segments): what was built between two operators that end a path, in order."""
    order = Window.partitionBy("stream_id").orderBy("seq")
    ends = F.col("op").isin(*CLEARING)
    p = ops.withColumn("path", F.sum(ends.cast("int")).over(order) - ends.cast("int")).where(ends | F.col("op").isin(*BUILDING))
    built = F.array_sort(F.collect_list(F.when(~ends, F.struct("seq", "op", "operands"))))
    return p.groupBy("stream_id", "path").agg(F.max(F.when(ends, F.col("op"))).alias("painter"), F.transform(built, lambda x: F.struct(x["op"].alias("op"), x["operands"].alias("operands"))).alias("segments"))


def product(m: Column, n: Column) -> Column:
    """The matrix that applies m, then n; both of six numbers."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    p, q, r, s, t, u = (n[i] for i in range(6))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def frames(roots: DataFrame, uses: DataFrame, most: int = 64) -> DataFrame:
    """(root_id, form_id, depth, ctm) of all forms drawn within roots (root_id, ctm), through uses (parent_id, form_id, matrix).

    A form that is drawn within itself is not followed further. Forms nested deeper than `most` are an error.
    """
    level = roots.select("root_id", F.col("root_id").alias("form_id"), F.lit(0).alias("depth"), "ctm", F.array("root_id").alias("trail"))
    out, u = [], uses.select("parent_id", F.col("form_id").alias("inner"), "matrix")
    for depth in range(1, most + 2):
        j = level.join(u, F.col("form_id") == F.col("parent_id")).where(~F.array_contains("trail", F.col("inner")))
        level = j.select("root_id", F.col("inner").alias("form_id"), F.lit(depth).alias("depth"), product(F.col("matrix"), F.col("ctm")).alias("ctm"), F.concat("trail", F.array("inner")).alias("trail"))
        level = written(level, "frames")
        if level.isEmpty():
            break
        if depth > most:
            raise ValueError(f"forms are nested deeper than {most}")
        out.append(level)
    if not out:
        return level.drop("trail")
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.drop("trail")


def resources(specs: DataFrame) -> DataFrame:
    """specs (kind, name, spec, declared, names) with components for colour spaces (null: unknown) and descent 0 for fonts."""
    space = F.when(F.col("kind") == "ColorSpace", components(F.col("spec"), F.col("declared"), F.col("names")))
    return specs.withColumns({"components": space, "descent": F.when(F.col("kind") == "Font", 0.0)})
