"""JSON lines with numbered lines and a policy for what is wrong with them, and directories as tables.

from_json would turn the number in {"src": 1} into text, so values are read as variants and their types are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, utrim


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of small text files; each file is read whole, as line numbers need."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("i", "line")).select("file", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def parsed(lines: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """lines without blank ones, with a column for each key (null: absent or no text) and problem.

    problem: null, invalid JSON, missing <key> (the first of keys that is absent), or type <key> (one that is no text).
    """
    v = F.try_parse_json(F.col(line_col))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("__v", f"$.{k}", "variant"))
    rows = lines.where(~is_blank(F.col(line_col))).withColumn("__v", v)
    rows = rows.withColumns({k: F.when(kind(k) == "STRING", F.try_variant_get("__v", f"$.{k}", "string")) for k in keys} | {f"__{k}": kind(k) for k in keys})
    object_ = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    problem = F.when(~object_, "invalid JSON")
    for k in keys:
        problem = problem.when(F.col(f"__{k}").isNull() | (F.col(f"__{k}") == "VOID"), f"missing {k}")
    for k in keys:
        problem = problem.when(F.col(f"__{k}") != "STRING", f"type {k}")
    return rows.withColumn("problem", problem).drop("__v", *(f"__{k}" for k in keys))


def first_error(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The first problem of each group, with its line."""
    bad = rows.where(F.col("problem").isNotNull())
    return bad.groupBy(*groups).agg(F.min(F.struct("line_no", "problem")).alias("e")).select(*groups, "e.line_no", "e.problem")


def strict(rows: DataFrame) -> DataFrame:
    """rows, or an error that names the line, once they are read."""
    text = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem"))
    return rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("problem")


def segments(lines: DataFrame) -> DataFrame:
    """(file, segment_id from 0, source) of the lines of segment files, in their order; a line without a text src is an error."""
    rows = strict(parsed(lines, ["src"]))
    order = Window.partitionBy("file").orderBy("line_no")
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("segment_id"), F.col("src").alias("source"))


def glossary_rows(lines: DataFrame) -> DataFrame:
    """(…, en, vi, notes) of well-formed lines with both texts; the others are skipped one by one. notes may be absent."""
    r = parsed(lines.withColumn("__l", F.col("line")), ["en", "vi"])
    notes = F.coalesce(F.try_variant_get(F.try_parse_json("line"), "$.notes", "string"), F.lit(""))
    return r.where("problem is null").withColumn("notes", utrim(notes)).withColumns({"en": utrim(F.col("en")), "vi": utrim(F.col("vi"))}).where("en != '' and vi != ''").drop("problem", "__l")


def prompt_glossary(lines: DataFrame, groups: list[str]) -> DataFrame:
    """The glossary part of a prompt for each group: its lines in order, all of them; empty if one line is no JSON."""
    r = parsed(lines, ["en", "vi"])
    line = F.when((F.col("en") != "") & (F.col("vi") != ""), F.concat(F.lit("  "), "en", F.lit(" = "), "vi"))
    g = r.groupBy(*groups).agg(F.bool_or(F.col("problem") == "invalid JSON").alias("bad"), F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("line_no", line.alias("x"))))).alias("l"))
    return g.select(*groups, F.when(F.coalesce("bad", F.lit(False)), "").otherwise(F.array_join(F.transform("l", lambda x: x["x"]), "\n")).alias("glossary"))


def profile_summary(lines: DataFrame, groups: list[str]) -> DataFrame:
    """Checks of a profile's glossary: terms before the first problem that stops it, and that problem. Types are not looked at."""
    r = parsed(lines, ["en", "vi"]).withColumn("stop", F.when(F.col("problem").startswith("invalid"), "invalid JSON").when(F.col("problem").startswith("missing"), "missing 'en' or 'vi'"))
    e = r.groupBy(*groups).agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("line_no", "stop"))).alias("e"))
    j = r.join(e, groups).groupBy(*groups).agg(F.count_if(F.col("e").isNull() | (F.col("line_no") < F.col("e.line_no"))).alias("terms"), F.first("e").alias("e"))
    return j.select(*groups, "terms", F.when(F.col("e").isNotNull(), F.concat(F.lit("Line "), F.col("e.line_no").cast("string"), F.lit(" "), F.col("e.stop"))).alias("error"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of the files of a directory, not of those below it."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def collected(listed: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """Files from (path, ord, parent): those with the suffix, once each, where they were first named; in a directory by name."""
    p = listed.where(F.lower("path").endswith(suffix)).withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1)))
    return p.groupBy("path").agg(F.min(F.struct("ord", "name")).alias("at")).select("path", "at.ord", "at.name")


def is_document(content: Column, name: Column) -> Column:
    """Whether a file is named as a PDF and has its mark within the first 1,024 bytes."""
    return F.lower(name).endswith(".pdf") & (F.position(F.lit("255044462D"), F.hex(F.substring(content, 1, 1024))) > 0)


def missing(names: DataFrame, present: DataFrame) -> DataFrame:
    """Names (path) that are no links and that no listed file has."""
    return names.where(~F.col("path").rlike("^https?://")).join(present.select("path"), "path", "left_anti")


def write_lines(lines: DataFrame, path: str, order: str | None = None) -> None:
    """Lines as text; in one file and in order if one is given. An existing path is an error."""
    out = lines.orderBy(order).select("line").coalesce(1) if order else lines.select("line")
    out.write.text(path)
