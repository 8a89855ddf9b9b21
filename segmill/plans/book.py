"""A book as one program: pages, segments, memory, checks, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, terms, validate


def status(lines: DataFrame, memory: DataFrame) -> DataFrame:
    """(kind, status, segments, warnings) of lines (page_id, pos, line) with a memory of (src, dst, line_no).

    Pages whose layout is kept are counted as such. The other lines are looked up; misses are pending, and what fails a check
    has failed.
    """
    kinds = classify.page_kinds_by_line(lines).select("page_id", F.coalesce("kind", F.lit("PROSE")).alias("kind"))
    segments = lines.join(kinds, "page_id")
    kept = segments.where("kind != 'PROSE'").groupBy("kind").agg(F.lit("kept").alias("status"), F.count("*").alias("segments"), F.lit(0).cast("long").alias("warnings"))
    done = validate.validate(terms.translate(segments.where("kind = 'PROSE'"), terms.clean_memory(memory), "line"), "line")
    state = F.when(~F.col("is_valid"), "failed").when(F.col("is_hit"), "completed").otherwise("pending")
    warnings = F.size(F.filter("issues", lambda i: i["severity"] == "warning"))
    counts = done.groupBy("kind", state.alias("status")).agg(F.count("*").alias("segments"), F.sum(warnings).cast("long").alias("warnings"))
    return counts.unionByName(kept)
