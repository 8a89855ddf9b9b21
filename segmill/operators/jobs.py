"""States of files in a queue, and how much of a run each part took."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import blank_or_formula

T = TypeVar("T")


def queue_states(files: DataFrame, failed: Column, exists: Column, finished: Column, untranslated: Column) -> DataFrame:
    """files with state: failed, skipped (a result is there), done, partial (segments kept their text) or queued."""
    return files.withColumn("state", F.when(failed, "failed").when(exists, "skipped").when(finished & (untranslated > 0), "partial").when(finished, "done").otherwise("queued"))


def runnable(files: DataFrame) -> DataFrame:
    return files.where(F.col("state").isin("queued", "failed"))


def queue_summary(files: DataFrame, groups: list[str]) -> DataFrame:
    """Files by state for each group."""
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    return files.groupBy(*groups).agg(of("queued", "failed").alias("runnable"), of("done").alias("done"), of("partial").alias("partial"), F.count("*").alias("files"))


def fraction(done_files: Column, done: Column, total: Column, files: Column) -> Column:
    """Progress of a queue: finished files and the part of the one that runs."""
    return (done_files + F.coalesce(F.try_divide(done.cast("double"), total.cast("double")), F.lit(0.0))) / F.greatest(files, F.lit(1))


def page_total(files: DataFrame) -> DataFrame:
    """Pages of all files; 0 if one could not be counted (null)."""
    return files.agg(F.when(F.count_if(F.col("pages").isNull()) > 0, 0).otherwise(F.coalesce(F.sum("pages"), F.lit(0))).alias("pages"))


def shares(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Sums by group with their share of the whole: the whole is one row, so that the join needs no window over all."""
    g = rows.groupBy(*groups).agg(F.sum(value).alias(value))
    whole = g.agg(F.sum(value).alias("__all"))
    return g.join(F.broadcast(whole)).withColumn("share", F.try_divide(value, "__all")).drop("__all")  # one row


def untranslated(segments: DataFrame, groups: list[str]) -> DataFrame:
    """Segments of each group, and how many kept their text though a service should have changed it: neither blank nor one formula."""
    kept = ~blank_or_formula("source") & (F.col("translation").isNull() | (F.col("translation") == F.col("source")))
    return segments.groupBy(*groups).agg(F.count("*").alias("segments"), F.count_if(kept).alias("untranslated"))


class Cancellable:
    """A Spark action that can be watched and stopped from another thread, by the tag of its jobs."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def run(self, action: Callable[[], T]) -> T:
        self.spark.addTag(self.tag)
        try:
            return action()
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> list[str]:
        """Stop what runs under the tag."""
        return self.spark.interruptTag(self.tag)

    def fraction(self) -> float:
        """Tasks done of those of the stages that run now; 0 without any."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s)) is not None]
        return sum(i.numCompletedTasks for i in infos) / max(sum(i.numTasks for i in infos), 1)
