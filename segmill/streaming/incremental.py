"""Segments that arrive as files: each micro-batch is looked up and checked, and lands as a folder of its own.

An extension; the state that a batch leads to is the caller's next snapshot (operators.state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import terms, validate

SCHEMA = "segment_id long, source string"


def checked(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments with translation, is_hit, issues and is_valid; works on streams as on tables."""
    return validate.validate(terms.translate(segments, terms.clean_memory(memory)))


def run(spark: SparkSession, source: str, memory: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream of JSON files in source; a batch that is repeated overwrites its own folder, so each counts once."""
    stream = spark.readStream.schema(SCHEMA).json(source)

    def land(batch: DataFrame, number: int) -> None:
        checked(batch, memory).select("segment_id", "translation", "is_hit", "is_valid", F.size("issues").alias("issues")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    w = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
