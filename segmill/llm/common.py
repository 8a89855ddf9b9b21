"""What the operators of this subpackage share: written tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import work_dir as shared_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(written: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing is read from it any more."""
    remove_path(written.sparkSession, written.written_to)


#: Keys whose rows are more than one in so many of all go by broadcast; so many keys at most.
HOT_KEYS = 10_000
#: A key of fewer rows is never hot.
HOT_LEAST = 1_000


def spread_join(rows: DataFrame, side: DataFrame, key: str, often: str = "n") -> DataFrame:
    """rows joined (inner) with side, both written tables, by a column of one name; side has one row for each key.

    often: a column of side, how many rows have the key. The rows of hot keys stay where they are and meet a broadcast of
    HOT_KEYS rows at most; the others are dealt by key, none of which has more than its share.
    """
    total = side.agg(F.sum(often)).first()[0] or 0
    bound = max(total // HOT_KEYS, HOT_LEAST)
    hot = side.where(F.col(often) > bound)
    if hot.isEmpty():
        return rows.join(side, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side.where(F.col(often) <= bound), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of 256 rows: Spark's default of 10,000 is many MB for each task, on both sides.

    The setting stays with the session, as plans read it when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def give_back() -> None:
    """Return to the system what this worker has freed, so that it is small when it is idle."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back its memory at the end of a task."""

    def all_(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        give_back()

    return all_


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from columns by name."""
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
