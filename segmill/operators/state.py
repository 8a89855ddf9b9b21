"""Segment state: a snapshot table that reconciling and event logs turn into the next one.

Nothing is updated in place: each step is a join or an aggregate that gives a new snapshot, for the caller to write beside
the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, source_hash, utrim

COLUMNS = ("segment_id", "source_text", "source_hash", "status", "translation", "model", "timestamp", "retry_count", "tokens_in", "tokens_out", "error")
MAX_RETRIES = 3


def new_state(segments: DataFrame) -> DataFrame:
    """Pending rows for (segment_id, source_text)."""
    return segments.select(
        "segment_id", "source_text", source_hash(F.col("source_text")).alias("source_hash"), F.lit("pending").alias("status"), F.lit("").alias("translation"), F.lit("").alias("model"),
        F.lit(0.0).alias("timestamp"), F.lit(0).alias("retry_count"), F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit("").alias("error"),
    )


def reconcile(state: DataFrame, segments: DataFrame, prune: bool = False) -> DataFrame:
    """The state for a new list of segments: new ones pending, changed ones pending again, unchanged ones as they were.

    A change clears translation and error and keeps retries, model and time. Segments that are no longer listed stay,
    unless prune is set.
    """
    new = new_state(segments)
    s, n = state.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.segment_id") == F.col("n.segment_id"), "right" if prune else "full")
    old, gone = F.col("s.segment_id").isNotNull(), F.col("n.segment_id").isNull()
    same = gone | F.col("s.source_hash").eqNullSafe(F.col("n.source_hash"))
    fresh = ("source_text", "source_hash", "status", "translation", "error")
    pick = lambda c: F.when(old & (same if c in fresh else F.lit(True)), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(F.coalesce("s.segment_id", "n.segment_id").alias("segment_id"), *(pick(c).alias(c) for c in COLUMNS[1:]))


def fold_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after a log of (segment_id, seq, event, payload), event completed (payload: translation) or failed (error).

    The last event sets the status and the time; each failure adds a retry; translation, model and tokens are those of the
    last completion, the error that of the last failure. The log may have at (seconds; else seq is the time), model,
    tokens_in and tokens_out. Unknown events and segments change nothing. One aggregation with partial sums, so a hot
    segment costs a row a task.
    """
    given = lambda c, kind, default: (F.col(c).cast(kind) if c in events.columns else default.cast(kind)).alias(c)
    none = F.lit(None)
    entry = F.struct("seq", "event", "payload", given("at", "double", F.col("seq")), given("model", "string", none), given("tokens_in", "int", none), given("tokens_out", "int", none))
    done, failed = F.col("event") == "completed", F.col("event") == "failed"
    last = lambda cond: F.max(F.when(cond, entry))
    e = events.where(done | failed).groupBy("segment_id").agg(last(done | failed).alias("l"), last(done).alias("d"), last(failed).alias("f"), F.count_if(failed).alias("failures"))
    j = state.join(e, "segment_id", "left")
    new = {
        "status": F.coalesce("l.event", "status"),
        "translation": F.coalesce("d.payload", "translation"),
        "error": F.coalesce("f.payload", "error"),
        "retry_count": (F.col("retry_count") + F.coalesce("failures", F.lit(0))).cast("int"),
        "timestamp": F.coalesce("l.at", "timestamp"),
        "model": F.coalesce("d.model", "model"),
        "tokens_in": F.coalesce("d.tokens_in", "tokens_in"),
        "tokens_out": F.coalesce("d.tokens_out", "tokens_out"),
    }
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in COLUMNS))


def run_events(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Events (segment_id, run, seq, event, payload) from the attempts (segment_id, run, attempt from 1, seq, outcome, payload) of runs.

    A run ends with the first attempt that is ok or invalid (a translation that fails its checks is not tried again), or
    with the exception that comes after max_retries others; its failures count once. Runs that have not ended give none.
    """
    ends = F.col("outcome").isin("ok", "invalid") | ((F.col("outcome") == "exception") & (F.col("attempt") > max_retries))
    last = attempts.groupBy("segment_id", "run").agg(F.min(F.when(ends, F.struct("attempt", "seq", "outcome", "payload"))).alias("e")).where("e is not null")
    payload = F.when(F.col("e.outcome") == "invalid", F.concat(F.lit("validation: "), "e.payload")).otherwise(F.col("e.payload"))
    return last.select("segment_id", "run", "e.seq", F.when(F.col("e.outcome") == "ok", "completed").otherwise("failed").alias("event"), payload.alias("payload"))


def skip_trivial(state: DataFrame) -> DataFrame:
    """Pending segments without two characters are completed as they are."""
    skip = (F.col("status") == "pending") & (F.length(utrim(F.col("source_text"))) < 2)
    new = {"status": F.lit("completed"), "translation": F.col("source_text"), "model": F.lit("skip")}
    return state.select(*(F.when(skip, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in COLUMNS))


def pending(state: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """What is to be translated: pending, or failed with retries left."""
    return state.where((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < max_retries)))


def stats(state: DataFrame) -> DataFrame:
    """Segments by status (null: unknown) and in total."""
    g = state.rollup("status").agg(F.grouping("status").alias("__all"), F.count("*").alias("segments"))
    return g.select(F.when(F.col("__all") == 1, "total").otherwise(F.coalesce("status", F.lit("unknown"))).alias("status"), "segments")


def is_complete(state: DataFrame) -> DataFrame:
    """One row: whether no segment is left; true without segments. Segments without a status are left."""
    return state.agg((F.count_if(~F.col("status").eqNullSafe(F.lit("completed"))) == 0).alias("is_complete"), F.count("*").alias("segments"))


def export(state: DataFrame) -> DataFrame:
    """Completed segments as JSON lines of src and dst, with the order they are to be written in."""
    return state.where("status = 'completed'").select("segment_id", F.to_json(F.struct(F.col("source_text").alias("src"), F.col("translation").alias("dst"))).alias("line"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with rows of the same keys replaced; of several new rows the last in order."""
    cols = [c for c in table.columns if c not in keys]
    old = table.select(*table.columns, F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__at"))
    new = rows.select(*table.columns, F.lit(1).alias("__new"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("__at"))
    last = F.max(F.struct("__new", "__at", *cols))
    return old.unionByName(new).groupBy(*keys).agg(last.alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in cols)).select(*table.columns)


def blank_or_formula(text: str = "source_text"):
    """Segments that need no service: blank, or one formula only."""
    return is_blank(F.col(text)) | F.col(text).rlike(r"^\{v[0-9]+\}$")
