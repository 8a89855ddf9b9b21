"""Nearest neighbours by a block matrix join.

Vectors are scaled to length one and rounded to int8 codes with a step of their own; the length of what rounding
leaves bounds how far a product of codes can be from the cosine. Tiles of query codes times candidate codes give
each pair a lower and an upper bound; a pair survives whose upper bound reaches the k-th largest lower bound of
its query, within the tile and then over all tiles. Survivors get the cosine from the original vectors in double
precision; each task keeps a heap of the nearest of each query, and heaps merge those of all tasks. The result is exact.

Equal vectors are one class: tiles hold each once, with its k + 1 smallest ids, so copies cost no pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches

CANDIDATES = 8192  # rows of a candidate block
QUERIES = 1024  # rows of a query block
_STEP = 128  # query rows multiplied at once
_SLACK = 1e-9  # what double arithmetic may add to a bound


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, steps and lengths of the rounding rest of the rows of v (finite, not zero)."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None])
    return codes.astype(np.int8), step, np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1))


def tile_survivors(q: tuple, c: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and c whose bounds keep them among the k nearest in this tile, and the bounds."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    # products of int8 codes are summed exactly in float32 up to 1040 dimensions
    kind = np.float32 if qc.shape[1] <= 1040 else np.float64
    right = cc.astype(kind).T
    found = []
    for at in range(0, len(qc), _STEP):
        s = slice(at, at + _STEP)
        dots = (qc[s].astype(kind) @ right) * qs[s, None] * cs[None, :]
        err = qe[s, None] + ce[None, :] + qe[s, None] * ce[None, :] + _SLACK
        low = dots - err
        floor = np.partition(low, -k, axis=1)[:, -k, None] if low.shape[1] > k else -np.inf
        i, j = np.nonzero(dots + err >= floor)
        found.append((i + at, j, low[i, j], (dots + err)[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column(1).to_pylist()
    return batch.column(0).to_numpy(), np.array([np.frombuffer(x, np.float64) for x in raw])


def _packed(size: int):
    """Blocks of up to size vectors of one length: cls, codes, steps and rests as bytes."""

    def block(cls: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        codes, step, rest = quantise(v)
        return pa.RecordBatch.from_arrays([pa.array([v.shape[1]]), *(pa.array([x.tobytes()], pa.binary()) for x in (cls, codes, step, rest))], names=["dim", "cls", "codes", "steps", "rests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(len(raw) // 8, [])
                rows.append((cls, raw))
                if len(rows) == size:
                    yield block(*_rows(rows))
                    rows.clear()
        for rows in held.values():
            if rows:
                yield block(*_rows(rows))

    return run


def _rows(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.frombuffer(b"".join(r[1] for r in rows), np.float64).reshape(len(rows), -1)


_BLOCK = "dim long, cls binary, codes binary, steps binary, rests binary"


def _side(dim: int, table: pa.Table, i: int) -> tuple[np.ndarray, tuple]:
    cls = np.frombuffer(table.column("cls")[i].as_py(), np.int64)
    codes = np.frombuffer(table.column("codes")[i].as_py(), np.int8).reshape(len(cls), dim)
    return cls, (codes, np.frombuffer(table.column("steps")[i].as_py()), np.frombuffer(table.column("rests")[i].as_py()))


def cosine(a, b):
    """Cosine of two array<double> columns, summed from the first element on; null if the squares leave the range of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))))


def in_range(v):
    """An array<double> column, vectors of extreme numbers scaled by a power of two, which changes no cosine."""
    most = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double"))))
    return F.when(most.between(1e-60, 1e60), v).otherwise(F.transform(F.array(power), lambda p: F.transform(v, lambda x: x * p))[0])


class _Nearest:
    """The k + 1 nearest (score, id) of each query, on heaps: the worst kept is on top."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, q: int, score: float, i: int) -> None:
        heap = self.heaps.setdefault(q, [])
        if len(heap) <= self.k:
            heapq.heappush(heap, (score, -i))
        else:
            heapq.heappushpop(heap, (score, -i))

    def rows(self) -> pa.Table:
        """All that is kept, nearest first, ties by id."""
        flat = [(q, -i, s) for q, heap in self.heaps.items() for s, i in sorted(heap, reverse=True)]
        return pa.table({"q": pa.array([x[0] for x in flat], pa.int64()), "id": pa.array([x[1] for x in flat], pa.int64()), "score": pa.array([x[2] for x in flat], pa.float64())})


#: Queries whose heaps a task holds before it passes them on.
HEAPS = 100_000


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each query the k rows of largest cosine, ties to smaller ids.

    is_query: a condition on id_col, a long. Rows take no part whose id is null or whose vector is null, empty, zero or
    holds nulls or values that are not finite. A query never gets rows of its own id; vectors of another length are
    no candidates. Fewer candidates give fewer rows. Repeated rows of one id and vector count once. An id of several
    vectors has one list, of the nearest to any of them, and may stand in a list with each. Other columns are left out.
    """
    num = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall(num, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(num, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), num.alias("v"), is_query.alias("asks"))
    rows = materialize(rows.withColumn("v", in_range(F.col("v"))), "vectors")

    near = Window.partitionBy("v").orderBy("id")
    least = rows.select("v", "id").withColumn("n", F.dense_rank().over(near)).where(F.col("n") <= k + 1)
    kept = least.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asked = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    classes = kept.join(asked, "v").withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")

    raw = _raw(classes)
    cand = materialize(raw.select("cls", "raw").mapInArrow(lean(_packed(CANDIDATES)), _BLOCK).withColumn("n", F.monotonically_increasing_id()), "candidates")
    asks = materialize(raw.where("asks").select("cls", "raw").mapInArrow(lean(_packed(QUERIES)), _BLOCK), "queries")
    # each candidate block goes to one task, which all query blocks pass through: what is sent grows with queries times blocks
    names = cand.groupBy("dim").agg(F.collect_list("n").alias("ns"))
    right = cand.select("n", F.lit(0).alias("side"), "dim", "cls", "codes", "steps", "rests")
    left = asks.join(names, "dim").select(F.explode("ns").alias("n"), F.lit(1).alias("side"), "dim", "cls", "codes", "steps", "rests")

    def tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for part in parts:
            table = pa.Table.from_batches([part])
            for r, (side, dim) in enumerate(zip(table.column("side").to_pylist(), table.column("dim").to_pylist(), strict=True)):
                cls, vectors = _side(dim, table, r)
                if side == 0:
                    block = cls, vectors
                    continue
                i, j, low, high = tile_survivors(vectors, block[1], k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(block[0][j]), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], names=["q", "c", "low", "high"])

    def merge(table: pa.Table) -> pa.Table:
        floor = min(heapq.nlargest(k + 1, table.column("low").to_pylist()))
        return table.filter(pa.compute.greater_equal(table.column("high"), floor)).select(["q", "c"])

    small_batches(rows.sparkSession)
    pairs = right.unionByName(left).repartition("n").sortWithinPartitions("n", "side").mapInArrow(lean(tiles), "q long, c long, low double, high double")
    pairs = materialize(pairs.groupBy("q").applyInArrow(merge, "q long, c long"), "survivors")
    scored = (
        pairs.join(classes.select(F.col("cls").alias("c"), F.col("v").alias("cv"), "ids"), "c")
        .join(classes.select(F.col("cls").alias("q"), F.col("v").alias("qv")), "q")
        .select("q", F.explode("ids").alias("id"), cosine(F.col("qv"), F.col("cv")).alias("score"))
    )

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(k)
        for part in parts:
            for q, i, score in zip(*(c.to_pylist() for c in part.columns), strict=True):
                best.add(q, score, i)
            if len(best.heaps) > HEAPS:
                yield from best.rows().to_batches()
                best = _Nearest(k)
        yield from best.rows().to_batches()

    def merged(table: pa.Table) -> pa.Table:
        best = _Nearest(k)
        for q, i, score in zip(*(c.to_pylist() for c in table.columns), strict=True):
            best.add(q, score, i)
        return best.rows()

    kind = "q long, id long, score double"
    top = scored.mapInArrow(lean(kept), kind).groupBy("q").applyInArrow(merged, kind).groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score")).alias("top"))
    queries = rows.where("asks").select("id", "v").distinct().join(classes.select("v", F.col("cls").alias("q")), "v").select("id", "q")
    mine = queries.join(top, "q").select("id", F.slice(F.array_sort(F.filter("top", lambda x: x["id"] != F.col("id"))), 1, k).alias("top"))
    mine = mine.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return mine.select("id", F.posexplode("top").alias("at", "hit")).select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))


def _raw(classes: DataFrame) -> DataFrame:
    """The vectors as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
            raw = [values[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["cls", "asks", "raw"])

    return classes.select("cls", "asks", "v").mapInArrow(lean(run), "cls long, asks boolean, raw binary")
