"""Benchmark decontamination by greedy string tiling.

Texts are read as words (lower case, ASCII punctuation as spaces). A pair of a document and a benchmark item is looked at
if they share a seed, a run of MIN_MATCH words, found by a running Karp-Rabin hash. Tiling then marks the longest match of
unmarked words again and again until none of MIN_MATCH words is left; an item counts as leaked into a document if the
tiles cover enough of its words, in whatever order they stand.

Documents meet the items' seeds first in a Bloom filter of fixed size, so that a document without any costs no shuffle;
the rest is joined by seed. An item's commonest seeds, which could not reach the coverage if all of them were hit, are left
out of that join, so that a phrase of many items and documents does not multiply them. Nothing that is broadcast grows with
documents or items. Items of fewer than MIN_MATCH words have no seed; they match texts that consist of the same words.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches

MIN_MATCH = 4
COVERAGE = 0.5
#: Bits of the filter, as 64-bit words that the driver gathers: 2^18 rows at most, 2 MB.
BLOOM_BITS = 1 << 24
#: Rows up to which the ids of leaked documents are broadcast to filter documents.
BROADCAST_ROWS = 100_000

_PLAIN = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_BASE = np.uint64(0x100000001B3 | 0x5DEECE66D << 24)


class _Hashes(dict):
    MOST = 200_000

    def __missing__(self, w: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_hashes = _Hashes()


def forget() -> None:
    """At the end of a task: an idle worker holds no hashes."""
    _hashes.clear()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def seeds_of(words: list[bytes], size: int = MIN_MATCH) -> np.ndarray:
    """Hash of the run of `size` words that begins at each word; none for shorter texts."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _BASE + h[k : k + n]
    return out


def keys_of(words: list[bytes], size: int = MIN_MATCH) -> np.ndarray:
    """The seeds, or one hash of all words where there are fewer than `size`; none without words."""
    if not words or len(words) >= size:
        return seeds_of(words, size)
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)


def tiles(doc: list[bytes], item: list[bytes], size: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of greedy string tiling: longest first, ties by start in item, then in doc."""
    if len(item) < size:
        return [(0, 0, len(item))] if item and doc == item else []
    where = defaultdict(list)
    for j, h in enumerate(seeds_of(item, size).tolist()):
        where[h].append(j)
    ds = seeds_of(doc, size)
    hits = np.flatnonzero(np.isin(ds, np.fromiter(where, np.uint64, len(where)))).tolist()
    runs: dict[int, list[int]] = {}  # by diagonal: the run that is still open
    heap = []
    for i in hits:
        for j in where[int(ds[i])]:
            if doc[i : i + size] != item[j : j + size]:
                continue
            run = runs.get(i - j)
            if run and run[0] + run[2] == i + size - 1:
                run[2] += 1
            else:
                if run:
                    heap.append((-run[2], run[1], run[0]))
                runs[i - j] = [i, j, size]
    heap += [(-n, j, i) for i, j, n in runs.values()]
    heapq.heapify(heap)
    marked_doc, marked_item, out = set(), set(), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = [i + k not in marked_doc and j + k not in marked_item for k in range(n)]
        if all(free):
            marked_doc.update(range(i, i + n))
            marked_item.update(range(j, j + n))
            out.append((i, j, n))
            continue
        k = 0
        while k < n:  # what other tiles have left of it
            m = k
            while m < n and free[m]:
                m += 1
            if m - k >= size:
                heapq.heappush(heap, (k - m, j + k, i + k))
            k = max(m, k + 1)
    return out


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of the filter for each seed."""
    mask = np.uint64(BLOOM_BITS - 1)
    return (seeds & mask).astype(np.int64), ((seeds >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask).astype(np.int64)


def _item_seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for item, text in zip(part.column(0), part.column(1).to_pylist(), strict=True):
            w = words_of(text)
            s = keys_of(w)
            if len(s):
                a, b = _bits(s)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(s), part.column(0).type), pa.array(s.view(np.int64)), pa.array(a), pa.array(b), pa.array([len(w)] * len(s))], names=["no", "seed", "a", "b", "n"])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, item id, matched_words, n_tiles, coverage, text_hash) of each row of docs and item with tiles over at least `coverage` of the item's words.

    Null texts have no words. Items of fewer than MIN_MATCH words match texts of the same words only, items without words nothing. Null ids are kept as such. Repeated rows
    of docs give repeated rows; repeated items count once if id and text are equal. text_hash is xxhash64 of the document's
    text, to find its row again; other columns are left out.
    """
    small_batches(docs.sparkSession)
    d, kind, of = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    i = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).distinct()
    i = materialize(i.withColumn("no", F.monotonically_increasing_id()), "items")
    seeds = materialize(i.select("no", "text").mapInArrow(lean(_item_seeds), "no long, seed long, a long, b long, n long"), "seeds")
    spots = seeds.select(F.explode(F.array("a", "b")).alias("bit"))
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    for r in spots.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect():
        table[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        for part in parts:
            rows = {"at": [], "seeds": []}
            for at, text in enumerate(part.column(1)):
                s = keys_of(words_of(text.as_py()))
                if len(s):
                    a, b = _bits(s)
                    s = s[bits[a] & bits[b]]
                if len(s):
                    rows["at"].append(at)
                    rows["seeds"].append(np.unique(s).view(np.int64))
            if rows["at"]:
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows["at"])) for c in (0, 1)), pa.array(rows["seeds"], pa.list_(pa.int64()))], names=["id", "text", "seeds"])
        forget()

    near = materialize(d.mapInArrow(lean(find), f"id {kind}, text string, seeds array<long>").withColumn("row", F.monotonically_increasing_id()), "near")
    each = near.select("row", F.explode("seeds").alias("seed"))
    # each seed that is hit can cover MIN_MATCH words at most
    least = F.ceil(F.col("n") * coverage / MIN_MATCH)
    times = seeds.groupBy("no", "seed").agg(F.count("*").alias("times"), F.first("n").alias("n")).join(each.groupBy("seed").agg(F.count("*").alias("docs")), "seed")
    common = Window.partitionBy("no").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    rare = materialize(times.withColumn("upto", F.sum("times").over(common)).where(F.col("upto") >= least).select("no", "seed"), "rare")
    pairs = each.join(rare, "seed").select("row", "no").distinct()
    own = i.join(seeds.groupBy("no").agg(F.collect_list("seed").alias("own"), F.first("n").alias("n")), "no").select("no", "item", F.col("text").alias("passage"), "own", "n")

    def tile(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = {"matched": [], "tiles": [], "coverage": []}
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                item = words_of(b)
                t = tiles(words_of(a), item)
                out["matched"].append(sum(x[2] for x in t))
                out["tiles"].append(len(t))
                out["coverage"].append(out["matched"][-1] / len(item))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out["matched"]), pa.array(out["tiles"]), pa.array(out["coverage"]), part.column(4)], names=["id", "item", "matched_words", "n_tiles", "coverage", "text_hash"])

    both = pairs.join(near.select("row", "id", F.col("text").alias("doc"), "seeds"), "row").join(own, "no")
    both = both.where(F.size(F.filter("own", lambda x: F.array_contains("seeds", x))) >= least)
    found = both.select("id", "item", "doc", "passage", F.xxhash64("doc").alias("text_hash")).mapInArrow(lean(tile), f"id {kind}, item {of}, matched_words long, n_tiles long, coverage double, text_hash long")
    return found.where(F.col("coverage") >= coverage).withColumnsRenamed({"id": id_col, "item": item_col} if id_col != "item" else {"item": item_col})


def filter_docs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that no item leaked into, with all their columns, whatever their names."""
    inner = [f"__{i}" for i in range(len(docs.columns))]
    key, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    d = docs.toDF(*inner)
    found = leaks(d.select(F.col(key).alias("id"), F.col(text).alias("text")), items, "id", "text", **options)
    bad = materialize(found.select(F.col("id").alias("bad"), "text_hash").distinct(), "leaks")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return d.join(side, F.col(key).eqNullSafe(F.col("bad")) & (F.xxhash64(F.col(text).cast("string")) == F.col("text_hash")), "left_anti").toDF(*docs.columns)
