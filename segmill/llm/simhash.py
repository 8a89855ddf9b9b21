"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit parts. Two
fingerprints that differ in r bits differ by r at most in the sum of these counts' differences, so tile pairs
(and, inside one, pairs of blocks) whose counts are further apart are skipped; the others are compared in full
by exclusive-or and bit counts. A tile pair gives a spanning forest of its links, not all of them, so that a
large group of near copies costs a row for each member and tile, not one for each pair.

filter_docs takes these links as candidates only: the shingle sets of what they connect are compared, exactly but for
collisions of 64-bit hashes, and only pairs of the least similarity are links.

On the driver: the histogram of the counts, at most 17^4 rows whatever the input, and the tiles' bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mixed
from .common import lean, materialize, small_batches, spread_join
from .components import connected_components

SEED = 42
#: Least fingerprints of a tile; it grows with the square root of their number so that what tiles are sent to grows less than pairs do.
TILE = 16384
TILE_MOST = 1 << 20
_CHUNK = 1 << 14
_ROWS, _COLS = 128, 2048


def fingerprint(data: bytes, width: int, words64: int = 1) -> np.ndarray:
    """64 bits for each of words64: 1 where over half of the shingles' hashes have a 1; no words: 0.

    The first word is of XXH64 with seed 42; the others are of numbers drawn from it.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(words64, np.uint64)
    text = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(text)]
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64 * words64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([one(text[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], np.uint64)
        wide = np.stack([h, *(mixed(h + np.uint64(k)) for k in range(1, words64))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text_col: str, width: int, words64: int = 1) -> DataFrame:
    """All columns of docs but the text, with fp (the first 64 bits as a signed long) and rest (the others, as bytes)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint((x or "").encode(), width, words64) for x in part.column(len(keep)).to_pylist()], np.uint64).reshape(-1, words64)
            rest = [x.tobytes() for x in fps[:, 1:]]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64)), pa.array(rest, pa.binary())], names=[*keep, "fp", "rest"])

    fields = docs.select(*keep).schema.add("fp", "long").add("rest", "binary")
    return docs.select(*keep, text_col).mapInArrow(lean(run), fields)


def counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four parts, one column each."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _order(c: np.ndarray) -> np.ndarray:
    """A number that puts near count vectors near each other: total, upper half, a part of each half."""
    total, half = c.sum(axis=1, dtype=np.int64), c[:, 2].astype(np.int64) + c[:, 3]
    return ((total * 33 + half) * 17 + c[:, 2]) * 17 + c[:, 0]


def _bounds(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.column_stack([c, c[:, 0] + c[:, 1], c[:, 2] + c[:, 3], c.sum(axis=1)])
    return wide.min(axis=0), wide.max(axis=0)


def _near(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray, radius: int) -> np.ndarray:
    """Which of the boxes los..his can hold a fingerprint within the radius of one in the box lo..hi."""
    gap = np.maximum(0, np.maximum(los - hi, lo - his))
    return np.maximum(np.maximum(gap[..., :4].sum(axis=-1), gap[..., 4:6].sum(axis=-1)), gap[..., 6]) <= radius


def _blocks(fps: np.ndarray, size: int) -> tuple[list[slice], np.ndarray, np.ndarray]:
    c = counts(fps)
    cuts = [slice(i, min(i + size, len(fps))) for i in range(0, len(fps), size)]
    boxes = [_bounds(c[s]) for s in cuts]
    return cuts, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of fingerprints in a, then b, and of the roots that stand for their links (b None: within a).

    Rows are 64-bit words: links differ in `radius` bits at most, and in `first` at most in the first word.
    """
    more = None if a.shape[1] == 1 else (a[:, 1:], (a if b is None else b)[:, 1:])
    a, b, first = np.ascontiguousarray(a[:, 0]), None if b is None else np.ascontiguousarray(b[:, 0]), radius if first is None else first
    parent = np.arange(len(a) + (0 if b is None else len(b)))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            y = parent[x]
            if np.array_equal(y, x):
                return x
            x = y

    base, other = (0, a) if b is None else (len(a), b)
    rows, rlo, rhi = _blocks(a, _ROWS)
    cols, clo, chi = _blocks(other, _COLS)
    for k, r in enumerate(rows):
        x = a[r, None]
        for m in np.flatnonzero(_near(rlo[k], rhi[k], clo, chi, first)):
            if b is None and cols[m].stop <= r.start:
                continue
            hit = np.bitwise_count(x ^ other[None, cols[m]]) <= first
            if more is not None:
                i, j = np.nonzero(hit)
                apart = np.bitwise_count(a[r][i] ^ other[cols[m]][j]) + np.bitwise_count(more[0][r][i] ^ more[1][cols[m]][j]).sum(axis=1, dtype=np.int64)
                hit[i, j] = apart <= radius
            for i in np.flatnonzero(hit.any(axis=1)):
                ends = np.append(np.flatnonzero(hit[i]) + cols[m].start + base, r.start + i)
                tops = roots(ends)
                if (least := tops.min()) != tops.max():
                    parent[tops] = least
                parent[ends] = least
    top = roots(np.arange(len(parent)))
    moved = np.flatnonzero(top != np.arange(len(parent)))
    return moved, top[moved]


def _layout(cells: np.ndarray, size: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell, in order: its first tile and how many it is dealt over; for each tile its cells' range."""
    first, parts, spans = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64), []
    held = tile
    for i, n in enumerate(size):
        if n > tile:
            parts[i] = math.ceil(n / tile)
            first[i] = len(spans)
            spans += [(i, i)] * parts[i]
            held = tile
        else:
            if held + n > tile:
                spans.append((i, i))
                held = 0
            first[i] = len(spans) - 1
            spans[-1] = (spans[-1][0], i)
            held += n
    return first, parts, np.array(spans)


def links(distinct: DataFrame, radius: int, first_radius: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes that connect exactly what links within the radius connect. distinct: node, fp, rest."""
    near = radius if first_radius is None else first_radius
    spark = distinct.sparkSession
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"c{i}") for i in range(4)]
    rows = distinct.select(*part).groupBy("c0", "c1", "c2", "c3").count().collect()
    if not rows:
        return spark.createDataFrame([], "u long, v long")
    cells = np.array([[r.c0, r.c1, r.c2, r.c3] for r in rows], np.int16)
    size = np.array([r["count"] for r in rows])
    rank = np.lexsort((*cells.T, _order(cells)))
    cells, size = cells[rank], size[rank]
    tile = int(min(TILE_MOST, max(TILE, math.isqrt(int(size.sum()) * 512))))
    first, parts, spans = _layout(cells, size, tile)
    code = lambda c: ((c[:, 0].astype(np.int64) * 17 + c[:, 1]) * 17 + c[:, 2]) * 17 + c[:, 3]
    place = np.full(17**4, -1)
    place[code(cells)] = np.arange(len(cells))
    boxes = [_bounds(cells[s : e + 1]) for s, e in spans]
    shared = spark.sparkContext.broadcast((place, first, parts, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, parts, _, _ = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cell = place[code(counts(fps))]
            tile = first[cell] + ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tile), batch.column(1), batch.column(2)], names=["fp", "tile", "node", "rest"])

    def packed(table: pa.Table) -> pa.Table:
        _, _, _, lo, hi = shared.value
        fps = table.column("fp").to_numpy().view(np.uint64)
        c = counts(fps)
        rest = np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint64).reshape(len(fps), -1)
        order = np.lexsort((fps, _order(c)))
        wide, nodes = np.column_stack([fps, rest])[order], table.column("node").to_numpy()[order]
        t = table.column("tile")[0].as_py()
        near_ = np.flatnonzero(_near(lo[t], hi[t], lo, hi, near))
        return pa.table({"tile": [t], "near": pa.array([near_], pa.list_(pa.int64())), "nodes": pa.array([nodes.tobytes()], pa.binary()), "fps": pa.array([wide.tobytes()], pa.binary())})

    def compared(table: pa.Table) -> pa.Table:
        nodes = [np.frombuffer(x.as_py(), np.int64) for x in table.column("nodes")]
        sides = [np.frombuffer(x.as_py(), np.uint64).reshape(len(n), -1) for n, x in zip(nodes, table.column("fps"), strict=True)]
        u, v = forest(sides[0], sides[1] if len(sides) > 1 else None, radius, near)
        nodes = np.concatenate(nodes)
        return pa.table({"u": nodes[u], "v": nodes[v]})

    tiles = distinct.select("fp", "node", "rest").mapInArrow(lean(dealt), "fp long, tile long, node long, rest binary").groupBy("tile").applyInArrow(packed, "tile long, near array<long>, nodes binary, fps binary")
    # one row a tile, copied for each near tile row by row: no task holds more than one copy
    tiles = materialize(tiles, "tiles").select("tile", "nodes", "fps", F.explode("near").alias("other"))
    tiles = tiles.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "nodes", "fps")
    return tiles.groupBy("a", "b").applyInArrow(compared, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of docs: id, fp (64 bits as a signed long), component_id.

    Rows whose fingerprints differ in at most radius bits are linked; component_id is the smallest id reachable,
    the own included (null ids are never it, unless the whole component has none). Texts without words have
    fingerprint 0 and are linked as others are. Repeated rows give repeated rows; other columns are left out.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fps = materialize(fingerprints(d, "text", width).select("id", "fp"), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct.select("fp", F.col("fp").alias("node"), F.lit(b"").alias("rest")), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select(F.col("fp").alias("k"), "component_id")
    of = materialize(distinct.join(known, distinct.fp == known.k, "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "components")
    return spread_join(fps, of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: For texts of Jaccard similarity s on shingles, each of the 256 bits differs with probability acos(2s / (1 + s)) / pi: 38.8
#: bits at 0.8, with a deviation of 5.7 (48 and 6.2 for sets of four and five shingles, the worst case); unrelated texts differ in
#: 128, with a deviation of 8. The radii only find candidates, so they are wide.
WIDE = {"width": 5, "words64": 4, "radius": 72, "first_radius": 22}
#: Shingles of a part of a candidate group; larger groups are compared by pairs of parts.
PART_SHINGLES = 1 << 21
#: Rows up to which the numbers of the rows that go are broadcast; beyond, they are joined with a shuffle.
BROADCAST_ROWS = 100_000


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each distinct shingle, sorted; no words: none."""
    words = data.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def set_bits(hashes: np.ndarray, words64: int) -> np.ndarray:
    """As fingerprint(), but of a set: repeats of a shingle do not count."""
    ones = np.zeros(64 * words64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        wide = np.stack([h, *(mixed(h + np.uint64(k)) for k in range(1, words64))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def set_fingerprints(docs: DataFrame, text_col: str, width: int, words64: int) -> DataFrame:
    """All columns of docs but the text, with fp and rest of the shingle set, 128 bits of the set itself, and its size."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set((x or "").encode(), width) for x in part.column(len(keep)).to_pylist()]
            fps = np.array([set_bits(x, words64) for x in sets], np.uint64).reshape(-1, words64)
            new = [pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64)), pa.array([x.tobytes() for x in fps[:, 1:]], pa.binary()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=[*keep, "fp", "rest", "whole", "size"])

    fields = docs.select(*keep).schema.add("fp", "long").add("rest", "binary").add("whole", "binary").add("size", "long")
    return docs.select(*keep, text_col).mapInArrow(lean(run), fields)


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of 4/5 and more, as places in the list."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    _, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ids = np.split(rank[inverse], np.cumsum(sizes)[:-1])
    ids, sizes = [np.sort(ids[i]) for i in order], sizes[order]
    # sets of that similarity share one of the rarest fifth of their shingles, and one more
    prefix = [x[: len(x) - (4 * len(x) + 4) // 5 + 1] for x in ids]
    at = np.repeat(np.arange(len(ids)), [len(x) for x in prefix])
    flat = np.concatenate(prefix)
    by = np.argsort(flat, kind="stable")
    flat, at = flat[by], at[by]
    root, out = np.arange(len(ids)), []

    def joined(i: int, j: int) -> bool:
        both = len(np.intersect1d(ids[i], ids[j], assume_unique=True))
        if 9 * both < 4 * (sizes[i] + sizes[j]):
            return False
        root[root == root[i]] = root[j]
        out.append((int(order[i]), int(order[j])))
        return True

    last = 0
    for i in range(1, len(ids)):
        # most groups are copies of one text: one comparison, and what it links needs no other
        if not joined(i, last):
            last = i - 1 if i - 1 != last and joined(i, i - 1) else last
        open_ = (root[:i] != root[i]) & (5 * sizes[:i] >= 4 * sizes[i])
        if not open_.any():
            continue
        lo, hi = np.searchsorted(flat, prefix[i]), np.searchsorted(flat, prefix[i], "right")
        near = np.unique(np.concatenate([at[a:b] for a, b in zip(lo, hi, strict=True)]))
        near = near[near < i]
        for j in near[open_[near]]:
            if root[j] != root[i]:
                joined(i, int(j))
    return out


def verified(groups: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) between nodes whose shingle sets are similar. groups: node, root, row, size; texts: row, text."""
    parts = groups.groupBy("root").agg(F.ceil(F.sum("size") / PART_SHINGLES).cast("long").alias("parts"), F.count("*").alias("members")).where("members > 1")
    of = materialize(groups.join(parts, "root").select("root", "node", "row", "parts"), "groups")
    side = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    held = texts.join(side, "row").select("root", "node", "parts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set((x or "").encode(), width).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], names=["root", "node", "parts", "shingles"])

    def compared(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        pairs = np.array(similar([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]), np.int64).reshape(-1, 2)
        return pa.table({"u": nodes[pairs[:, 0]], "v": nodes[pairs[:, 1]]})

    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: q != F.col("own"))).otherwise(F.array(F.lit(0).cast("long")))
    d = held.mapInArrow(lean(run), "root long, node long, parts long, shingles binary").withColumn("own", own)
    d = d.select("root", "node", "shingles", "own", F.explode(others).alias("other"))
    d = d.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "shingles")
    return d.groupBy("root", "a", "b").applyInArrow(compared, "u long, v long")


def filter_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE["width"], words64: int = WIDE["words64"], radius: int = WIDE["radius"], first_radius: int = WIDE["first_radius"]) -> DataFrame:
    """The row of the smallest id (nulls last) of each component of near-duplicates, with all columns of docs.

    Links are pairs whose sets of shingles have a Jaccard similarity of 4/5 and more. They are looked for among what is
    connected by pairs within the radius over all bits, and within first_radius in the first 64. Texts without words are
    equal and so are one group; of repeated rows one stays.
    """
    inner = [f"__{i}" for i in range(len(docs.columns))]
    key, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    d = docs.toDF(*inner).withColumn("text", F.col(text).cast("string"))
    rows = materialize(set_fingerprints(d, "text", width, words64).withColumn("row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), "row")
    own = rows.select("fp", "rest", "whole", "size", "row", place.alias("place"))
    distinct = materialize(own.groupBy("whole", "fp", "rest", "size").agg(F.min("place").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    candidates = connected_components(links(distinct.where("size > 0").select("fp", "node", "rest"), radius, first_radius))
    groups = distinct.join(candidates, "node").select("node", "root", F.col("least.row").alias("row"), "size")
    roots = connected_components(verified(groups, rows.select("row", F.col(text).cast("string").alias("text")), width))
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    of = materialize(rooted.join(best, "root").where("n > 1 or best != least").groupBy("whole").agg(F.first("best").alias("best"), F.sum("n").alias("n")), "components")
    gone = spread_join(own, of, "whole").where(F.col("row") != F.col("best.row")).select(F.col("row").alias("gone"))
    gone = materialize(gone, "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(side, F.col("row") == F.col("gone"), "left_anti").select(*inner).toDF(*docs.columns)
