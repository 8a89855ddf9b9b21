"""Removal of repeated byte strings: a sample of suffixes is chosen, windows are sorted around it one bucket at a time.

Only the first `window` bytes of a suffix matter. The sample is a cover by content: of each SPAN neighbouring suffixes it has
the one whose first window - SPAN + 1 bytes hash to the least number, so any window holds a sample suffix, equal windows hold
it at the same shift, and it stands for them all. (A cover by residues, as a difference cover is, shares a shift between two
windows too, but another one for each pair of residues: each window would have to go to all of the cover's buckets.)

Sample suffixes whose beginning occurs once can stand in no repeated window and are left out. The others go to buckets by
their beginning, with the bytes around them that windows need. A bucket is sorted twice: the sample suffixes, which ranks them
and tells how far neighbours agree, and what stands before them, read backwards. Two windows are equal if they begin as far
before a sample suffix, agree in the bytes up to it, and tie in its rank to their end. So long ties cost no comparison of
their own, all equality is that of bytes, and memory is that of a block or a bucket, whose sizes are fixed.

Beginnings with more than HOT surroundings (a passage that a share of all documents have) would make a bucket of any size;
their windows are dealt one by one, by all their bytes. Whole documents that are exact copies of an earlier one are settled
first, by 128 bits of a hash, and take no part in sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SENT, Rolling, answered, bucket_bits, gathered, mixed, pack, release, rows_of, total_bytes
from .common import batches, lean, materialize, spread_join

WINDOW = 100
#: Blocks are small, as the JVM holds several copies of those that pass through it.
BLOCK_BYTES = 4 << 20
#: Neighbouring suffixes of which one is in the sample.
SPAN = 57
#: Different surroundings of one beginning, from which its windows are dealt one by one.
HOT = 100_000
_CHUNK = 1 << 17
_PART = 1 << 15
_LOW = np.uint64((1 << 18) - 1)
_COUNT = np.dtype([("h", "<u4"), ("n", "<u2")])

_rolling: dict[int, Rolling] = {}


def _roll(seed: int) -> Rolling:
    if seed not in _rolling:
        _rolling[seed] = Rolling(seed)
    return _rolling[seed]


class _Block:
    """One block's documents that take part, its sample and what it sends, the same whenever they are made again."""

    def __init__(self, ends: bytes, data: bytes, copies: list[int] | None, window: int):
        self.window, self.data = window, np.frombuffer(data, np.uint8)
        self.ends = np.frombuffer(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.copy = np.zeros(len(self.ends), bool)
        self.copy[copies or []] = True
        part = ~self.copy & (self.ends - self.starts >= window)
        self.s, self.e = self.starts[part], self.ends[part]
        self.at, self.lo, self.hi, self.hash = self._sample()

    def _sample(self) -> tuple[np.ndarray, ...]:
        """Places of sample suffixes, how far before them their windows begin (least and most), hashes of their beginnings.

        Each window within a document belongs to one sample suffix.
        """
        width = self.window - SPAN + 1
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.s] += 1  # documents do not overlap, so their starts and their last windows' ends are distinct
        edge[self.e - self.window + 1] -= 1
        inside = np.cumsum(edge, dtype=np.int8).view(bool) if len(edge) else edge.view(bool)
        out = []
        for c in range(0, len(self.data) - self.window + 1, _CHUNK):
            if not inside[c : c + _CHUNK].any():
                continue
            chunk = self.data[c : c + _CHUNK + self.window]
            roll = _roll(1)
            sums, n = roll.prefix(chunk), len(chunk) - width + 1
            h = mixed((sums[width:] - sums[:n]) * roll.down[:n])
            least = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
            for step in (1, 2, 4, 8, 16):
                least = np.minimum(least[:-step], least[step:])
            w = min(_CHUNK, n - SPAN + 1)
            least = np.minimum(least[:w], least[SPAN - 32 : SPAN - 32 + w])  # spans of 32 from both ends make one of 57
            at, ok = (least & _LOW).astype(np.int64), inside[c : c + w]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]))
            last = np.append(first[1:], w) - 1
            first, last = first[ok[first]], last[ok[first]]
            place = at[first]
            out.append((place + c, place - last, place - first, h[place]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def around(self, i: np.ndarray) -> np.ndarray:
        """The bytes around sample suffixes that their windows have, a row each; others are 0."""
        if not hasattr(self, "padded"):
            self.padded = sliding_window_view(np.concatenate([np.zeros(SPAN - 1, np.uint8), self.data, np.zeros(self.window, np.uint8)]), self.window + SPAN - 1)
        rows = self.padded[self.at[i]]
        o = np.arange(1 - SPAN, self.window)
        rows[(o < -self.hi[i, None]) | (o >= self.window - self.lo[i, None])] = 0
        return rows

    def counted(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By beginning: bucket and 32 bits, sorted, how many suffixes have it; the beginning of each sample suffix."""
        keys, of, n = np.unique(self.hash >> np.uint64(32 - bits), return_inverse=True, return_counts=True)
        return keys, n, of

    def firsts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sample suffixes, in their order: which have other surroundings than all before them, and the first that each repeats."""
        rnd = np.random.default_rng(5).integers(0, 2**63, (self.window + SPAN + 6) // 8 + 1, np.uint64) | np.uint64(1)
        h = np.empty(len(some), np.uint64)
        for at in range(0, len(some), _PART):
            i = some[at : at + _PART]
            wide = np.zeros((len(i), 8 * len(rnd)), np.uint8)
            wide[:, : self.window + SPAN - 1] = self.around(i)
            wide[:, -2], wide[:, -1] = self.lo[i], self.hi[i]
            h[at : at + _PART] = mixed(mixed(wide.view(np.uint64) * rnd + rnd).sum(axis=1, dtype=np.uint64))
        order = np.argsort(h, kind="stable")
        near = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
        same = np.zeros(len(some), bool)
        for at in range(0, len(near), _PART):
            k = near[at : at + _PART]
            a, b = some[order[k]], some[order[k - 1]]
            same[k] = (self.around(a) == self.around(b)).all(axis=1) & (self.lo[a] == self.lo[b]) & (self.hi[a] == self.hi[b])
        group = np.cumsum(~same) - 1
        lead = order[np.flatnonzero(~same)] if len(some) else order
        first = np.empty(len(some), np.int64)
        first[order] = lead[group]
        return first == np.arange(len(some)), first

    def parts(self, bits: int, deal: int, ties: list[dict] | None) -> "_Parts":
        keys, n, of = self.counted(bits)
        tied, hot = _flags(ties, keys >> np.uint64(32), 2, n > 1)
        return _Parts(self, np.flatnonzero(tied[of] & ~hot[of]), np.flatnonzero(hot[of]), deal)


def _flags(answers: list[dict] | None, buckets: np.ndarray, times: int, known: np.ndarray) -> list[np.ndarray]:
    """The answers' flags, `times` for each key, for keys that are sorted by bucket; the first are true where known."""
    out, buckets = [known.copy(), *(np.zeros(len(buckets), bool) for _ in range(times - 1))], buckets.astype(np.int64)
    for a in answers or []:
        s, e = np.searchsorted(buckets, [a["bucket"], a["bucket"] + 1])
        got = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=times * (e - s), bitorder="little").astype(bool)
        for x, g in zip(out, np.split(got, times), strict=True):
            x[s:e] |= g
    return out


class _Parts:
    """What a block sends: surroundings of tied sample suffixes by bucket, and single windows of hot ones, each once."""

    def __init__(self, b: _Block, some: np.ndarray, hot: np.ndarray, deal: int):
        self.b, self.some = b, some
        lead, self.first = b.firsts(some)
        bucket = (mixed(b.hash[some] + np.uint64(77)) >> np.uint64(64 - deal)).astype(np.int64)
        sent = np.flatnonzero(lead)
        self.sent = sent[np.argsort(bucket[sent], kind="stable")]
        self.bucket = bucket[self.sent]
        self.size = (b.hi - b.lo)[some[self.sent]] + 1
        # windows of hot ones: places, the first equal one in the block, those sent
        n = (b.hi - b.lo)[hot] + 1
        self.place = np.repeat((b.at - b.hi)[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.place = np.sort(self.place)
        h = _roll(2).windows(b.data, self.place, b.window)
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order), bool)
        near = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
        for at in range(0, len(near), _PART):
            k = near[at : at + _PART]
            same[k] = (self.windows(self.place[order[k]]) == self.windows(self.place[order[k - 1]])).all(axis=1)
        one = order[~same]
        deals = (mixed(h[one] + np.uint64(78)) >> np.uint64(64 - deal)).astype(np.int64)
        by = np.lexsort((one, deals))
        self.one, self.deals = one[by], -1 - deals[by]  # buckets below 0
        self.lead = np.empty(len(order), np.int64)
        self.lead[order] = one[np.cumsum(~same) - 1]

    def windows(self, places: np.ndarray) -> np.ndarray:
        return sliding_window_view(self.b.data, self.b.window)[places]

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.sent), _PART):
            i = self.some[self.sent[at : at + _PART]]
            rows = np.column_stack([self.b.lo[i].astype(np.uint8), self.b.hi[i].astype(np.uint8), self.b.around(i)])
            yield self._batch(block, at, self.bucket[at : at + _PART], rows)
        for at in range(0, len(self.one), _PART):
            yield self._batch(block, at, self.deals[at : at + _PART], self.windows(self.place[self.one[at : at + _PART]]))

    @staticmethod
    def _batch(block: int, at: int, buckets: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        out = rows_of(block, buckets, rows, lambda x: pa.compress(len(x).to_bytes(8, "little") + x.tobytes(), codec="zstd", asbytes=True))
        sizes = [len(x) for x in np.split(rows, np.flatnonzero(buckets[1:] != buckets[:-1]) + 1)] if len(rows) else []
        return pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["bucket"], pa.int64()), pa.array([at] * len(sizes), pa.int64()), pa.array([n * rows.shape[1] + 8 for n in sizes], pa.int64()), pa.array(out["hashes"], pa.binary())], names=["block", "bucket", "at", "raw", "rows"])

    def gone(self, answers: list[dict] | None) -> np.ndarray:
        """Starts of windows that an earlier one equals, ascending."""
        b, bits = self.b, [np.zeros(int(self.size.sum()), bool), np.zeros(len(self.one), bool)]
        ends = np.concatenate([[0], np.cumsum(self.size)])
        for a in answers or []:
            hot = a["bucket"] < 0
            buckets = -self.deals if hot else self.bucket  # ascending
            s, e = np.searchsorted(buckets, [-a["bucket"] if hot else a["bucket"], (-a["bucket"] if hot else a["bucket"]) + 1])
            s, e = max(s, a["at"]), min(e, a["at"] + _PART)
            s, e = (s, e) if hot else (ends[s], ends[e])
            bits[hot][s:e] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(e - s), bitorder="little")
        # a sample suffix that repeats another's surroundings loses all its windows, the others those that are flagged
        begin = np.full(len(self.some), -1)
        begin[self.sent] = ends[:-1]
        n = (b.hi - b.lo)[self.some] + 1
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat((b.at - b.hi)[self.some], n) + k
        lead = np.repeat(begin >= 0, n)
        flagged = bits[0][np.where(lead, np.repeat(begin, n) + k, 0)] if len(bits[0]) else np.zeros(len(k), bool)
        late = np.zeros(len(self.place), bool)
        late[self.one] = bits[1]
        late |= self.lead != np.arange(len(self.place))
        return np.sort(np.concatenate([places[~lead | flagged], self.place[late]]))


def tied_beginnings(arrays: list[np.ndarray], most: int) -> list[np.ndarray | None]:
    """For arrays of distinct hashes and their counts: flags of those that occur again, then of those that are hot."""
    all_ = np.concatenate(arrays)
    uniq, of, blocks = np.unique(all_["h"], return_inverse=True, return_counts=True)
    total = np.bincount(of, all_["n"], len(uniq))
    tied, hot = (blocks > 1)[of], (total > most)[of]
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return [np.concatenate(x) if x[0].any() or x[1].any() else None for x in zip(np.split(tied, cuts), np.split(hot, cuts), strict=True)]


def _agreement(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each agrees in with the one before it in that order."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    agree = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), _PART):
        same = rows[order[at : at + _PART]] == rows[order[at - 1 : at - 1 + _PART][: len(order[at : at + _PART])]]
        agree[at : at + _PART] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, agree


def later_windows(lo: np.ndarray, hi: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For sample suffixes in the order of places: whether an earlier window equals each of theirs, row by row, farthest first."""
    n, window = len(lo), around.shape[1] - SPAN + 1
    (after, ranks), (before, backs) = _agreement(around[:, SPAN - 1 :]), _agreement(around[:, SPAN - 2 :: -1])
    out = np.zeros((n, SPAN), bool)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(SPAN):
        use = np.flatnonzero((lo <= k) & (k <= hi))
        if len(use) < 2:
            continue
        right[after], left[before] = np.cumsum(ranks < window - k), np.cumsum(backs < k)
        key = left[use] * (n + 1) + right[use]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        out[use[order[again]], k] = True
    use = (np.arange(SPAN) >= lo[:, None]) & (np.arange(SPAN) <= hi[:, None])
    return out[:, ::-1][use[:, ::-1]]


def _later(window: int):
    """The answer of a bucket: bits for the windows of each of its rows."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("at", "ascending")])
        raw = [np.frombuffer(pa.decompress(x.as_py(), n.as_py(), codec="zstd", asbytes=True), np.uint8, offset=8) for x, n in zip(t.column("rows"), t.column("raw"), strict=True)]
        hot = t.column("bucket")[0].as_py() < 0
        parts = [x.reshape(-1, window if hot else window + SPAN + 1) for x in raw]
        rows = np.concatenate(parts)
        if hot:
            order = np.argsort(np.ascontiguousarray(rows).view(f"S{window}").ravel(), kind="stable")
            flags = np.zeros(len(rows), bool)
            for at in range(1, len(rows), _PART):
                k = order[at : at + _PART]
                flags[k] = (rows[k] == rows[order[at - 1 : at - 1 + len(k)]]).all(axis=1)
            cuts = np.cumsum([len(p) for p in parts])
        else:
            lo, hi = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
            flags = later_windows(lo, hi, rows[:, 2:])
            cuts = np.cumsum(hi - lo + 1)[np.cumsum([len(p) for p in parts]) - 1]
        flags = np.split(flags, cuts[:-1])
        some = [i for i, f in enumerate(flags) if f.any()]
        keep = t.select(["block", "bucket", "at"]).take(pa.array(some, pa.int64()))
        return keep.append_column("bits", pa.array([np.packbits(flags[i], bitorder="little").tobytes() for i in some], pa.binary()))

    return run


def _blocks(part: pa.RecordBatch, window: int):
    """(row, number, _Block, ties, later) for each row of a batch with the columns block, ends, data, copies, ties, later."""
    names = part.schema.names
    for i in range(part.num_rows):
        get = lambda c, i=i: part.column(names.index(c))[i].as_py() if c in names else None
        yield i, get("block"), _Block(get("ends"), get("data"), get("copies"), window), get("ties"), get("later")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: id, n_bytes, spans (removed: array of start, end in bytes), kept (binary).

    A byte of the UTF-8 text is removed if a string of `window` bytes covers it that also begins earlier: in a row of
    smaller id (nulls first; equal ids by the text's hash), or before in the same text. Strings are judged on the input and
    never cross texts. hot does not change the result. Null texts are empty; repeated rows count as later copies; other columns are left out.
    """
    if not SPAN <= window <= 4096 - SPAN:
        raise ValueError(f"window must be {SPAN} at least, {4096 - SPAN} at most")
    blocks = pack(docs, id_col, text_col, [id_col], BLOCK_BYTES)
    amount = total_bytes(blocks)
    bits, deal = bucket_bits(amount / 4), bucket_bits(amount * 2)

    hashes = F.expr("transform(sequence(0, cast(octet_length(hashes) / 16 as int) - 1), i -> substring(hashes, 16 * i + 1, 16))")
    texts = blocks.select("block", F.posexplode(hashes).alias("at", "hash")).where("octet_length(hash) = 16")
    twice = texts.groupBy("hash").agg(F.min(F.struct("block", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = spread_join(texts, materialize(twice, "twice"), "hash").where("struct(block, at) != first")
    copies = materialize(copies.groupBy("block").agg(F.collect_list("at").alias("copies")), "copies")
    base = blocks.select("block", "ids", "ends", "data").join(copies, "block", "left")

    def send_beginnings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, block, b, _, _ in _blocks(part, window):
                keys, n, _ = b.counted(bits)
                rows = np.zeros(len(keys), _COUNT)
                rows["h"], rows["n"] = keys.astype(np.uint32), np.minimum(n, 65535)
                yield batches(rows_of(block, keys >> np.uint64(32), rows), SENT)

    sent = base.select("block", "ends", "data", "copies").mapInArrow(lean(send_beginnings), "block long, bucket long, hashes binary")
    ties = materialize(gathered(answered(sent, lambda arrays: tied_beginnings(arrays, hot), _COUNT), "ties"), "ties")
    release(ties)
    base = base.join(ties, "block", "left")

    def send_parts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, block, b, tie, _ in _blocks(part, window):
                yield from b.parts(bits, deal, tie).rows(block)

    sent = base.select("block", "ends", "data", "copies", "ties").mapInArrow(lean(send_parts), "block long, bucket long, at long, raw long, rows binary")
    later = sent.groupBy("bucket").applyInArrow(_later(window), "block long, bucket long, at long, bits binary")
    later = materialize(later.groupBy("block").agg(F.collect_list(F.struct("bucket", "at", "bits")).alias("later")), "later")
    release(later)
    base = base.join(later, "block", "left")

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, _, b, tie, late in _blocks(part, window):
                ids = part.column(part.schema.names.index("ids"))[i].values
                yield from _rows(b, ids, b.parts(bits, deal, tie).gone(late))

    kind = docs.schema[id_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return base.select("block", "ids", "ends", "data", "copies", "ties", "later").mapInArrow(lean(remove), out)


def _rows(b: _Block, ids: pa.Array, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of a block without the windows that begin at the places of gone."""
    doc = np.searchsorted(b.starts, gone, side="right") - 1
    new = np.concatenate([[True], (gone[1:] > gone[:-1] + b.window) | (doc[1:] != doc[:-1])]) if len(gone) else np.zeros(0, bool)
    cuts = np.flatnonzero(new)
    lo, hi = gone[cuts], gone[np.append(cuts[1:], len(gone)) - 1] + b.window if len(cuts) else gone
    of = np.searchsorted(doc[cuts], np.arange(len(b.ends) + 1)).tolist() if len(cuts) else [0] * (len(b.ends) + 1)
    raw = memoryview(b.data)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for at in range(0, len(b.ends), 512):
        spans, kept, sizes = [], [], []
        for d in range(at, min(at + 512, len(b.ends))):
            s, e = int(b.starts[d]), int(b.ends[d])
            cut = [(x, y) for x, y in zip(lo[of[d] : of[d + 1]].tolist(), hi[of[d] : of[d + 1]].tolist(), strict=True)]
            if b.copy[d] and e - s >= b.window:
                cut = [(s, e)]
            p, pieces = s, []
            for x, y in cut:
                pieces.append(raw[p:x])
                p = y
            pieces.append(raw[p:e])
            kept.append(b"".join(pieces))
            spans.append([{"start": x - s, "end": y - s} for x, y in cut])
            sizes.append(e - s)
        yield pa.RecordBatch.from_arrays([*ids.slice(at, len(sizes)).flatten(), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
