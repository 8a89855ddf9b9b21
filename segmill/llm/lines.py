"""Line dedup by an exact set-similarity join.

A line is the set of its words. Lines of one set are one class, of which the earliest line stands for all. Classes are
joined on the words of their prefixes: with words in the order of rarity, two sets of Jaccard similarity s and more share a
word among the first n - ceil(s n) + 1 of each. Pairs that share one must pass the length filter, the positional filter
(enough words can be left behind the shared one) and a filter on 64-bit parities of the sets, a lower bound of how much
they differ; then their words are compared. A line goes if an earlier line is similar, whether or not that one goes.

Lines of JOINED words and more can be similar to others than their like; shorter ones are settled by classes. Sets are
equal if two sums of 64-bit hashes of their words are; pairs that the join finds are compared word by word.

Rarity is a word's count of lines in a table of fixed size, counted over the whole corpus; any order gives the same result.
The join has rounds, so that a large group of similar lines does not cost all its pairs. In each, a line keeps the nearest of
its earlier candidates only (NEAREST for each word), and in the first the lines of a common word meet the PIVOTS
earliest of them only. What is found similar then needs no other proof; the next round takes what is left of the words and
lines that were cut short, and the last one in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SENT, answered, bucket_bits, bucketed, buckets_of, flags_of, gathered, mixed, pack, release, rows_of, total_bytes, unsqueezed
from .common import batches, discard, lean, materialize, remove_path

#: Jaccard similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: The fewest words of which a set can be similar to a larger one.
JOINED = SIMILAR[0]
PIVOTS = 64
BLOCK_BYTES = 4 << 20
#: Rows of a word from which the first round looks at it.
LARGE = 1024
#: Candidates that a line keeps in each round; all in the last.
NEAREST = (2, 16, None)
RARITY_BITS = 22
_SLICES = 16
#: Tables of counts that are summed in one group.
_FAN_IN = 64
_MOST = 65535
#: Lines of more words have parities of 128 bits; folded, they compare with those of 64.
LONG = 70
_PREFIX = np.dtype([("sig", "u8"), ("sig2", "u8"), ("word", "u4"), ("line", "u4"), ("n", "u2"), ("i", "u2")])
#: Words of more bytes are hashed one by one.
_WIDE = 256
#: What stays of eight bytes, by how many of them are a word's.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def needed(na, nb):
    """Words that sets of these sizes must share to be similar."""
    return -(-SIMILAR[0] * (na + nb) // (SIMILAR[0] + SIMILAR[1]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Lines:
    """The lines of a block's texts and their words: ASCII white space parts words, A-Z are lowered."""

    def __init__(self, ends: bytes, data: bytes | pa.Buffer):
        self.raw = np.frombuffer(data, np.uint8)
        self.ends = np.frombuffer(ends, np.int64)
        first = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        breaks = np.flatnonzero(self.raw == 10)
        of = np.searchsorted(self.ends, breaks, side="right")
        start, doc = np.concatenate([first, breaks + 1]), np.concatenate([np.arange(len(first)), of])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(order) else np.zeros(0, bool)
        self.end = np.where(last, self.ends[self.doc], np.append(self.start[1:], 0) - 1) if len(order) else self.start

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the block's distinct words; line and word number of each distinct word of a line, in their order; lines that have words, and their first row."""
        raw, size = self.raw, len(self.raw)
        ink = np.zeros(size + 2, bool)
        np.logical_and((raw - np.uint8(9)) > 4, raw != 32, out=ink[1:-1])
        turns = np.flatnonzero(ink[1:] != ink[:-1])
        starts, ends = turns[::2], turns[1::2]
        # a text ends where its last word does, whatever the next begins with
        cut = np.unique(self.ends)
        cut = cut[ink[cut] & ink[cut + 1]]
        starts, ends = np.insert(starts, np.searchsorted(starts, cut), cut), np.insert(ends, np.searchsorted(ends, cut), cut)
        low = np.zeros((size + 23) // 8 * 8, np.uint8)
        np.bitwise_or(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << 5, out=low[:size])
        line = np.repeat(np.arange(len(self.start), dtype=np.int32), np.diff(np.searchsorted(starts, self.start), append=len(starts)))
        uniq, word, new = _distinct(_hashes(low, starts, ends), line)
        line, word = line[new], word[new]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        return uniq, line, word, line[first], first

    def classes(self, deal: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Of lines with enough words, by class: bucket and two hashes, sorted; class and number of each line; first lines."""
        uniq, line, word, has, first = self.words()
        n = np.diff(np.append(first, len(line)))
        ok = n >= max(min_words, 1)
        sums = [np.add.reduceat(x[word], first)[ok] if len(first) else np.zeros(0, np.uint64) for x in (mixed(uniq ^ np.uint64(0x1234567)), mixed(uniq + np.uint64(0x89ABCDE)))]
        lines, keys = has[ok], np.column_stack([mixed(x) for x in sums])
        bucket = (keys[:, 1] >> np.uint64(64 - deal)).astype(np.int64)
        order = np.lexsort((lines, keys[:, 0], bucket))
        keys, bucket, lines = keys[order], bucket[order], lines[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
        return bucket[new], keys[new], np.cumsum(new) - 1, lines, lines[new], (uniq, line, word, has, first, n)

    def prefixes(self, deal: int, min_words: int, later: list[dict] | None, rarity: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines whose class came earlier; of the others' first, buckets and rows of the prefixes, sorted by bucket."""
        bucket, _, of, lines, lead, (uniq, line, word, has, first, n) = self.classes(deal, min_words)
        known = flags_of(later, bucket)
        gone = lines[known[of] | (lines != lead[of])]
        lead = np.sort(lead[~known])
        at = np.searchsorted(has, lead)
        long = n[at] >= JOINED
        lead, first, n = lead[long], first[at][long], n[at][long]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        take = np.repeat(first - starts, n) + np.arange(n.sum())
        # words by rarity; the same order in all blocks
        seen = rarity[(uniq >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
        rank = np.lexsort((uniq, seen))
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        line, word = _sorted_pairs(np.repeat(np.arange(len(lead)), n), place[word[take]])
        i, size = np.arange(len(line)) - np.repeat(starts, n), np.repeat(n, n)
        uniq, seen = uniq[rank], seen[rank]
        place, half = np.uint64(1) << (mixed(uniq) & np.uint64(63)), (mixed(uniq) & np.uint64(64)) > 0
        sig, sig2 = (np.bitwise_xor.reduceat(np.where(h, place, np.uint64(0))[word], starts) if len(n) else np.zeros(0, np.uint64) for h in (~half, half))
        sig, sig2 = np.where(n > LONG, sig, sig ^ sig2), np.where(n > LONG, sig2, np.uint64(0))
        # a word that one line only has in the whole corpus joins nothing
        use = (i < size - (-(-SIMILAR[0] * size // SIMILAR[1])) + 1) & (seen[word] > 0)
        i, size, line, word = i[use], size[use], line[use], word[use]
        h = mixed(uniq + np.uint64(0x51ED27))
        b = (h >> np.uint64(64 - bits)).astype(np.int64)[word]
        order = np.argsort(b.astype(np.uint16) if bits <= 16 else b, kind="stable")
        out = np.zeros(len(order), _PREFIX)
        i, size, line, word = i[order], size[order], line[order], word[order]
        # 32 bits tell a bucket's words apart well enough: equal words stay equal, and pairs are verified
        out["word"], out["i"], out["n"] = h.astype(np.uint32)[word], np.minimum(i, _MOST), np.minimum(size, _MOST)
        out["line"], out["sig"], out["sig2"] = lead[line], sig[line], sig2[line]
        return gone, b[order], out


def _read(ends: pa.BinaryScalar, data: pa.BinaryScalar) -> _Lines:
    return _Lines(ends := ends.as_py(), unsqueezed(ends, data))


def _hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of text, which has eight bytes more and whole eights. Equal bytes have equal hashes wherever they stand."""
    eights, size = text.view(np.uint64), ends - starts

    def taken(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        i, shift = at >> 3, (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
        both = (eights[i] >> shift) | ((eights[i + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return both & _FIRST[np.minimum(left, 8)]

    h = mixed(taken(starts, size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    some = np.flatnonzero((size > 8) & (size <= _WIDE))
    at, left = starts[some] + 8, size[some] - 8
    while len(some):
        h[some] = mixed(h[some] * np.uint64(0xD1342543DE82EF95) + taken(at, left))
        go = left > 8
        some, at, left = some[go], at[go] + 8, left[go] - 8
    for k in np.flatnonzero(size > _WIDE).tolist():
        h[k] = np.frombuffer(hashlib.blake2b(text[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def _distinct(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of hashes with the inverse, and which are the first of their kind in a line; lines ascend.

    By a sort of values: 40 bits of hash and the place.
    """
    low = np.uint64(0xFFFFFF)
    at = None
    if 0 < len(h) < 1 << 24:
        key = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
        at = (key & low).astype(np.int32)
        full = h[at]
        new = np.concatenate([[True], full[1:] != full[:-1]])
        if (new[1:] & ((key[1:] ^ key[:-1]) <= low)).any():  # 40 bits do not tell two apart
            at = None
    if at is None:
        at = np.argsort(h, kind="stable")
        full = h[at]
        new = np.concatenate([[True], full[1:] != full[:-1]]) if len(h) else np.zeros(0, bool)
    inverse, first = np.empty(len(h), np.int32 if len(h) < 1 << 31 else np.int64), np.empty(len(h), bool)
    inverse[at] = np.cumsum(new, dtype=inverse.dtype) - 1
    # copies of a word stand in the order of their places
    of = line[at]
    new_in_line = new.copy()
    new_in_line[1:] |= of[1:] != of[:-1]
    first[at] = new_in_line
    return full[new], inverse, first


def _encoded(rows: np.ndarray) -> bytes:
    """Prefix rows by column and byte, line numbers as differences: most bytes are then equal and compress away."""
    line = np.diff(rows["line"], prepend=np.uint32(0))
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(rows), x.itemsize).T.tobytes() for x in (line, rows["n"], rows["i"])]
    return b"".join([len(rows).to_bytes(8, "little"), rows["sig"].tobytes(), rows["word"].tobytes(), *planes, rows["sig2"][rows["n"] > LONG].tobytes()])


def _decoded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    rows, at = np.zeros(n, _PREFIX), 8 + 12 * n
    rows["sig"], rows["word"] = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n)
    for name, size in (("line", 4), ("n", 2), ("i", 2)):
        rows[name] = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T).view(f"u{size}").ravel()
        at += size * n
    rows["line"] = np.cumsum(rows["line"], dtype=np.uint32)
    rows["sig2"][rows["n"] > LONG] = np.frombuffer(data, np.uint64, -1, at)
    return rows


def _sorted_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by x, then y; each below 2^32."""
    both = np.sort((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _level(count):
    """Logarithmic counts that fit 8 bits: 0 for what at most one line has."""
    return np.minimum(255, np.where(np.asarray(count) > 1, np.floor(6 * np.log2(np.maximum(count, 1))), 0)).astype(np.uint8)


def _apart(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the words that only one of two lines has, by their parities."""
    out = np.bitwise_count(rows["folded"][a] ^ rows["folded"][b])
    both = np.flatnonzero(rows["long"][a] & rows["long"][b])
    p, q = a[both], b[both]
    out[both] = np.bitwise_count(rows["sig"][p] ^ rows["sig"][q]) + np.bitwise_count(rows["sig2"][p] ^ rows["sig2"][q])
    return out


def _passing(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that pass the length, positional and parity filters. Sizes from _MOST on are not exact and pass."""
    na, nb = rows["n"][a].astype(np.int32), rows["n"][b].astype(np.int32)
    must = needed(na, nb)
    i, j = rows["i"][a], rows["i"][b]
    left = np.minimum(na - i, nb - j) + np.minimum(i, j)
    big = np.maximum(na, nb) >= _MOST
    ok = np.flatnonzero((np.minimum(na, nb) >= must) & ((left >= must) | big))
    a, b, big, room = a[ok], b[ok], big[ok], (na + nb - 2 * must)[ok]
    ok = (_apart(rows, a, b) <= room) | big
    return a[ok], b[ok]


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each range, and the numbers in it."""
    n = stop - start
    q = np.repeat(np.arange(len(n)), n)
    return q, np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + start[q]


def candidates(rows: np.ndarray, at: np.ndarray, open_: np.ndarray | None, pivots: int, nearest: int | None, seen: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Later and earlier rows of pairs that share a word and pass all filters, and rows that were cut short, as row numbers.

    at: order of each row's line; nearest: pairs that each row has had with this round (None: all); seen: those that it had
    before, which failed, for words of few and of many rows. Without open_ it is the first round: rows of
    words with more than LARGE rows meet the word's earliest `pivots` rows. open_: a mask of rows that were cut short, the only
    ones to be later. Cut short are the later rows of pairs beyond the nearest, and in the first round the rows of such words.
    """
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none, none
    key = (rows["word"].astype(np.uint64) << np.uint64(16)) | rows["n"]
    order = np.argsort(key, kind="stable")
    # columns on their own: pairs gather from each
    rows, at, key = {c: np.ascontiguousarray(rows[c])[order] for c in _PREFIX.names}, at[order], key[order]
    rows |= {"folded": rows["sig"] ^ rows["sig2"], "long": rows["n"] > LONG}
    cuts = np.flatnonzero(np.concatenate([[True], rows["word"][1:] != rows["word"][:-1]]))
    size = np.diff(np.append(cuts, len(key)))
    large, start, stop = np.repeat(size > LARGE, size), np.repeat(cuts, size), np.repeat(cuts + size, size)
    n = rows["n"].astype(np.uint64)
    least = np.searchsorted(key, (key - n) + (n * np.uint64(SIMILAR[0]) + np.uint64(SIMILAR[1] - 1)) // np.uint64(SIMILAR[1]))
    later, earlier = [none], [none]

    def add(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, by: np.ndarray | None = None, both: bool = False) -> None:
        for s in _shares(hi - lo, 1 << 14):
            k, b = _ranges(lo[s], hi[s])
            a, b = _passing(rows, q[s][k], b if by is None else by[b])
            if both:
                a, b = np.where(at[a] > at[b], a, b), np.where(at[a] > at[b], b, a)
            ok = at[a] > at[b]
            later.append(a[ok])
            earlier.append(b[ok])

    if open_ is None:
        q = np.flatnonzero(~large)
        add(q, least[q], q, both=True)
        q = np.flatnonzero(large)
        if len(q):
            first = np.lexsort((at, rows["word"]))  # rows of a word by line, at the same places
            add(q, start[q], np.minimum(start[q] + pivots, stop[q]), first)
    else:
        q = np.flatnonzero(open_[order])
        most = np.searchsorted(key, (key - n)[q] + np.minimum(n[q] * np.uint64(SIMILAR[1]) // np.uint64(SIMILAR[0]), np.uint64(_MOST)), side="right")
        add(q, least[q], np.where(n[q] == _MOST, stop[q], most))
    a, b = np.concatenate(later), np.concatenate(earlier)
    if not len(a):
        return none, none, order[np.flatnonzero(large)] if open_ is None else none
    pick = np.lexsort((at[b], _apart(rows, a, b), a))
    a, b = a[pick], b[pick]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    # a row's candidates are the same in each round, so are their ranks; but for pivots in the first
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    new = rank >= np.where(large[a], seen[1], seen[0])
    cut = none
    if nearest is not None:
        cut = np.unique(np.concatenate([a[rank >= nearest], np.flatnonzero(large) if open_ is None else none]))
        new &= rank < nearest
    return order[a[new]], order[b[new]], order[cut]


def _shares(limit: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about `most` pairs each."""
    sums = np.cumsum(limit)
    at, base = 0, 0
    while at < len(limit):
        end = max(at + 1, int(np.searchsorted(sums, base + most, side="right")))
        yield slice(at, end)
        at, base = end, int(sums[end - 1])


_PAIRS = "block long, line long, other_block long, other_line long, bucket long, cut binary"


def _rows_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that sent rows to a bucket, their rows, of which block each is, and the order of its line."""
    t = t.sort_by("block")
    parts = [_decoded(x.as_py()) for x in t.column("hashes")]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    rows = np.concatenate(parts) if parts else np.zeros(0, _PREFIX)
    return t.column("block").to_numpy(), rows, of, (of.astype(np.int64) << 32) | rows["line"]


def _pairs(ids: np.ndarray, rows: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    return {"block": ids[of[a]], "line": rows["line"][a].astype(np.int64), "other_block": ids[of[b]], "other_line": rows["line"][b].astype(np.int64)}


def _round(t: pa.Table, mask: np.ndarray | None, nearest: int | None, seen: tuple[int, int] = (0, 0)) -> pa.Table:
    """Pairs, and a row for each block with the places of its rows that were cut short."""
    bucket = t.column("bucket")[0].as_py()
    ids, rows, of, at = _rows_in(t)
    if mask is None:
        a, b, cut = candidates(rows, at, None, PIVOTS, nearest, seen)
    else:  # all rows of the words that open rows have, and no others
        words = np.append(np.unique(rows["word"][mask]), np.uint32(0))
        at_word = np.searchsorted(words[:-1], rows["word"])
        some = np.flatnonzero((words[at_word] == rows["word"]) & (at_word < len(words) - 1))
        a, b, cut = (some[x] for x in candidates(rows[some], at[some], mask[some], PIVOTS, nearest, seen))
    cut = np.sort(cut)
    blocks, where = np.unique(of[cut], return_index=True)
    starts = np.searchsorted(of, blocks)
    blobs = [np.stack([x - s, rows["line"][x]]).astype(np.uint32).tobytes() for x, s in zip(np.split(cut, where[1:]), starts, strict=True)] if len(cut) else []
    pairs, m = _pairs(ids, rows, of, a, b), len(blobs)
    more = {"block": ids[blocks], "line": np.full(m, -1), "other_block": np.full(m, -1), "other_line": np.full(m, -1)}
    out = {k: pa.array(np.concatenate([pairs[k], more[k]]).astype(np.int64)) for k in pairs}
    return pa.table(out | {"bucket": pa.array([bucket] * (len(a) + m), pa.int64()), "cut": pa.array([None] * len(a) + blobs, pa.binary())})


def _later(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For arrays of distinct pairs of hashes in the order of blocks: which pairs an earlier array has."""
    all_ = np.concatenate(arrays).reshape(-1, 2)
    order = np.argsort(all_[:, 0], kind="stable")
    s = all_[order]
    same = (s[1:] == s[:-1]).all(axis=1)
    if (same != (s[1:, 0] == s[:-1, 0])).any():  # one hash does not tell two pairs apart
        order = np.lexsort((all_[:, 1], all_[:, 0]))
        s = all_[order]
        same = (s[1:] == s[:-1]).all(axis=1)
    later = np.zeros(len(all_), bool)
    later[order[1:]] = same
    return np.split(later, np.cumsum([len(a) // 2 for a in arrays])[:-1])


def _first_round(nearest: int | None):
    return lambda t: _round(t, None, nearest)


def _next_round(nearest: int | None, seen: tuple[int, int]):
    def run(t: pa.Table, o: pa.Table) -> pa.Table:
        """A round for the rows that were cut short, of lines without proof."""
        if not t.num_rows or not o.num_rows:
            return pa.table({c: pa.array([], pa.binary() if c == "cut" else pa.int64()) for c in ("block", "line", "other_block", "other_line", "bucket", "cut")})
        ids, rows, of, _ = _rows_in(t)
        mask = np.zeros(len(rows), bool)
        for block, blob in zip(o.column("block").to_pylist(), o.column("cut").to_pylist(), strict=True):
            mask[np.searchsorted(of, np.searchsorted(ids, block)) + np.frombuffer(blob, np.uint32)] = True
        return _round(t, mask, nearest, seen)

    return run


def _still_open(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, block, cut, done): the places of rows that were cut short and whose lines have no proof."""
    for part in parts:
        left = []
        for cut, done in zip(part.column(2), part.column(3), strict=True):
            place, line = np.frombuffer(cut.as_py(), np.uint32).reshape(2, -1)
            left.append((place[~np.isin(line, done.values.to_numpy())] if done.is_valid else place).tobytes())
        out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(left, pa.binary())], names=["bucket", "block", "cut"])
        yield out.filter(pa.array([len(x) > 0 for x in left]))


def _verified(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, line) of the later lines of pairs whose words are similar."""
    pairs = materialize(pairs.distinct(), "pairs")
    asked = pairs.select("block", "line").union(pairs.select("other_block", "other_line")).groupBy("block").agg(F.collect_set("line").alias("lines"))

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                b = _read(part.column(1)[i], part.column(2)[i])
                lines = part.column(3)[i].as_py()
                text = [_LOWER[b.raw[b.start[n] : b.end[n]]].tobytes() for n in lines]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[i].as_py()] * len(lines)), pa.array(lines, pa.int64()), pa.array(text, pa.binary())], names=["b", "l", "words"])

    texts = materialize(blocks.join(asked, "block").select("block", "ends", "data", "lines").mapInArrow(lean(fetch), "b long, l long, words binary"), "lines")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep, last, b = [], None, set()
            for i, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if y != last:
                    last, b = y, set(y.split())
                a = set(x.split())
                if len(a & b) >= needed(len(a), len(b)):
                    keep.append(i)
            yield part.select(["block", "line"]).take(pa.array(keep, pa.int64()))

    one = texts.select(F.col("b").alias("block"), F.col("l").alias("line"), F.col("words").alias("x"))
    two = texts.select(F.col("b").alias("other_block"), F.col("l").alias("other_line"), F.col("words").alias("y"))
    both = pairs.join(one, ["block", "line"]).join(two, ["other_block", "other_line"]).select("block", "line", "x", "y")
    return both.mapInArrow(lean(compare), "block long, line long").distinct()


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_words: int = 1) -> DataFrame:
    """One row for each row of docs: its columns keep (the id, if None), n_lines, removed (numbers of removed lines, from 0), kept (the text without them).

    A line (between line feeds) of min_words distinct words and more is removed if an earlier such line's words are similar:
    a line of a row of smaller id (nulls first, equal ids by the text's hash), or before in the same text. Lines are judged
    on the input; lines without words stay. Null texts are empty, of one empty line. Repeated rows count as later copies; other columns are left out,
    as are columns of keep that are named as the new ones.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("n_lines", "removed", "kept")]
    blocks = pack(docs, id_col, text_col, keep, BLOCK_BYTES, squeezed=True)
    amount = total_bytes(blocks)
    deal, bits = bucket_bits(amount / 16), bucket_bits(amount * 0.75)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << RARITY_BITS, np.int32)
        for part in parts:
            for i in range(part.num_rows):
                bucket, key, _, _, _, (uniq, _, word, _, _, _) = _read(part.column(1)[i], part.column(2)[i]).classes(deal, min_words)
                np.add.at(seen, (uniq >> np.uint64(64 - RARITY_BITS)).astype(np.int64), np.bincount(word, minlength=len(uniq)).astype(np.int32))
                yield batches(rows_of(part.column(0)[i].as_py(), bucket, key), SENT)
        yield _sparse(TaskContext.get().partitionId(), [(-1 - i, x) for i, x in enumerate(np.split(seen, _SLICES))])

    kind = "block long, bucket long, hashes binary"
    first = materialize(blocks.select("block", "ends", "data").mapInArrow(lean(count), kind), "classes")

    def total(t: pa.Table) -> pa.Table:
        s = np.zeros((1 << RARITY_BITS) // _SLICES, np.int64)
        for x in t.column("hashes"):
            np.add.at(s, *(lambda p: (p["at"], p["n"]))(np.frombuffer(x.as_py(), _COUNT)))
        return pa.Table.from_batches([_sparse(t.column("block")[0].as_py(), [(t.column("bucket")[0].as_py(), np.minimum(s, 2**31 - 1))])])

    # tables of fixed size, one for each task: a tree of sums, slice by slice
    counts = first.where("bucket < 0")
    tasks = counts.agg(F.max("block")).first()[0] or 0
    while True:
        counts = counts.withColumn("block", F.expr(f"block div {_FAN_IN}")).groupBy("block", "bucket").applyInArrow(total, kind)
        if tasks < _FAN_IN:
            break
        tasks //= _FAN_IN
    counts = counts.collect()
    seen = np.zeros((_SLICES, (1 << RARITY_BITS) // _SLICES), np.int64)
    for r in counts:
        p = np.frombuffer(r.hashes, _COUNT)
        seen[-1 - r.bucket, p["at"]] = p["n"]
    rarity = docs.sparkSession.sparkContext.broadcast(_level(seen.ravel()))
    del counts, seen
    later = materialize(gathered(answered(first.where("bucket >= 0"), _later, "uint64"), "later"), "later")

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                block = part.column(0)[i].as_py()
                gone, b, rows = _read(part.column(1)[i], part.column(2)[i]).prefixes(deal, min_words, part.column(3)[i].as_py(), rarity.value, bits)
                yield batches({"block": [block], "bucket": [-1], "hashes": [gone.astype(np.int64).tobytes()]}, SENT)
                yield batches(rows_of(block, b, rows, _encoded), SENT)

    base = blocks.join(later, "block", "left")
    # dealt by bucket once, for both rounds
    sent, path = bucketed(base.select("block", "ends", "data", "later").mapInArrow(lean(send), kind), "bucket", buckets_of(blocks))
    copies = materialize(sent.where("bucket < 0").select("block", F.col("hashes").alias("copies")), "copies")
    sent = sent.where("bucket >= 0")
    discard(first)
    release(sent)
    similar, left = None, None
    for k, nearest in enumerate(NEAREST):
        if left is None:
            found = sent.groupBy("bucket").applyInArrow(_first_round(nearest), _PAIRS)
        else:
            found = sent.groupBy("bucket").cogroup(left.groupBy("bucket")).applyInArrow(_next_round(nearest, (NEAREST[k - 1], NEAREST[k - 1] if k > 1 else 0)), _PAIRS)
        found = materialize(found, "candidates")
        proven = materialize(_verified(found.where("cut is null").select("block", "line", "other_block", "other_line"), blocks), "similar")
        similar = proven if similar is None else similar.union(proven)
        done = similar.groupBy("block").agg(F.collect_set("line").alias("done"))
        left = found.where("cut is not null").join(done, "block", "left").select("bucket", "block", "cut", "done").mapInArrow(lean(_still_open), "bucket long, block long, cut binary")
        left = materialize(left, "left")
        release(left)
        if not left.count():
            break
    remove_path(docs.sparkSession, path)
    release(left)
    gone = similar.groupBy("block").agg(F.collect_set("line").alias("similar"))

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                get = lambda c, i=i, part=part: part.column(part.schema.names.index(c))[i]
                b = _read(get("ends"), get("data"))
                out = np.zeros(len(b.start), bool)
                out[np.frombuffer(get("copies").as_py() or b"", np.int64)] = True
                out[get("similar").as_py() or []] = True
                yield from _rows(b, get("ids").values, out, [*keep, "n_lines", "removed", "kept"])

    fields = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("n_lines", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType())), T.StructField("kept", T.StringType())])
    return blocks.join(copies, "block", "left").join(gone, "block", "left").select("ids", "ends", "data", "copies", "similar").mapInArrow(lean(remove), fields)


_COUNT = np.dtype([("at", "u4"), ("n", "u4")])


def _sparse(lot: int, slices: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the counts of each slice that are not zero."""
    out = {"block": [lot] * len(slices), "bucket": [k for k, _ in slices], "hashes": []}
    for _, x in slices:
        at = np.flatnonzero(x)
        p = np.zeros(len(at), _COUNT)
        p["at"], p["n"] = at, x[at]
        out["hashes"].append(p.tobytes())
    return batches(out, SENT)


def _rows(b: _Lines, ids: pa.Array, out: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    cuts = np.searchsorted(b.doc, np.arange(len(b.ends) + 1)).tolist()
    raw, start, end = memoryview(b.raw), b.start.tolist(), b.end.tolist()
    for at in range(0, len(b.ends), 512):
        n, removed, kept = [], [], []
        for d in range(at, min(at + 512, len(b.ends))):
            s, e = cuts[d], cuts[d + 1]
            gone = np.flatnonzero(out[s:e]).tolist()
            n.append(e - s)
            removed.append(gone)
            if gone:
                kept.append(b"\n".join(raw[start[i] : end[i]] for i in range(s, e) if not out[i]))
            else:
                kept.append(bytes(raw[start[s] : end[e - 1]]))
        yield pa.RecordBatch.from_arrays([*ids.slice(at, len(n)).flatten(), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary()).view(pa.string())], names=names)


def filter_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the texts that remove_lines leaves, all columns kept; texts of which nothing is left go.

    length_col, if docs have it, becomes the new length of texts that lost lines.
    """
    inner = [f"__{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*inner)
    place = dict(zip(docs.columns, inner, strict=True))
    out = remove_lines(d, place[id_col], place[text_col], [c for c in inner if c != place[text_col]])
    lost = F.size("removed") > 0
    out = out.where(~(lost & (F.trim("kept") == "")))
    new = {text_col: F.col("kept").cast(docs.schema[text_col].dataType)}
    if length_col in place:
        new[length_col] = F.when(lost, F.length("kept")).otherwise(F.col(place[length_col])).cast(docs.schema[length_col].dataType)
    return out.select(*(new.get(c, F.col(place[c])).alias(c) for c in docs.columns))
