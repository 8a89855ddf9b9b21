"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves. Two neighbours join by encoding anew a window of tokens on both sides of
their border, growing it until the tokens outside are proven to stay. An edge of the window is proven when

* it is an edge of the joined text,
* the split pattern must end a match there whatever stands around: after a letter, digit or sign that a
  character of another class follows (but for an apostrophe before a letter, which may open a contraction), or
* it lies inside a run of one class, so inside one match, and the two tokens that meet there encode to
  themselves when encoded together. A token sequence is the BPE encoding of a piece exactly if that holds
  for each two neighbours.

These proofs hold for the patterns of PROVEN; texts are encoded in one go by others.

Characters that Unicode versions may class differently prove nothing; the window then grows. As it doubles
each time, the worst case costs O(n log n).

Empty and null texts have no tokens. Rows, ids and their order are kept; repeated rows stay repeated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches

#: Bytes that are encoded in one go.
LEAF_BYTES = 8192
#: A rank file beyond this is refused: its content goes to every worker.
MAX_VOCAB_BYTES = 64 << 20

# Fixed value: the pattern that splits contractions, then runs of letters, digits, other signs and white space.
PROVEN = frozenset([r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""])

_CLASSES = (("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(r"\s")))
_UNSURE = regex.compile(r"[\p{Cn}\x1c-\x1f\x85᠎​]")
_codecs: dict[tuple, "TreeCodec"] = {}


def read_ranks(path: str) -> bytes:
    """The content of a rank file, after a check of its size."""
    p = Path(path)
    if p.stat().st_size > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return p.read_bytes()


class TreeCodec:
    """Encodes and decodes one text at a time; memory is a small multiple of the text."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF_BYTES):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.leaf = max(leaf, 8)
        self.proven = pattern in PROVEN
        self.classes: dict[str, str] = {}

    def class_of(self, c: str) -> str:
        """L, N, S, O for other, ? where a proof may not rest on it."""
        if (k := self.classes.get(c)) is None:
            k = "?" if _UNSURE.match(c) else next((k for k, p in _CLASSES if p.match(c)), "O")
            self.classes[c] = k
        return k

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        data = text.encode("utf-8")
        return self.core.encode_ordinary(text) if len(data) <= self.leaf or not self.proven else self._tree(data, 0, len(data))

    def _tree(self, data: bytes, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.core.encode_ordinary(data[lo:hi].decode("utf-8"))
        mid = (lo + hi) // 2
        while data[mid] & 0xC0 == 0x80:
            mid -= 1
        return self._join(data, lo, mid, hi, self._tree(data, lo, mid), self._tree(data, mid, hi))

    def _join(self, data: bytes, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        width = 8
        while True:
            a, i = mid, len(left)
            while i and (len(left) - i < width or data[a] & 0xC0 == 0x80):
                i -= 1
                a -= len(self.bytes_of[left[i]])
            c, j = mid, 0
            while j < len(right) and (j < width or data[c] & 0xC0 == 0x80):
                c += len(self.bytes_of[right[j]])
                j += 1
            new = self.core.encode_ordinary(data[a:c].decode("utf-8"))
            if (a == lo or self._proven(data, a, lo, left[i - 1], new[0])) and (c == hi or self._proven(data, c, lo, new[-1], right[j])):
                return left[:i] + new + right[j:]
            width *= 2

    def _proven(self, data: bytes, p: int, lo: int, x: int, y: int) -> bool:
        """Whether the tokens x, which ends at p, and y, which begins there, are neighbours in the joined text."""
        q = max(lo, p - 12)
        while data[q] & 0xC0 == 0x80:
            q += 1
        before, after = data[q:p].decode("utf-8"), data[p : p + 4].decode("utf-8", "ignore")[0]
        k, m = self.class_of(before[-1]), self.class_of(after)
        if "?" in (k, m) or k == "S":
            return False
        if k != m:
            return not (before[-1] == "'" and m == "L")
        if m == "S" or after == "'" or (k == "L" and "'" in before[-3:-1]):
            return False
        pair = self.bytes_of[x] + self.bytes_of[y]
        return self.core._core_bpe.encode_single_piece(pair) == [x, y]

    def decode(self, ids) -> bytes:
        """Bytes of a token sequence, put together up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _codec(ranks: bytes, pattern: str, leaf: int) -> TreeCodec:
    key = (hash(ranks), pattern, leaf)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = TreeCodec(ranks, pattern, leaf)
    return _codecs[key]


def encode(docs: DataFrame, vocab: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", keep: list[str] | None = None, leaf: int = LEAF_BYTES) -> DataFrame:
    """The columns `keep` of docs (all, if None, but the text) and the token ids of each text.

    A column of docs that is named as out_col gives way to the ids. Null texts get an empty list. Texts are encoded as trees
    if the pattern is one of PROVEN, else whole, with the same result.
    """
    return _mapped(docs, [c for c in (docs.columns if keep is None else keep) if c not in (text_col, out_col)], text_col, (out_col,), [T.ArrayType(T.IntegerType(), False)], _encoded, read_ranks(vocab), pattern, leaf)


def decode(tokens: DataFrame, vocab: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded", leaf: int = LEAF_BYTES) -> DataFrame:
    """All columns of tokens and the bytes that each list of ids stands for (null: empty)."""
    return _mapped(tokens, [c for c in tokens.columns if c != out_col], ids_col, (out_col,), [T.BinaryType()], _decoded, read_ranks(vocab), pattern, leaf)


def round_trip(docs: DataFrame, vocab: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", back_col: str = "decoded", keep: list[str] | None = None, leaf: int = LEAF_BYTES) -> DataFrame:
    """As encode and then decode, by one worker: the ids never leave it in between."""
    outs = (out_col, back_col)
    return _mapped(docs, [c for c in (docs.columns if keep is None else keep) if c not in (text_col, *outs)], text_col, outs, [T.ArrayType(T.IntegerType(), False), T.BinaryType()], _both, read_ranks(vocab), pattern, leaf)


def _encoded(codec: TreeCodec, texts: pa.Array) -> list[pa.Array]:
    ids = [codec.encode(x) for x in texts.to_pylist()]
    return [pa.array(ids, pa.list_(pa.field("element", pa.int32(), False)))]


def _decoded(codec: TreeCodec, lists: pa.Array) -> list[pa.Array]:
    return [pa.array([codec.decode(x or []) for x in lists.to_pylist()], pa.binary())]


def _both(codec: TreeCodec, texts: pa.Array) -> list[pa.Array]:
    ids = _encoded(codec, texts)
    return [*ids, *_decoded(codec, ids[0])]


def _mapped(df: DataFrame, keep: list[str], source: str, outs: tuple[str, ...], kinds: list[T.DataType], work, ranks: bytes, pattern: str, leaf: int) -> DataFrame:
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, leaf)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                kept = [piece.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *work(codec, piece.column(len(keep)))], names=[*keep, *outs])

    # the last column is the source under a name of its own, so that a kept column may share it
    taken = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{source}`").alias("__source"))
    return taken.mapInArrow(lean(run), T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(outs, kinds, strict=True))]))
