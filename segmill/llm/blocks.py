"""Documents in blocks: their bytes packed in the order of ids, in a table that is bucketed by block.

Operators that ask for each of a block's many hashes whether it occurs elsewhere send them by bucket of hash, a row for each
block and bucket, and get a row of bits back. The answers join the bucketed table without a shuffle of its texts.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, shared_dir, small_batches

#: A block is closed when it reaches this; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task packs, and a bucket holds, about; their number follows from the input's size.
TASK_BYTES = 64 << 20


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of steps whose result is written."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def pack(docs: DataFrame, id_col: str, text_col: str, keep: list[str], block_bytes: int | None = None, squeezed: bool = False) -> DataFrame:
    """Blocks (block, ids, ends, hashes, data, size); block numbers and places in a block follow (id, text hash), null ids first.

    Texts are dealt by ranges of ids, and of hashes too where many rows share an id; only copies of one row are sorted in one
    task whatever their number. A task's blocks are numbered so that they all go to one bucket, and so to one file.
    ids: the columns keep of each row, as structs of fields c0, c1 and so on; ends: cumulative ends of the texts in data (int64 as bytes); hashes: 16 bytes for each text; null texts are empty.
    squeezed: data is compressed (unsqueezed() takes it back), so that each step that reads blocks moves less.
    """
    small_batches(docs.sparkSession)
    spark, most = docs.sparkSession, block_bytes or BLOCK_BYTES
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    d = docs.select(kept.alias("kept"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    kind = d.schema["kept"].dataType
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    about = d.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.approx_count_distinct("id").alias("ids")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-about["bytes"] // TASK_BYTES))
    buckets = min(tasks, _most_buckets(spark))
    # by id alone if that will do, so that the sample of ranges reads no text
    ranges = order[: 1 if about["ids"] >= 0.9 * about["rows"] else 2]

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = _in_bucket(task << 32, task % buckets, buckets)
        ids, pieces, sizes = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal number
            data = b"".join(pieces)
            hashes, at = [], 0
            for n in np.concatenate(sizes).tolist():
                hashes.append(hashlib.blake2b(data[at : at + n], digest_size=16).digest())
                at += n
            ends = np.cumsum(np.concatenate(sizes)).astype(np.int64)
            out = [pa.array([number]), pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type)), pa.array([ends.tobytes()], pa.binary()), pa.array([b"".join(hashes)], pa.binary()), pa.array([_codec().compress(data, asbytes=True) if squeezed else data], pa.binary()), pa.array([len(data)])]
            number = _in_bucket(number + 1, task % buckets, buckets)
            for x in (ids, pieces, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names=["block", "ids", "ends", "hashes", "data", "size"])

        held = 0
        for part in parts:
            size = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = np.asarray(_bytes(part.column(1))), 0
            i = 0
            while i < len(size):
                j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), most - held, side="right")))
                n = int(size[i:j].sum())
                if held and held + n > most:
                    yield block()
                    held = 0
                    continue
                ids.append(part.column(0).slice(i, j - i))
                pieces.append(raw[at : at + n].tobytes())
                sizes.append(size[i:j])
                held, at, i = held + n, at + n, j
                if held >= most:
                    yield block()
                    held = 0
        if sizes:
            yield block()

    packed = d.repartitionByRange(tasks, *ranges).sortWithinPartitions(*order).select("kept", "text").mapInArrow(lean(blocks), T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("ends", "hashes", "data")), T.StructField("size", T.LongType())]))
    out, _ = bucketed(packed, "block", buckets, dealt=False)
    del packed, d
    release(out)
    return out


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def unsqueezed(ends: bytes, data: pa.BinaryScalar) -> pa.Buffer:
    """The texts of a block that was packed squeezed."""
    return _codec().decompress(data.as_buffer(), int(np.frombuffer(ends, np.int64)[-1]))


def bucketed(df: DataFrame, key: str, buckets: int, dealt: bool = True) -> tuple[DataFrame, str]:
    """df as a table in the shared folder that is bucketed by a key, so that groups and joins by it need no shuffle; and its path.

    dealt: df is dealt by key first, for one file a bucket; else each task writes files of its own. The table's name is
    taken back from the catalog at once; the frame still knows its buckets.
    """
    spark = df.sparkSession
    name, path = f"segmill_{uuid.uuid4().hex}", shared_dir(spark, key)
    rows = df.repartition(buckets, key) if dealt else df
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  the frame is resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out, path


def buckets_of(blocks: DataFrame) -> int:
    """As many buckets as suit the size of all blocks, and as the session allows; a bucket's rows are read one by one."""
    spark = blocks.sparkSession
    return min(_most_buckets(spark), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes(blocks) // TASK_BYTES)))


def _most_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))


def spark_bucket(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each long, as Spark deals them: Murmur3 of its two halves, seed 42."""

    def mix(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = h ^ k
        return ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)

    n = numbers.astype(np.uint64)
    h = mix(mix(np.full(len(n), 42, np.uint32), n.astype(np.uint32)), (n >> np.uint64(32)).astype(np.uint32)) ^ np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % buckets


def _in_bucket(least: int, bucket: int, buckets: int) -> int:
    """The first number from `least` on that goes to a bucket."""
    while True:
        hit = np.flatnonzero(spark_bucket(np.arange(least, least + 4 * buckets), buckets) == bucket)
        if len(hit):
            return least + int(hit[0])
        least += 4 * buckets


def _bytes(texts: pa.Array) -> memoryview:
    """The bytes of a string array without nulls, in a row."""
    if not len(texts):
        return memoryview(b"")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2] or b"")[int(at[0]) : int(at[-1])]


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def bucket_bits(amount: float, each: float = 8 << 20) -> int:
    """Bits that number enough buckets for each to hold about `each` bytes of the amount."""
    return min(24, max(4, int(np.ceil(np.log2(max(amount / each, 1))))))


def answered(sent: DataFrame, answer: Callable[[list[np.ndarray]], list[np.ndarray | None]], dtype: str) -> DataFrame:
    """(block, bucket, bits): answer gets a bucket's arrays in the order of blocks, and gives flags for each, or None.

    sent: (block, bucket, hashes), hashes as bytes of dtype.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        flags = answer([np.frombuffer(x.as_py(), dtype) for x in t.column("hashes")])
        some = [i for i, f in enumerate(flags) if f is not None and f.any()]
        bits = [np.packbits(flags[i], bitorder="little").tobytes() for i in some]
        return pa.table({"block": t.column("block").take(pa.array(some, pa.int64())), "bucket": t.column("bucket").take(pa.array(some, pa.int64())), "bits": pa.array(bits, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket long, bits binary")


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """One row for each block: its answers as an array, under a name."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def rows_of(block: int, buckets: np.ndarray, hashes: np.ndarray, encode: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> dict[str, list]:
    """The rows to send for hashes that are sorted by bucket."""
    if not len(buckets):
        return {"block": [], "bucket": [], "hashes": []}
    cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    ends = np.append(cuts[1:], len(buckets))
    return {"block": [block] * len(cuts), "bucket": buckets[cuts].astype(np.int64).tolist(), "hashes": [encode(hashes[s:e]) for s, e in zip(cuts, ends, strict=True)]}


def flags_of(answers: list[dict] | None, buckets: np.ndarray) -> np.ndarray:
    """The answers' flags for hashes that are sorted by bucket, as they were sent."""
    out, buckets = np.zeros(len(buckets), bool), buckets.astype(np.int64)
    for a in answers or []:
        s, e = np.searchsorted(buckets, [a["bucket"], a["bucket"] + 1])
        out[s:e] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=e - s, bitorder="little")
    return out


SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary())])


def later_in_blocks(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """For arrays of distinct hashes in the order of blocks: which hashes an earlier array has."""
    all_ = np.concatenate(arrays)
    order = np.argsort(all_, kind="stable")
    s = all_[order]
    later = np.zeros(len(all_), bool)
    later[order[1:]] = s[1:] == s[:-1]
    return np.split(later, np.cumsum([len(a) for a in arrays])[:-1])


def shared_by_blocks(arrays: list[np.ndarray]) -> list[np.ndarray | None]:
    """For arrays of distinct hashes: which hashes another array has."""
    s = np.sort(np.concatenate(arrays))
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return [None] * len(arrays)
    return [twice[np.minimum(np.searchsorted(twice, a), len(twice) - 1)] == a for a in arrays]


# Rolling hashes: a window's hash is the sum of random numbers for its bytes times powers of an odd number, mod 2^64.

_CHUNK = 1 << 17


class Rolling:
    """Hashes of windows of bytes; seeds give independent ones."""

    def __init__(self, seed: int, span: int = _CHUNK + 4096):
        rnd = np.random.default_rng([seed, 77])
        self.table = rnd.integers(0, 2**64, 256, np.uint64)
        base = np.uint64(int(rnd.integers(2**62, 2**63)) | 5)
        self.up, self.down = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(span, x, np.uint64))]) for x in (base, np.uint64(pow(int(base), -1, 2**64))))

        self.terms, self.sums = np.zeros(span, np.uint64), np.zeros(span + 1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of the terms before each byte; valid until the next call."""
        n = len(data)
        terms = self.terms[:n]
        np.take(self.table, data, out=terms, mode="clip")
        np.multiply(terms, self.up[:n], out=terms)
        np.cumsum(terms, out=self.sums[1 : n + 1])
        return self.sums[: n + 1]

    def windows(self, data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of the window of each start; starts are sorted. Width is at most 4,096."""
        out = np.empty(len(at), np.uint64)
        cuts = np.searchsorted(at, np.arange(0, len(data) + _CHUNK, _CHUNK))
        for n, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if s < e:
                sums = self.prefix(data[n * _CHUNK : n * _CHUNK + _CHUNK + width])
                i = at[s:e] - n * _CHUNK
                out[s:e] = mixed((sums[i + width] - sums[i]) * self.down[i])
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spans(roll: Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of data; starts ascend. Equal bytes have equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > 4096)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _CHUNK, _CHUNK))
    for n, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if s < e:
            sums = roll.prefix(data[n * _CHUNK : n * _CHUNK + _CHUNK + 4096])
            i, j = starts[s:e] - n * _CHUNK, np.minimum(ends[s:e] - n * _CHUNK, len(sums) - 1)
            out[s:e] = mixed((sums[j] - sums[i]) * roll.down[i] + (j - i).astype(np.uint64))
    for k in long.tolist():
        out[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out
