"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of all texts (raw) and one of texts that are labelled good (target),
give each document a log importance weight: log p_target / p_raw, divided by the number of its n-grams, as otherwise the
length of a text would outweigh what it says. Gumbel noise is added to the tempered weights and the k largest keys are kept,
which is sampling without replacement. k is how many documents weigh at least the threshold that separates the labelled
rows best.

N-grams are words, word pairs, and pairs of word shapes (case, what the word ends in, whether it repeats the one
before it); the shapes let junk be known by its form whatever its words.

The raw model counts every document, the target model every document that is labelled good, and the threshold is the best
of all cuts between the weights of all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, small_batches

WORD_BUCKETS = 1 << 16
SHAPE_BUCKETS = 1 << 14
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Labels that meet the documents by broadcast at most; more are joined by id, for which the texts are shuffled.
BROADCAST_ROWS = 1_000_000
#: Log weights are divided by it before noise is added: small beside what separates the classes.
TEMPERATURE = 0.005
SMOOTHING = 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers of words, and hashes by number: of the word in lower case, and of its shape."""

    MOST = 200_000

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def forget(self) -> None:
        self.clear()
        self.word, self.shape = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.word):
            self.word, self.shape = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.shape))
        core = w.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        case = "none" if not core else "lower" if core.islower() else "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() and (len(core) == 1 or core[1:].islower()) else "other"
        self.word[n] = xxhash.xxh64_intdigest(w.lower())
        self.shape[n] = xxhash.xxh64_intdigest(f"{case} {w[len(core) :][:8]}")
        self[w] = n
        return n


_words = _Words()


def forget() -> None:
    """At the end of a task: an idle worker holds no words."""
    _words.forget()


def ngrams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_words) > _Words.MOST:
        _words.forget()
    ids = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    h, s = _words.word[ids], _words.shape[ids]
    pairs = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7))
    shapes = (s[:-1] * _MIX) ^ (s[1:] >> np.uint64(7)) ^ (ids[:-1] == ids[1:]).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
    deal = lambda x, n: (((x ^ (x >> np.uint64(32))) * _MIX) >> np.uint64(40)).astype(np.int64) % n
    return np.concatenate([deal(h, WORD_BUCKETS), deal(pairs, WORD_BUCKETS), WORD_BUCKETS + deal(shapes, SHAPE_BUCKETS)])


def _labelled(labels: DataFrame, id_col: str, label_col: str, label: int) -> DataFrame:
    """Distinct ids (id, as longs) of the rows with a label."""
    return labels.where((F.col(label_col) == label) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull()).distinct()


def _marked(texts: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(text, hit) of all rows of texts (id, text): hit is true if the id is one of ids, which are distinct, and else null."""
    hits, n = ids.withColumn("hit", F.lit(True)), ids.count()
    if n <= most:
        return texts.join(F.broadcast(hits), "id", "left").select("text", "hit")
    # null ids are dealt by text; a task's ids are a table, by which the texts pass unsorted, unless they are too many
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(4096)) + 1).otherwise(0).cast("int")
    hint = "shuffle_hash" if n <= BROADCAST_ROWS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else "merge"
    return texts.withColumn("spread", spread).join(hits.withColumn("spread", F.lit(0)).hint(hint), ["id", "spread"], "left").select("text", "hit")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = BROADCAST_ROWS) -> np.ndarray:
    """Log ratio of the target and raw models by bucket. Without labelled good rows it is zero throughout.

    most: good labels that are broadcast at most.
    """
    small_batches(docs.sparkSession)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in parts:
            for text, hit in zip(part.column(0), part.column(1), strict=True):
                c = np.bincount(ngrams(text.as_py() or ""), minlength=BUCKETS)
                raw += c
                if hit.is_valid:
                    target += c
        forget()
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    # a task sends a row for each bucket at most; the sums are a table of fixed size
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = _marked(texts, _labelled(labels, id_col, label_col, 1), most).mapInArrow(lean(count), "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    last = np.zeros((2, BUCKETS), np.int64)
    for n, c in enumerate(("target", "raw")):
        last[n, sums.column("bucket").to_numpy()] = sums.column(c).to_numpy()
    if not last[0].any():
        return np.zeros(BUCKETS)
    logs = [np.log((x[part] + SMOOTHING) / (x[part].sum() + SMOOTHING * len(x[part]))) for x in last for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS))]
    return np.concatenate([logs[0] - logs[2], logs[1] - logs[3]])


def weigh(docs: DataFrame, ratio: np.ndarray, keep: list[str], id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """The columns keep of docs with log_weight (mean log ratio of the n-grams; none: 0), gumbel_key and key_order.

    key_order is a long in the order of gumbel_key. The noise comes from the id, or the text where it is null, and the seed.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    new = ("log_weight", "gumbel_key", "key_order")
    keep = [c for c in keep if c not in new]
    own = text_col in keep and isinstance(docs.schema[text_col].dataType, T.StringType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for part in parts:
            texts = [x or "" for x in part.column(keep.index(text_col) if own else len(keep) + 1).to_pylist()]
            weight = np.array([ratio[g].mean() if len(g := ngrams(t)) else 0.0 for t in texts])
            names = [str(i) if i is not None else f"?{t}" for i, t in zip(part.column(len(keep)).to_pylist(), texts, strict=True)]
            u = (np.array([xxhash.xxh64_intdigest(x, seed) for x in names], np.uint64) >> np.uint64(11)).astype(np.float64)
            key = weight / temperature - np.log(-np.log((u + 0.5) / 2**53))
            bits = (key + 0.0).view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(np.iinfo(np.int64).max), bits)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(weight), pa.array(key), pa.array(order)], names=[*keep, *new])
        forget()

    fields = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("log_weight", "double").add("gumbel_key", "double").add("key_order", "long")
    taken = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(id_col).cast("string").alias("__id"), *([] if own else [F.col(text_col).cast("string").alias("__text")]))
    return taken.mapInArrow(lean(run), fields)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column without nulls, by four histograms of 16 bits; None beyond its rows."""
    prefix, left = 0, k
    for step in range(4):
        shift = 48 - 16 * step
        # the sign bit is turned, so that the order of bits is the order of numbers
        bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF))
        some = rows if not step else rows.where(F.shiftrightunsigned(bits, shift + 16) == F.lit(prefix))
        for r in sorted(some.groupBy(digit.alias("d")).count().collect(), key=lambda r: -r.d):
            if left <= r["count"]:
                prefix = (prefix << 16) | r.d
                break
            left -= r["count"]
        else:
            return None
    return prefix - (1 << 63)


def threshold(weights: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """The log weight that separates the labelled rows with fewest errors (shares of each class); -inf with one class only.

    An id of several rows weighs as the heaviest. Of cuts with equal errors it is the least.
    """
    good, bad = (_labelled(labels, id_col, label_col, k).withColumn(c, F.lit(1)) for c, k in (("good", 1), ("bad", 0)))
    marks = good.join(bad, "id", "full")
    of = weights.select(F.col(id_col).cast("long").alias("id"), "log_weight").where(F.col("id").isNotNull()).groupBy("id").agg(F.max("log_weight").alias("w"))
    # -0.0 and 0.0 are one group; adding zero makes them one number too
    cuts = materialize(of.join(marks, "id").groupBy((F.col("w") + F.lit(0.0)).alias("w")).agg(F.count("good").alias("good"), F.count("bad").alias("bad")), "cuts")
    total = cuts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total.good or not total.bad:
        return float("-inf")

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range of cuts in order: the first, the one of fewest errors and these beyond the range's first, and the range's rows."""
        first, least, at, g, b = None, None, None, 0, 0
        for part in parts:
            w, ng, nb = (part.column(c).to_numpy() for c in range(3))
            if not len(w):
                continue
            errors = (g + np.cumsum(ng) - ng) * total.bad - (b + np.cumsum(nb) - nb) * total.good
            n = int(np.argmin(errors))
            if least is None or errors[n] < least:
                least, at = int(errors[n]), w[n]
            first, g, b = w[0] if first is None else first, g + int(ng.sum()), b + int(nb.sum())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, at, least, g, b)], names=["first", "at", "least", "good", "bad"])

    ranges = cuts.repartitionByRange("w").sortWithinPartitions("w").select("w", "good", "bad").mapInArrow(best, "first double, at double, least long, good long, bad long")
    found, g, b = [], 0, 0
    for r in sorted(ranges.collect(), key=lambda r: r["first"]):
        found.append((r.least + g * total.bad - b * total.good, r["at"]))
        g, b = g + r.good, b + r.bad
    cut = min(found)[1]
    below = cuts.where(F.col("w") < cut).agg(F.max("w")).first()[0]
    return cut if below is None else (cut + below) / 2


def select_k(weights: DataFrame, cut: float) -> int | None:
    """The least key_order that is kept: k rows, k being how many weigh at least cut; ties with the last are kept."""
    k = weights.where(F.col("log_weight") >= cut).count()
    return kth_largest(weights, "key_order", k) if k else None


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The kept rows of docs: the id, log_weight and gumbel_key, a row for each row kept.

    Null and empty texts weigh 0. Null ids are kept or left as others are, but are never labelled. Without labels of both
    classes all rows are kept. Rows of one id and text are kept or left together; other columns are left out.
    """
    ratio = fit(docs, labels, id_col, text_col, label_col)
    weights = materialize(weigh(docs, ratio, [id_col], id_col, text_col), "weights")
    least = select_k(weights, threshold(weights, labels, id_col, label_col))
    kept = weights.where(F.col("key_order") >= least) if least is not None else weights.limit(0)
    return kept.select(id_col, "log_weight", "gumbel_key")


def filter_docs(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The kept rows of docs with all their columns and values, whatever their names; the rest as in resample."""
    inner = [f"__{i}" for i in range(len(docs.columns))]
    key, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    d, marks = docs.toDF(*inner), labels.select(F.col(id_col).alias(key), F.col(label_col).alias("label"))
    # written with all columns, so that texts are weighed once
    weights = materialize(weigh(d, fit(d, marks, key, text, "label"), inner, key, text), "weights")
    least = select_k(weights, threshold(weights, marks, key, "label"))
    kept = weights.where(F.col("key_order") >= least) if least is not None else weights.limit(0)
    return kept.select(*inner).toDF(*docs.columns)
