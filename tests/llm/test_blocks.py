import numpy as np
from pyspark.sql import functions as F

from segmill.llm import blocks


def test_hashes_over_chunks(monkeypatch):
    monkeypatch.setattr(blocks, "_CHUNK", 64)
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 1000, np.uint8)
    roll = blocks.Rolling(1)
    at = np.arange(0, 951)
    h = roll.windows(data, at, 50)
    text = data.tobytes()
    by = {}
    for i in at.tolist():
        assert by.setdefault(text[i : i + 50], h[i]) == h[i]
    assert len(set(by.values())) == len(by)
    starts = np.sort(rnd.integers(0, 990, 300))
    ends = np.minimum(starts + rnd.integers(1, 9, 300), 1000)
    spans = {}
    for s, e, x in zip(starts.tolist(), ends.tolist(), blocks.spans(roll, data, starts, ends).tolist(), strict=True):
        assert spans.setdefault(text[s:e], x) == x
    assert len(set(spans.values())) == len(spans)


def test_long_spans():
    data = np.frombuffer(b"ab" * 6000 + b"ab" * 6000, np.uint8)
    h = blocks.spans(blocks.Rolling(2), data, np.array([0, 12000, 12000]), np.array([12000, 24000, 12002]))
    assert h[0] == h[1] != h[2]


def test_pack_order_and_sizes(spark):
    rows = [(i * 7 % 50, f"{i}" * (i * 3 % 40)) for i in range(50)] + [(None, "first"), (60, None)]
    got = blocks.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text", ["doc_id"], 100).orderBy("block").collect()
    ids, texts = [], []
    for r in got:
        ends = np.frombuffer(r.ends, np.int64).tolist()
        assert len(r.ids) == len(ends) == len(r.hashes) // 16 and r.size == len(r.data) and (r.size <= 100 or len(ends) == 1)
        ids += [x.c0 for x in r.ids]
        texts += [bytes(r.data)[s:e].decode() for s, e in zip([0, *ends], ends, strict=False)]
    assert list(zip(ids, texts, strict=True)) == [(None, "first"), *sorted(rows[:50]), (60, "")]


def test_buckets_are_those_of_spark(spark):
    rows = spark.range(0, 10**12, 10**9 + 7).select("id", F.pmod(F.hash("id"), F.lit(37)).alias("b")).collect()
    assert blocks.spark_bucket(np.array([r.id for r in rows]), 37).tolist() == [r.b for r in rows]


def test_pack_deals_evenly(spark, monkeypatch):
    """Tasks follow from the bytes, each writes one file, and a null id of many rows is not one task's."""
    monkeypatch.setattr(blocks, "TASK_BYTES", 10_000)
    texts = [(None if i % 3 else i, f"{i} " * 50) for i in range(900)]
    out = blocks.pack(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", ["doc_id"], 2000)
    got = out.select("block", "size", F.input_file_name().alias("file")).collect()
    tasks = {}
    for r in got:
        tasks.setdefault(r.block >> 32, []).append(r)
    assert len(tasks) > 12 and all(len({r.file for r in rs}) == 1 for rs in tasks.values())
    assert max(sum(r.size for r in rs) for rs in tasks.values()) < 60_000
    assert "Exchange" not in out.groupBy("block").count()._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")  # fewer buckets than tasks: still a file for each task
    try:
        again = blocks.pack(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", ["doc_id"], 2000).select("block", F.input_file_name().alias("file")).collect()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert len({(r.block >> 32, r.file) for r in again}) == len({r.block >> 32 for r in again}) > 12
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("segmill_")]
