import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from segmill.llm import queries, warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a b\r\n/", None), (4, "u", ""), (5, "u", "WARC/1.0\r\nWARC/1.1\r\n"),
    (6, "u", INNER * 3 + "tail"), (7, "u", "x" * 200_000 + INNER + "é日😀"), (None, "u", "<p>one</p>"), (None, "u", "alone"), (None, "u", "alone"), (8, "u", "\r\n\r\n"), (9, "u", INNER[:40]), (2, None, "<p>one</p>"),
    (10, "http://a/WARC/1.0/spec", "<p>spec</p>"), (11, "WARC/1.1\r\nContent-Length: 3WARC/1.", INNER), (12, "http://a/WARC/1.0/spec", "<p>one</p>"),
]


def want(rows):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keep = max(same, default=None)
        data = (h or "").encode()
        kind = keep is None or i == keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if kind else "revisit", None if kind else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10, 0])
def test_query(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("n", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op6_warc(spark, str(tmp_path)).collect()), key=str) == want(ROWS)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op6_warc(spark, str(tmp_path)).count() == 0


def test_splits_and_min_bytes(spark, tmp_path):
    """Plain files are cut at any byte; the smallest payloads are never revisits."""
    df = spark.createDataFrame(ROWS * 3, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, f"{tmp_path}/w", min_bytes=100, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = warc.read_records(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3 * len(ROWS)
    assert sorted({bytes(r.payload).decode() for r in got if r.type == "response"}) == sorted({h or "" for _, _, h in ROWS})
    assert {r.type for r in got if (warc_len := int(r.http.rpartition(" ")[2])) < 100} == {"response"} and warc_len >= 0


def test_foreign_files(spark, tmp_path):
    """Other record types and versions are read; a break ends its file, a cut record is left out."""
    info = "WARC/1.0\r\nwarc-type:  warcinfo \r\nContent-Type: text/plain\r\ncontent-length: 9\r\n\r\nsoftware!\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes((info + INNER).encode())
    (tmp_path / "w/b.warc.gz").write_bytes(gzip.compress((info + "junk" + INNER).encode()))
    (tmp_path / "w/c.warc").write_bytes((info + INNER[:-6]).encode())
    (tmp_path / "w/d.warc").write_bytes(b"no archive WARC/1.1\r\n")
    (tmp_path / "w/e.warc").write_bytes(b"")
    got = sorted((r.file[-9:].rpartition("/")[2], r.version, r.type, bytes(r.payload).decode()) for r in warc.read_records(spark, f"{tmp_path}/w").collect())
    assert got == [("a.warc", "1.0", "warcinfo", "software!"), ("a.warc", "1.1", "response", "abc"), ("b.warc.gz"[-9:], "1.0", "warcinfo", "software!"), ("c.warc", "1.0", "warcinfo", "software!")]


@pytest.mark.parametrize("size", ["700", "134217728"])
def test_magic_in_headers(spark, tmp_path, size):
    """Magics in any header line, before and after the length, and in payloads; records keep their urls. Blocks cut anywhere."""
    head = "WARC/1.1\r\nWARC-Type: response\r\nX: WARC/1.0 a\r\nContent-Length: {}\r\nWARC-Target-URI: http://a/WARC/1.0/{}\r\nY: WARC/1.\r\n\r\n{}\r\n\r\n"
    bodies = ["abc", INNER, "", "WARC/1.", "x" * 3000 + "WARC/1.1\r\n", INNER * 20, "end"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes("".join(head.format(len(b), i, b) for i, b in enumerate(bodies)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = warc.read_records(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.target_uri, bytes(r.payload).decode()) for r in got) == sorted((f"http://a/WARC/1.0/{i}", b) for i, b in enumerate(bodies))
