"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Reading cuts the files at every magic (WARC/1.) in parallel, so a magic inside a payload makes a false candidate, and one
inside a header (in a url, say) cuts the header, which then goes on in the next pieces to the one in which a header ends.
Each candidate with a well-formed header names its successor: its offset, the header, the content length and the
closing line breaks. Only what the chain from offset 0 reaches is a record. Candidates that point at the very next
one are first contracted to runs with window sums; pointer jumping over the runs' exits, written each round, finds
the runs that the chain enters. Pieces of a record that holds magics are put together again.

Windows see the offsets and lengths of one block of a file, as one task reads it, never payloads; a row for each block
carries offsets and open headers on. A compressed file is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Rows of (file, piece) or (digest, page) up to which a table is broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """One record for each row, payload the body in UTF-8 (null: empty), in as many files as there are tasks.

    Of rows with equal payloads of at least min_bytes, those with the largest id are responses, the others revisits of
    it without the payload; smaller payloads are all responses. Null ids count as smallest; where all ids of equal
    payloads are null, all are responses. Null urls leave the header out; white space and controls in urls are
    percent-encoded away as %20. Other columns are left out.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("n"), sha1_base32(F.col("body").cast("binary")).alias("digest"))
    shared = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("id").alias("keep"), F.count("*").alias("copies"))
    shared = materialize(shared.where("copies > 1 and keep is not null").select("digest", "n", "keep"), "payloads")
    count = shared.count()
    rows = rows.join(_bounded(shared, count), ["digest", "n"], "left") if count else rows.withColumn("keep", F.lit(None).cast("string"))
    first = F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    record = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\s\p{Cntrl}]+", "%20")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(first, "").otherwise(F.concat(line("WARC-Refers-To", urn(F.col("keep"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Length", (F.octet_length(http) + F.when(first, F.col("n")).otherwise(0)).cast("string")),
        F.lit("\r\n"),
        http,
        F.when(first, F.col("body")).otherwise(""),
    )
    rows.select(record.alias("record")).write.option("lineSep", END).option("compression", compression).text(path)


def _field(head: Column, name: str, value: str = r"[^\r\n]*?") -> Column:
    got = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*({value})[ \t]*(?:\r\n|$)", 1)
    return F.when(got != "", got)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies before the first magic and after each, in parallel, with its place in its block of the file.

    head_bytes: bytes before the end of a header, null if none ends here; content: the first length declared before it.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    head = F.substring_index("value", END, 1)
    whole = F.col("value").contains(END)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece"),
        F.octet_length("value").cast("long").alias("bytes"),
        F.when(whole, F.octet_length(head).cast("long")).alias("head_bytes"),
        F.col("value").rlike(r"^[01]\r\n").alias("opens"),
        F.when(whole, _field(head, "Content-Length", r"\d{1,18}")).otherwise(_field(F.concat("value", F.lit("-")), "Content-Length", r"\d{1,18}")).cast("long").alias("content"),
        "value",
    )


def _chained(pieces: DataFrame) -> DataFrame:
    """Pieces (file, piece, offset) with the offset of the record that holds them (null if none does), and whether they are all of it.

    Windows see one block of a file, as one task read it; what crosses blocks is carried by a row for each block.
    """
    block = Window.partitionBy("file", "block")
    order, back = block.orderBy("piece"), block.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    files = Window.partitionBy("file").orderBy("block")
    before, after = files.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("bytes") + len(MAGIC)
    sums = pieces.groupBy("file", "block").agg(F.sum(size).alias("size"))
    sums = sums.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), (F.sum("size").over(Window.partitionBy("file")) - len(MAGIC)).alias("end"))
    # the first piece of a file stands before the first magic and has none
    at = pieces.join(sums, ["file", "block"]).withColumn("seen", F.col("base") + F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    at = at.withColumn("offset", F.when((F.col("base") > 0) | (F.row_number().over(order) > 1), F.col("seen") - len(MAGIC)))
    at = materialize(at.select("file", "block", "piece", "bytes", "offset", "end", "opens", (F.col("seen") + F.col("head_bytes")).alias("header_end"), "content"), "offsets")

    # a header that holds magics goes on to the piece in which one ends, if need be in a later block
    ends, lengths = F.when(F.col("header_end").isNotNull(), F.struct("piece", "header_end")), F.when(F.col("content").isNotNull(), F.struct("piece", "content"))
    firsts = at.groupBy("file", "block").agg(F.min(ends).alias("e"), F.min(lengths).alias("c"))
    own = lambda x: F.when(F.col(x).isNotNull(), F.struct("block", f"{x}.*"))
    firsts = firsts.select("file", "block", F.last(own("e"), True).over(after).alias("far_end"), F.last(own("c"), True).over(after).alias("far_length"))
    at = at.join(firsts, ["file", "block"]).withColumns({"e": F.last(ends, True).over(back), "c": F.last(lengths, True).over(back)})
    far = F.when((F.col("far_length.block") < F.col("far_end.block")) | ((F.col("far_length.block") == F.col("far_end.block")) & (F.col("far_length.piece") <= F.col("far_end.piece"))), F.col("far_length.content"))
    length = F.when(F.col("c").isNotNull() & (F.col("e").isNull() | (F.col("c.piece") <= F.col("e.piece"))), F.col("c.content")).when(F.col("e").isNull(), far)
    next_ = F.coalesce("e.header_end", "far_end.header_end") + length + 2 * len(END)
    at = at.withColumn("next", F.when(F.col("offset").isNotNull() & F.col("opens") & (next_ <= F.col("end")), next_))

    tight = at.withColumn("breaks", F.when(F.lag("next").over(order) == F.col("offset"), 0).otherwise(1)).withColumn("run", F.sum("breaks").over(order))
    run = Window.partitionBy("file", "block", "run")
    runs = tight.withColumn("exit", F.max_by("next", "piece").over(run))
    runs = materialize(runs.select("file", "block", "piece", "bytes", "offset", "next", "run", "exit"), "chain")
    # the chain may enter a run in its middle, so what is reached is kept by offset
    jumps = runs.where("offset is not null and exit is not null").select("file", F.col("offset").alias("from"), F.col("exit").alias("to"))
    reached = materialize(runs.where("offset = 0").select("file", "offset"), "reached")
    known = reached.count()
    while True:
        step = reached.join(jumps, (reached.file == jumps.file) & (reached["offset"] == jumps["from"])).select(reached.file, F.col("to").alias("offset"))
        reached = materialize(reached.union(step).distinct(), "reached")
        if (now := reached.count()) == known:
            break
        known = now
        far = jumps.select("file", F.col("from").alias("to"), F.col("to").alias("far"))
        jumps = materialize(jumps.join(far, ["file", "to"]).select("file", "from", F.col("far").alias("to")), "jumps")
    entries = runs.join(reached, ["file", "offset"], "left_semi").groupBy("file", "block", "run").agg(F.min("offset").alias("entry"))
    held = runs.join(entries, ["file", "block", "run"], "left")
    held = held.withColumn("start", F.when((F.col("offset") >= F.col("entry")) & F.col("next").isNotNull(), F.struct(F.col("offset").alias("record"), F.col("next").alias("until"))))
    open_ = held.groupBy("file", "block").agg(F.max("start").alias("s")).select("file", "block", F.last("s", True).over(before).alias("carried"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = held.join(open_, ["file", "block"]).withColumn("in", F.coalesce(F.last("start", True).over(upto), "carried"))
    single = F.col("start").isNotNull() & (F.col("next") == F.col("offset") + len(MAGIC) + F.col("bytes"))
    return held.select("file", "piece", "offset", F.when(F.col("offset") < F.col("in.until"), F.col("in.record")).alias("record"), single.alias("single"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, plain or compressed as the names' endings say.

    Columns: file, version, type, record_id, target_uri, refers_to, declared (payload digest), http (the block's HTTP
    header, null if it has none), payload (binary). After a broken record, a file's rest is unreachable and is left
    out, as is a record that ends beyond its file. Empty files give no rows.
    """
    pieces = materialize(_pieces(spark, path), "pieces")
    chain = materialize(_chained(pieces.drop("value")), "records")
    odd = materialize(chain.where("not coalesce(single, false) and offset is not null").select("file", "piece", "record"), "odd")
    count = odd.count()
    rows = pieces.where("value != ''").select("file", "piece", "value")
    texts = rows.select("file", "value")
    if count:
        marked = rows.join(_bounded(odd.withColumn("odd", F.lit(True)), count), ["file", "piece"], "left")
        texts = marked.where("odd is null").select("file", "value")
        parts = marked.where("odd and record is not null").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"))
        texts = texts.union(parts.select("file", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value")))
    texts = texts.where(F.col("value").rlike(r"^[01]\r\n"))
    return _parsed(texts)


def _parsed(texts: DataFrame) -> DataFrame:
    head = F.substring_index("value", END, 1)
    t = texts.select("file", head.alias("head"), F.expr(f"substring(cast(value as binary), octet_length(substring_index(value, '{END}', 1)) + {len(END) + 1})").alias("rest"))
    t = t.withColumn("content", F.least(_field(F.col("head"), "Content-Length", r"\d{1,18}").cast("long"), F.lit(2**31 - 1)).cast("int"))
    t = t.select("*", F.expr("substring(rest, 1, content)").alias("block"))
    http = _field(F.col("head"), "Content-Type").startswith("application/http") & F.col("block").cast("string").contains(END)
    t = t.withColumn("http", F.when(http, F.substring_index(F.col("block").cast("string"), END, 1)))
    urn = lambda name: F.regexp_extract(_field(F.col("head"), name), "^<?(.*?)>?$", 1)
    return t.select(
        "file",
        F.concat(F.lit("1."), F.substring("head", 1, 1)).alias("version"),
        _field(F.col("head"), "WARC-Type").alias("type"),
        urn("WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"),
        urn("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), "^(?i:sha1:)?(.*)$", 1).alias("declared"),
        "http",
        F.expr(f"case when http is null then block else substring(block, octet_length(http) + {len(END) + 1}) end").alias("payload"),
    )


def http_length(http: Column) -> Column:
    """The Content-Length that an HTTP header declares."""
    return _field(http, "Content-Length", r"\d{1,18}").cast("long")
