"""The queries of this subpackage by name, each over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, license, lines, quality, secrets, simhash, suffixes, warc
from .common import shared_dir

VOCAB = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without lines that are similar to an earlier one."""
    out = lines.remove_lines(table(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("removed", lambda n: n.cast("string")), ",")
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), removed.alias("removed_lines"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    path, pattern = public_tokenizers.path(VOCAB), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"])
    ids = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    out = license.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the record that was written for it and read back."""
    path = shared_dir(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    r = warc.read_records(spark, path)
    response = F.col("type") == "response"
    return r.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^urn:page:(-?[0-9]*):', 1), '') as long)").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(warc.http_length(F.col("http"))).alias("payload_bytes"),
        F.when(response, warc.sha1_base32(F.col("payload"))).otherwise(F.col("declared")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^urn:page:(-?[0-9]*):', 1), '') as long)").alias("refers_to"),
    )


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated strings of 100 bytes."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and what ownership in the whole corpus adds, for every document."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count("base", i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])),
        *(count("added", i + 3).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[3:])),
        F.sha2(secrets.text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.text_of(F.concat("base", "added")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the good labels keeps."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, with the item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_ann": op2_ann,
    "op3_bpe": op3_bpe,
    "op4_license": op4_license,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_suffixes": op7_suffixes,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_decontam": op10_decontam,
}



def _secrets_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [(0, secrets.ASSIGN, 2, secrets.ASSIGN_LEAST), (1, secrets.ACCESS, 0, 0), (2, secrets.HEX, 0, 0), (9, secrets.RUN, 0, 0)]
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    found = " UNION ALL ".join(
        f"SELECT row, {k} AS kind, m[i] AS m, v[i] AS v, ({total('b[1:i]')} + {total('m[1:i-1]')})::BIGINT AS s FROM "
        f"(SELECT row, regexp_extract_all(text, {q(p)}) AS m, regexp_extract_all(text, {q(p)}, {g}) AS v, string_split_regex(text, {q(p)}) AS b, unnest(range(1, len(m) + 1)) AS i FROM d) WHERE length(v[i]) >= {n}"
        for k, p, g, n in kinds
    )
    names = "['assign', 'access', 'hex', 'live', 'example']"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
        f AS MATERIALIZED ({found}),
        base AS (SELECT row, kind, s, s + length(m) AS e FROM f WHERE kind < 3),
        cand AS (SELECT DISTINCT row, v, s + length(m) - length(v) AS s, s + length(m) AS e FROM f
            WHERE (kind = 9 OR kind = 0 AND length(v) >= {secrets.VALUE_LEAST}) AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')),
        uses AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS repositories FROM cand JOIN d USING (row) GROUP BY v),
        added AS (SELECT row, CASE WHEN owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} THEN 3 ELSE 4 END AS kind, s, e FROM cand JOIN uses USING (v)),
        spans AS (SELECT *, {names}[kind + 1] || ':' || s || ':' || e AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
        g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            count(*) FILTER (kind = 3) AS n_live, count(*) FILTER (kind = 4) AS n_example,
            string_agg(t, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS b, string_agg(t, ',' ORDER BY s, kind, e) AS spans FROM spans GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live,
            coalesce(n_example, 0) AS n_example, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (row)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_lines": r"""
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT r, string_split(t, chr(10)) AS ls FROM d),
        l AS MATERIALIZED (SELECT r, i, ls[i] AS line, row_number() OVER (ORDER BY r, i) AS id FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
        w AS MATERIALIZED (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\v\f]+'), lambda x: x <> ''))) AS ws FROM l),
        c AS MATERIALIZED (SELECT ws, len(ws) AS n, min(id) AS lead FROM w WHERE len(ws) > 0 GROUP BY ws),
        t AS MATERIALIZED (SELECT lead, n, unnest(ws) AS word FROM c),
        f AS MATERIALIZED (SELECT word, count(*) AS df FROM t GROUP BY word),
        p AS MATERIALIZED (SELECT lead, n, word FROM (SELECT lead, n, word, row_number() OVER (PARTITION BY lead ORDER BY df, word) AS k FROM t JOIN f USING (word)) WHERE k <= n - (4 * n + 4) // 5 + 1),
        q AS (SELECT DISTINCT a.lead AS x, b.lead AS y FROM p a JOIN p b ON a.word = b.word AND a.lead > b.lead AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        v AS (SELECT DISTINCT x FROM q JOIN c a ON a.lead = x JOIN c b ON b.lead = y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
        g AS (SELECT id FROM w JOIN c USING (ws) WHERE id <> lead UNION SELECT x FROM v),
        o AS (SELECT r, count(*) AS n_lines, count(g.id) AS n_removed, coalesce(string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FILTER (g.id IS NOT NULL), '') AS removed_lines,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.id IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN g USING (id) GROUP BY r)
        SELECT doc_id, n_lines, n_removed, removed_lines, kept_sha256 FROM d JOIN o USING (r)
    """,
    "op4_license": f"SELECT doc_id, coalesce(array_to_string(sentences, ','), '') AS sentences, coalesce(array_to_string(licenses, ','), '') AS licenses, len(licenses)::BIGINT AS n_licenses FROM ({license.oracle('documents')})",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
        c AS (SELECT page_id, n, list_transform([1, 11, 21, 31], lambda i: ('0x' || substring(x, i, 10))::BIGINT) AS v FROM h),
        d AS (SELECT page_id, n, array_to_string(list_transform(flatten(list_transform(v, lambda y: list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda k: (y >> k) & 31))), lambda q: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', q::BIGINT + 1, 1)), '') AS digest FROM c),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS keep FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM m
    """,
    "op7_suffixes": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS MATERIALIZED (SELECT r, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT r, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
        f AS (SELECT s, min(r * 10000000000 + p) AS first FROM w GROUP BY s HAVING count(*) > 1),
        g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w JOIN f USING (s) WHERE r * 10000000000 + p > first),
        k AS (SELECT r, p, count(*) FILTER (before IS NULL OR p > before + 100) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
        c AS (SELECT r, k, min(p) AS a, max(p) + 100 AS e FROM k GROUP BY r, k),
        t AS (SELECT c.r, a, e, substring(h, 2 * coalesce(lag(e) OVER (PARTITION BY c.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(e) OVER (PARTITION BY c.r ORDER BY a), 0))) AS piece FROM c JOIN d ON c.r = d.r),
        o AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(piece, '' ORDER BY a) AS head, max(e) AS last FROM t GROUP BY r)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (r)
    """,
    "op8_secrets": _secrets_sql(),
    "op2_ann": """
        WITH v AS (
            SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
