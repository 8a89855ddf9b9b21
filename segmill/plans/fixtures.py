"""Input tables derived from the benchmark tables, in SQL that Spark and DuckDB both read.

They hold what the operators look for (the raw texts hardly do), with negatives beside the positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name: the tables it is made of, and the query.
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "d_pages": (
        ("lineitem", "orders", "part"),
        """
        SELECT page_id, pos, line FROM (
            SELECT o_custkey AS page_id, pos, CASE o_custkey % 5
                WHEN 0 THEN p_name || ' ..... ' || l_linenumber WHEN 1 THEN p_name || ',' || p_size WHEN 2 THEN p_name
                WHEN 3 THEN '[' || l_linenumber || '] ' || p_brand || ' (' || year(l_shipdate) || ')' ELSE p_name || ' is of the type ' || p_type END AS line
            FROM (SELECT o_custkey, p_name, p_size, p_brand, p_type, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) x
            UNION ALL
            SELECT DISTINCT o_custkey, 0, CASE o_custkey % 5 WHEN 0 THEN 'Contents' WHEN 1 THEN 'Index of parts' WHEN 2 THEN 'Nomenclature' WHEN 3 THEN 'References' ELSE 'Prose' END FROM orders) y
        """,
    ),
    "d_pairs": (
        ("documents",),
        """
        SELECT segment_id, source, CASE segment_id % 7 WHEN 0 THEN source WHEN 1 THEN '  ' WHEN 2 THEN replace(source, '</b0>', '') WHEN 3 THEN replace(source, '15', '')
            WHEN 4 THEN substring(source, 1, 20) WHEN 5 THEN source || ' ' || source || ' ' || source || ' ' || source ELSE replace(source, '3-2', '4') END AS translation
        FROM (SELECT doc_id AS segment_id, replace(text, chr(10), ' ') || CASE doc_id % 5 WHEN 0 THEN ' <b0></b0>' WHEN 1 THEN ' see Figure 3-2' WHEN 2 THEN ' of 15 mm' WHEN 3 THEN ' at 45.5% in Table 15' ELSE '' END AS source FROM documents) x
        """,
    ),
    "d_glossary": (
        ("part",),
        "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS en, p_type AS vi, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS notes, CAST(p_partkey % 2 AS INT) AS tier, p_partkey AS line_no FROM part",
    ),
    "d_events": (
        ("events",),
        "SELECT user_id AS segment_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END AS event, event_type || ':' || event_id AS payload FROM events",
    ),
    "d_versions": (
        ("documents",),
        "SELECT doc_id AS segment_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text_v1, CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN substring(text, 2) ELSE text END END AS text_v2 FROM documents",
    ),
    "d_boxes": (
        ("lineitem",),
        """
        SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate) AS seq,
            l_quantity * 10 AS x0, CAST(l_partkey % 700 AS DOUBLE) AS y0, l_quantity * 10 + 50 + l_linenumber * 20 AS x1, CAST(l_partkey % 700 AS DOUBLE) + 30 + CAST(l_suppkey % 60 AS DOUBLE) AS y1,
            l_discount * 10 AS conf, CAST(l_suppkey % 8 AS INT) AS cls FROM lineitem
        """,
    ),
    "d_glyphs": (
        ("lineitem",),
        """
        SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_shipdate) AS seq,
            l_quantity * 11 + 3.5 AS x0, CAST(l_partkey % 790 AS DOUBLE) + 0.25 AS y0, CASE WHEN l_suppkey % 9 = 0 THEN '•' ELSE 'a' END AS text FROM lineitem
        """,
    ),
    "d_ink": (
        ("lineitem",),
        """
        SELECT l_orderkey AS para_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_shipdate) - 1 AS lidx,
            CAST(l_linenumber AS DOUBLE) AS dy, CAST(l_quantity AS DOUBLE) / 4 AS ylen, CAST(l_suppkey % 3 AS DOUBLE) * 5 AS size FROM lineitem
        """,
    ),
    "d_outline": (
        ("orders",),
        """
        SELECT o_custkey AS doc_id, ord, CAST(1 + o_orderkey % 3 AS INT) AS level, CASE o_orderkey % 4 WHEN 0 THEN ' Chapter ' || ord || ' ' || o_orderpriority WHEN 1 THEN ord || ' - ' || o_orderstatus || '/x' WHEN 2 THEN 'Index' ELSE 'Preface ' || ord END AS title,
            CAST(o_orderkey % 120 - 5 AS INT) AS page FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders) x
        """,
    ),
    "d_fonts": (
        ("part",),
        "SELECT p_partkey AS glyph_id, CASE p_partkey % 8 WHEN 0 THEN 'ABCDEF+CMMI10' WHEN 1 THEN 'CMR10' WHEN 2 THEN 'XYZABC+Myriad-Bold' WHEN 3 THEN 'Times-Italic' WHEN 4 THEN 'FiraCode-Regular' WHEN 5 THEN 'GothamBook' WHEN 6 THEN 'Garamond' ELSE 'Q+Roboto-Black' END AS font, CASE p_partkey % 7 WHEN 0 THEN 'α' WHEN 1 THEN '=' WHEN 2 THEN ' ' WHEN 3 THEN '(cid:3)' WHEN 4 THEN '€' ELSE 'x' END AS text, CAST(p_size AS DOUBLE) AS size FROM part",
    ),
    "d_versions_tags": (
        ("part",),
        "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'v' || p_partkey % 3 || '.' || p_size || '.0-rc1' WHEN 1 THEN ' ' || p_size || '.2' WHEN 2 THEN 'nightly' WHEN 3 THEN '' WHEN 4 THEN p_partkey % 2 || '.' || p_size || '.' || p_partkey || '+b' ELSE '1.x' END AS tag, '1.' || (p_partkey % 40) || '.7' AS current FROM part",
    ),
    "d_ranges": (
        ("part",),
        "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '1,' || p_size || '-' || (p_size + p_partkey % 4) WHEN 1 THEN p_size || '-' || (p_size - 1) WHEN 2 THEN '0,' || p_size WHEN 3 THEN (p_size + 1) || ',' || (p_size + 1) ELSE p_name END AS spec FROM part",
    ),
    "d_json": (
        ("part",),
        """
        SELECT p_partkey % 10 AS file_id, p_partkey AS line_no, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '{"en": "' || p_name || '"}' WHEN 3 THEN '{"en": 5, "vi": "x"}' WHEN 4 THEN '{"en": "' || upper(p_name) || '", "vi": " ' || p_type || ' ", "notes": "n"}' WHEN 5 THEN '{"en": " ", "vi": "y"}' ELSE '{"en": "' || p_name || '", "vi": "' || p_type || '"}' END AS line FROM part
        """,
    ),
}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over as many tasks as the session has, for work that costs much more than a shuffle of its input: a file of one row group is one task else."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used, sql = FIXTURES[name]
    sql = sql.replace("{", "{{").replace("}", "}}")  # the braces of JSON; those of tables come next
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **tables(spark, sf_dir, *used))


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL with fixtures as common tables before it."""
    heads = ", ".join(f"{n} AS MATERIALIZED ({FIXTURES[n][1]})" for n in names)
    return f"WITH {heads} SELECT * FROM ({sql})"
