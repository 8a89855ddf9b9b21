"""Checks of translated segments, each a row's own: no exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUM, PLACEHOLDER, S, placeholders, utrim

# Fixed values.
NUMBER = r"(?U)\b\d+(?:\.\d+)?%?\b"
REFERENCE = rf"(?i)(?:Figure|Table|Fig\.?){S}*{NUM}+(?:[.-]{NUM}+)?"
REFERENCE_NUMBER = rf"{NUM}+(?:[.-]{NUM}+)?"
MIN_RATIO, MAX_RATIO = 0.3, 3.0
HALLUCINATION_RATIO, HALLUCINATION_LEAST = 2.5, 20
_ISSUES = "array<struct<code: string, severity: string, detail: string>>"


#: The same for Java: where a match can begin is told by its first character, before borders and words are looked at.
_NUMBER = NUMBER.replace("(?U)", r"(?U)(?=\d)")
_REFERENCE = REFERENCE.replace("(?i)", "(?=[FTft])(?i)")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def issues(source: Column, translation: Column, min_ratio: float = MIN_RATIO, max_ratio: float = MAX_RATIO, placeholder: str = PLACEHOLDER) -> Column:
    """What is wrong with a translation, as structs of code, severity (error, warning) and detail; nulls count as empty.

    An empty translation is the only issue of its row. Details name placeholders, lengths, numbers or references in order.
    """
    one = lambda code, severity, detail: F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))).cast(_ISSUES)
    none = F.expr(f"cast(array() as {_ISSUES})")

    def checks(p: Column) -> Column:
        s, t, n, m = (p[c] for c in "stnm")
        lengths = F.concat(m.cast("string"), F.lit("/"), n.cast("string"))
        ratio = F.try_divide(m.cast("double"), n.cast("double"))
        missing = _once(F.array_distinct(_all(s, _NUMBER)), lambda a: F.when(F.size(a) > 0, F.array_sort(F.array_except(a, _all(t, _NUMBER)))))
        lost = lambda refs: F.flatten(F.transform(refs, lambda r: F.transform(F.filter(_all(r, REFERENCE_NUMBER), lambda x: ~F.contains(t, x)), lambda x: F.concat(x, F.lit(" from "), r))))
        parts = [
            _once(F.struct(placeholders(s, placeholder).alias("a"), placeholders(t, placeholder).alias("b")), lambda x: F.when(~x["a"].eqNullSafe(x["b"]), one("placeholders", "error", F.concat(F.array_join(x["a"], ""), F.lit("|"), F.array_join(x["b"], ""))))),
            F.when((n > 0) & (ratio < min_ratio), one("short", "warning", lengths)).when((n > 0) & (ratio > max_ratio), one("long", "warning", lengths)),
            _once(missing, lambda x: F.when(F.size(x) > 0, one("numbers", "warning", F.array_join(x, ",")))),
            _once(F.array_sort(F.array_distinct(_all(s, _REFERENCE))), lambda refs: F.when(F.size(refs) > 0, F.transform(lost(refs), lambda x: F.struct(F.lit("reference").alias("code"), F.lit("warning").alias("severity"), x.alias("detail"))).cast(_ISSUES))),
            F.when((m > n * HALLUCINATION_RATIO) & (n > HALLUCINATION_LEAST), one("hallucination", "warning", lengths)),
        ]
        rest = F.concat(*(F.coalesce(x, none) for x in parts))
        # a text that stands for itself has lost nothing
        alike = F.lit(min_ratio <= 1 <= max_ratio) & (s == t)
        return F.when(m == 0, one("empty", "error", F.lit(""))).when(alike, none).otherwise(rest)

    texts = F.struct(F.coalesce(source, F.lit("")).alias("s"), F.coalesce(translation, F.lit("")).alias("t"))
    return _once(texts, lambda x: _once(F.struct(x["s"].alias("s"), x["t"].alias("t"), F.length(utrim(x["s"])).alias("n"), F.length(utrim(x["t"])).alias("m")), checks))


def validate(pairs: DataFrame, source_col: str = "source", translation_col: str = "translation", **options) -> DataFrame:
    """pairs with issues and is_valid (no errors)."""
    d = pairs.withColumn("issues", issues(F.col(source_col), F.col(translation_col), **options))
    return d.withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def issue_rows(validated: DataFrame, id_col: str = "segment_id") -> DataFrame:
    """One row for each issue."""
    return validated.select(id_col, F.explode("issues").alias("i")).select(id_col, "i.*")


def issue_counts(validated: DataFrame) -> DataFrame:
    """Segments and issues by code and severity, and how many segments are valid, as one table."""
    of_all = F.struct(F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("code"), F.lit("segment").alias("severity"))
    named = F.transform("issues", lambda i: F.struct(i["code"].alias("code"), i["severity"].alias("severity")))
    # one reading of the texts for both counts
    return validated.select(F.explode(F.concat(named, F.array(of_all))).alias("i")).groupBy("i.code", "i.severity").agg(F.count("*").alias("issues"))


def log_lines(validated: DataFrame, source_col: str = "source", translation_col: str = "translation", id_col: str = "segment_id") -> DataFrame:
    """Lines for a log: errors with the first 200 characters of both texts, warnings alone."""
    r = validated.select(id_col, F.col(source_col).alias("s"), F.col(translation_col).alias("t"), F.explode("issues").alias("i"))
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 200)
    line = F.concat(F.upper("i.severity"), F.lit(" segment "), F.col(id_col).cast("string"), F.lit(": "), F.col("i.code"), F.lit(" "), F.col("i.detail"))
    return r.select(id_col, F.when(F.col("i.severity") == "error", F.concat(line, F.lit(" | "), cut(F.col("s")), F.lit(" | "), cut(F.col("t")))).otherwise(line).alias("line"))


def oracle(pairs: str) -> str:
    """One row for each issue in DuckDB SQL, for a table of (segment_id, source, translation)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    number = NUMBER.replace("(?U)", "")
    trim = lambda c: f"regexp_replace({c}, {q('^' + S + '+|' + S + '+$')}, '', 'g')"
    return f"""
        WITH p AS (SELECT segment_id, coalesce(source, '') AS s, coalesce(translation, '') AS t FROM {pairs}),
        f AS (SELECT *, length({trim('s')}) AS n, length({trim('t')}) AS m, regexp_extract_all(s, {q(PLACEHOLDER)}) AS a, regexp_extract_all(t, {q(PLACEHOLDER)}) AS b FROM p),
        r AS (SELECT segment_id, t, unnest(list_distinct(regexp_extract_all(s, {q(REFERENCE)}))) AS ref FROM f WHERE m > 0),
        x AS (SELECT segment_id, t, ref, unnest(regexp_extract_all(ref, {q(REFERENCE_NUMBER)})) AS num FROM r)
        SELECT segment_id, 'empty' AS code, 'error' AS severity, '' AS detail FROM f WHERE m = 0
        UNION ALL SELECT segment_id, 'placeholders', 'error', coalesce(array_to_string(a, ''), '') || '|' || coalesce(array_to_string(b, ''), '') FROM f WHERE m > 0 AND a <> b
        UNION ALL SELECT segment_id, CASE WHEN m / n < {MIN_RATIO} THEN 'short' ELSE 'long' END, 'warning', m || '/' || n FROM f WHERE m > 0 AND n > 0 AND (m / n < {MIN_RATIO} OR m / n > {MAX_RATIO})
        UNION ALL SELECT segment_id, 'numbers', 'warning', array_to_string(list_sort(d), ',') FROM (SELECT segment_id, m, list_filter(list_distinct(regexp_extract_all(s, {q(number)})), lambda z: NOT list_contains(regexp_extract_all(t, {q(number)}), z)) AS d FROM f) WHERE m > 0 AND len(d) > 0
        UNION ALL SELECT segment_id, 'reference', 'warning', num || ' from ' || ref FROM x WHERE NOT contains(t, num)
        UNION ALL SELECT segment_id, 'hallucination', 'warning', m || '/' || n FROM f WHERE m > 0 AND m > n * {HALLUCINATION_RATIO} AND n > {HALLUCINATION_LEAST}
    """
