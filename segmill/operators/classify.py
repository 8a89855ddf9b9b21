"""Which pages keep their layout: tables of contents, indexes, lists of symbols, references.

Two plans give the same result: page_kinds() works on the array of a page's lines and needs no exchange; page_kinds_by_line()
takes lines as rows and aggregates them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUM, S, lines_of, utrim

# The patterns that lines are scored by.
LEADER = r"[\x08\x{fffd}\x{2500}-\x{257f}]"
DOTS = rf"\.{{5,}}|(\.{S}){{4,}}|{LEADER}{{3,}}"
LEADER_NUMBER = rf"{LEADER}+{S}*{NUM}{{1,4}}{S}*$"
NON_SPACE = "[^" + S[1:]
SPACED_NUMBER = rf"{NON_SPACE}{S}{{5,}}{NUM}{{1,4}}{S}*$"
ONLY_NUMBER = rf"^{NUM}{{1,4}}$"
WIDE_NUMBER = rf"[\x{{2002}}\x{{2003}}]+{S}*{NUM}{{1,4}}{S}*$"
WIDE_ROMAN = rf"(?i)[\x{{2002}}\x{{2003}}]+{S}*[ivxlcdm]+{S}*$"
CONTENTS = rf"(?i)^(table{S}+of{S}+)?contents?$"
ENDS_IN_NUMBER = rf"{NON_SPACE}{S}+{NUM}{{1,4}}{S}*$"
COMMA_NUMBER = rf",{S}*{NUM}{{1,4}}"
INDEX = r"(?i)^index$"
NOMENCLATURE = rf"(?i)^(nomenclature|list{S}+of{S}+symbols|symbols?{S}+and{S}+abbreviations?|glossary|notation)s?$"
REFERENCES = rf"(?i)^\x{{ad}}?(references?|bibliography|suggested{S}+reading|further{S}+reading|works?{S}+cited)$"
NUMBERED = rf"^{NUM}{{1,3}}\.{S}"
AUTHOR_YEAR = rf"^[A-Z][a-z]+,?{S}.*\({NUM}{{4}}\)"
BRACKETED = rf"^\[{NUM}{{1,3}}\]"
YEAR = rf"\({NUM}{{4}}\)"
BOOK_OR_LINK = r"(?i)ISBN|ISSN|doi\.org|https?://"
DIGITS = rf"^{NUM}+$"


def _holds(x: Column, *parts: str) -> Column:
    return reduce(or_, (F.contains(x, F.lit(p)) for p in parts))


def _far(x: Column) -> Column:
    """Whether a line holds what is no ASCII, or the control that stands for a leader: all leaders and wide spaces are such."""
    return (F.octet_length(x) != F.length(x)) | F.contains(x, F.lit("\x08"))


#: What a line must hold for a pattern to fit, told without a pattern: few lines hold it.
_NEEDED = {
    DOTS: lambda x: F.contains(x, F.lit(".")) | _far(x), LEADER_NUMBER: _far, WIDE_NUMBER: _far, WIDE_ROMAN: _far, COMMA_NUMBER: lambda x: F.contains(x, F.lit(",")), NUMBERED: lambda x: F.contains(x, F.lit(".")),
    AUTHOR_YEAR: lambda x: F.contains(x, F.lit("(")), BRACKETED: lambda x: F.startswith(x, F.lit("[")), YEAR: lambda x: F.contains(x, F.lit("(")), BOOK_OR_LINK: lambda x: _holds(F.lower(x), "isbn", "issn", "doi.org", "http"),
    ONLY_NUMBER: lambda x: F.octet_length(x) <= 20,
}
#: A digit at a line's end, which two patterns of spaces need; trimmed first, so that only one character is looked at.
_NEEDED |= {p: lambda x: F.right(utrim(x), F.lit(1)).rlike(NUM) for p in (SPACED_NUMBER, ENDS_IN_NUMBER)}


def _fits(x: Column, pattern: str) -> Column:
    """Whether a pattern is found in a line."""
    hit = x.rlike(pattern)
    return _NEEDED[pattern](x) & hit if pattern in _NEEDED else hit


def line_class(x: Column) -> Column:
    """How a line hints at a table of contents: 3 and 2 are its points, -1 spaced number, -2 number alone, 0 none."""
    return F.when(_fits(x, DOTS), 3).when(_fits(x, LEADER_NUMBER), 2).when(_fits(x, SPACED_NUMBER), -1).when(_fits(x, ONLY_NUMBER), -2).otherwise(0)


def _is_wide(x: Column) -> Column:
    return _far(x) & (x.rlike(WIDE_NUMBER) | x.rlike(WIDE_ROMAN))


def _is_pair(a: Column, b: Column) -> Column:
    return (F.length(a) <= 15) & (F.length(b) > 5) & ~a.rlike(DIGITS)


def _decision(m: dict[str, Column]) -> Column:
    """Kind and detail from a page's measures; the first rule that fits wins."""
    n, alone = m["n"], m["alone"]
    score = m["points"] + F.when(m["contents"], 5).otherwise(0)
    score = score + F.when(m["spaced"] >= 5, m["spaced"]).otherwise(0) + F.when(m["wide"] >= 5, m["wide"]).otherwise(0)
    score = score + F.when((alone >= 8) & (score > 0), alone).otherwise(0)
    score = score + F.when((n >= 15) & (alone >= 10) & (alone / n > 0.3), alone).otherwise(0)
    score = score + F.when((n >= 15) & (m["ending"] / n > 0.8), m["ending"]).otherwise(0)
    refs = m["numbered"] + m["authors"] + m["bracketed"]
    signals = m["years"] + m["books"]
    counts = F.concat(F.lit("refs="), refs.cast("string"), F.lit(", years="), m["years"].cast("string"), F.lit(", isbn_doi="), m["books"].cast("string"))
    of = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"), F.lit("/"), n.cast("string"))
    made = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    return (
        F.when(n == 0, None)
        .when(score >= 8, made("TOC", F.concat(F.lit("score="), score.cast("string"))))
        .when((n >= 20) & (m["commas"] / n > 0.4), made("INDEX", of("comma_num", m["commas"])))
        .when(m["index"], made("INDEX", F.lit("header")))
        .when(m["symbols"] & (n >= 10) & (m["pairs"] / n > 0.3), made("NOMENCLATURE", of("pairs", m["pairs"])))
        .when(m["references"] & (refs + signals >= 5), made("REFERENCES", F.concat(F.lit("header, "), counts)))
        .when((n >= 10) & (refs >= 5) & (signals >= 3), made("REFERENCES", counts))
    )


_COUNTED = {"commas": COMMA_NUMBER, "ending": ENDS_IN_NUMBER, "numbered": NUMBERED, "authors": AUTHOR_YEAR, "bracketed": BRACKETED, "years": YEAR, "books": BOOK_OR_LINK}
_HEADS = {"contents": (CONTENTS, 5), "index": (INDEX, 1), "symbols": (NOMENCLATURE, 5), "references": (REFERENCES, 10)}


def page_kinds(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """pages with kind and detail (null: not kept). Without an exchange; null and empty texts are of no kind."""
    p = pages.withColumn("__l", lines_of(F.coalesce(F.col(text_col), F.lit(""))))
    p = p.withColumn("__c", F.transform("__l", line_class))
    count = lambda f, of="__l": F.size(F.filter(of, f))
    m = {
        "n": F.size("__l"),
        "points": F.aggregate("__c", F.lit(0), lambda s, x: s + F.greatest(x, F.lit(0))),
        "spaced": count(lambda x: x == -1, "__c"),
        "alone": count(lambda x: x == -2, "__c"),
        "wide": count(_is_wide),
        "pairs": F.size(F.filter(F.zip_with("__l", F.slice("__l", 2, 1 << 30), lambda a, b: F.coalesce(_is_pair(a, b), F.lit(False))), lambda x: x)),
    }
    fits = lambda pattern: lambda x: _fits(x, pattern)
    m |= {k: count(fits(v)) for k, v in _COUNTED.items()}
    m |= {k: F.exists(F.slice("__l", 1, n), fits(v)) for k, (v, n) in _HEADS.items()}
    # a generator of one row, so that the measures are made once and not again wherever the decision names them
    p = p.select("*", F.explode(F.array(F.struct(*(c.alias(k) for k, c in m.items())))).alias("__m"))
    d = _decision({k: F.col(f"__m.{k}") for k in m})
    return p.withColumn("__d", d).withColumn("kind", F.col("__d.kind")).withColumn("detail", F.col("__d.detail")).drop("__l", "__c", "__m", "__d")


def page_kinds_by_line(lines: DataFrame, page_col: str = "page_id", pos_col: str = "pos", line_col: str = "line") -> DataFrame:
    """(page, kind, detail) from trimmed lines as rows; the lines of a page need not be in one row."""
    order = Window.partitionBy(page_col).orderBy(pos_col)
    x = F.col(line_col)
    l = lines.where(x != "").select(page_col, x.alias("x"), F.row_number().over(order).alias("i"), F.lead(x).over(order).alias("next")).withColumn("c", line_class(F.col("x")))
    x = F.col("x")
    m = {"n": F.count("*"), "points": F.sum(F.greatest("c", F.lit(0))), "spaced": F.count_if(F.col("c") == -1), "alone": F.count_if(F.col("c") == -2), "wide": F.count_if(_is_wide(x)), "pairs": F.count_if(_is_pair(x, F.col("next")))}
    m |= {k: F.count_if(_fits(x, v)) for k, v in _COUNTED.items()} | {k: F.bool_or((F.col("i") <= n) & x.rlike(v)) for k, (v, n) in _HEADS.items()}
    g = l.groupBy(page_col).agg(*(c.alias(k) for k, c in m.items()))
    return g.withColumn("d", _decision({k: F.col(k) for k in m})).select(page_col, "d.kind", "d.detail")


def oracle(lines: str) -> str:
    """The decision in DuckDB SQL for a table of (page_id, pos, line)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    hit = lambda p, c="x": f"regexp_matches({c}, {q(p)})"
    counted = ", ".join(f"count(*) FILTER ({hit(v)}) AS {k}" for k, v in _COUNTED.items())
    heads = ", ".join(f"coalesce(bool_or({hit(v)} AND i <= {n}), false) AS {k}" for k, (v, n) in _HEADS.items())
    return f"""
        WITH l AS (SELECT page_id, line AS x, row_number() OVER w AS i, lead(line) OVER w AS nx FROM {lines} WHERE line <> '' WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
        c AS (SELECT *, CASE WHEN {hit(DOTS)} THEN 3 WHEN {hit(LEADER_NUMBER)} THEN 2 WHEN {hit(SPACED_NUMBER)} THEN -1 WHEN {hit(ONLY_NUMBER)} THEN -2 ELSE 0 END AS c FROM l),
        m AS (SELECT page_id, count(*) AS n, sum(greatest(c, 0)) AS points, count(*) FILTER (c = -1) AS spaced, count(*) FILTER (c = -2) AS alone,
            count(*) FILTER ({hit(WIDE_NUMBER)} OR {hit(WIDE_ROMAN)}) AS wide,
            count(*) FILTER (length(x) <= 15 AND length(nx) > 5 AND NOT {hit(DIGITS)}) AS pairs, {counted}, {heads} FROM c GROUP BY page_id),
        s AS (SELECT *, points + CASE WHEN contents THEN 5 ELSE 0 END + CASE WHEN spaced >= 5 THEN spaced ELSE 0 END + CASE WHEN wide >= 5 THEN wide ELSE 0 END AS s0, numbered + authors + bracketed AS refs FROM m),
        t AS (SELECT *, (s0 + CASE WHEN alone >= 8 AND s0 > 0 THEN alone ELSE 0 END + CASE WHEN n >= 15 AND alone >= 10 AND alone / n > 0.3 THEN alone ELSE 0 END
            + CASE WHEN n >= 15 AND ending / n > 0.8 THEN ending ELSE 0 END)::BIGINT AS score, 'refs=' || refs || ', years=' || years || ', isbn_doi=' || books AS counts FROM s),
        k AS (SELECT *, CASE WHEN score >= 8 THEN 'TOC' WHEN n >= 20 AND commas / n > 0.4 THEN 'INDEX' WHEN "index" THEN 'HEADER' WHEN symbols AND n >= 10 AND pairs / n > 0.3 THEN 'NOMENCLATURE'
            WHEN "references" AND refs + years + books >= 5 THEN 'REFHEAD' WHEN n >= 10 AND refs >= 5 AND years + books >= 3 THEN 'REFERENCES' END AS k FROM t)
        SELECT page_id, CASE k WHEN 'HEADER' THEN 'INDEX' WHEN 'REFHEAD' THEN 'REFERENCES' ELSE k END AS kind,
            CASE k WHEN 'TOC' THEN 'score=' || score WHEN 'INDEX' THEN 'comma_num=' || commas || '/' || n WHEN 'HEADER' THEN 'header' WHEN 'NOMENCLATURE' THEN 'pairs=' || pairs || '/' || n
                WHEN 'REFHEAD' THEN 'header, ' || counts WHEN 'REFERENCES' THEN counts END AS detail FROM k
    """
