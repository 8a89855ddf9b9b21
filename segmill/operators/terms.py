"""Glossaries, translation memories and caches: keyed tables that texts are looked up in.

Lookups are equi-joins whose side Catalyst broadcasts if it is small enough; nothing here forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER, is_blank, placeholders, utrim
from .state import upsert

# Fixed value: the line above a prompt's terms.
HEADER = "Terminology glossary (use these translations consistently):"
MAX_TERMS = 100


def merge_glossaries(rows: DataFrame) -> DataFrame:
    """One row for each term from (en, vi, notes, tier, line_no): of the highest tier, there the last line.

    Terms differ without case; rows without a term or a translation are left out. An aggregate, so a hot term costs no window.
    """
    r = rows.select(utrim(F.col("en")).alias("en"), utrim(F.col("vi")).alias("vi"), F.coalesce(utrim(F.col("notes")), F.lit("")).alias("notes"), "tier", "line_no").where("en != '' and vi != ''")
    g = r.groupBy(F.lower("en").alias("key")).agg(F.max(F.struct("tier", "line_no", "en", "vi", "notes")).alias("r"))
    return g.select("key", "r.en", "r.vi", "r.notes")


def add_terms(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """A merged glossary with terms (en, vi, notes) added or replaced, the last of equal ones by their text."""
    old = glossary.select("en", "vi", "notes", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("line_no"))
    return merge_glossaries(old.unionByName(terms.select("en", "vi", "notes", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("line_no"))))


def lookup(terms: DataFrame, glossary: DataFrame, term_col: str = "term") -> DataFrame:
    """terms with vi and notes, null where the glossary has none."""
    g = glossary.select("key", "vi", "notes")
    return terms.join(g, F.lower(term_col) == F.col("key"), "left").drop("key")


def contains(terms: DataFrame, glossary: DataFrame, term_col: str = "term") -> DataFrame:
    """The terms that the glossary has."""
    return terms.join(glossary.select("key"), F.lower(term_col) == F.col("key"), "left_semi")


def prompt_line(en: Column, vi: Column, notes: Column | None = None) -> Column:
    line = F.concat(F.lit("  "), en, F.lit(" = "), vi)
    return line if notes is None else F.when(notes != "", F.concat(line, F.lit(" ("), notes, F.lit(")"))).otherwise(line)


def prompt_context(glossary: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """One row: a prompt's glossary of the first terms in order; empty without terms. The limit is the feature."""
    first = glossary.select("key", prompt_line(F.col("en"), F.col("vi"), F.col("notes")).alias("line")).orderBy("key").limit(max_terms)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"])
    return first.agg(F.when(F.count("*") > 0, F.array_join(F.concat(F.array(F.lit(HEADER)), lines), "\n")).otherwise("").alias("context"))


def clean_memory(rows: DataFrame, pattern: str = PLACEHOLDER) -> DataFrame:
    """(src, dst) from (src, dst, line_no): blank translations and those that changed placeholders go, the last line wins."""
    ok = ~is_blank(F.col("dst")) & placeholders(F.col("src"), pattern).eqNullSafe(placeholders(F.col("dst"), pattern))
    return rows.where(F.col("src").isNotNull() & ok).groupBy("src").agg(F.max_by("dst", "line_no").alias("dst"))


def translate(segments: DataFrame, memory: DataFrame, text_col: str = "source") -> DataFrame:
    """segments with translation (the text itself where the memory has none) and is_hit."""
    m = memory.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    j = segments.join(m, F.col(text_col) == F.col("__src"), "left")
    return j.withColumn("translation", F.coalesce("__dst", text_col)).withColumn("is_hit", F.col("__src").isNotNull()).drop("__src", "__dst")


def misses(segments: DataFrame, memory: DataFrame, text_col: str = "source", order_col: str | None = None) -> DataFrame:
    """Texts the memory lacks, each once, with their first place if an order is given."""
    left = segments.where(~is_blank(F.col(text_col))).join(memory.select(F.col("src").alias("__src")), F.col(text_col) == F.col("__src"), "left_anti")
    g = left.groupBy(F.col(text_col).alias("src"))
    return g.agg(F.min(order_col).alias("first")) if order_col else g.agg(F.count("*").alias("segments"))


def cached(requests: DataFrame, cache: DataFrame, bypass: bool = False) -> DataFrame:
    """requests (translate_engine, translate_engine_params, original_text) with translation, null where it must be made."""
    keys = ["translate_engine", "translate_engine_params", "original_text"]
    if bypass:
        return requests.withColumn("translation", F.lit(None).cast("string"))
    return requests.join(cache.select(*keys, "translation"), keys, "left")


def bypasses(engine: Column) -> Column:
    """Whether an engine's answers are never kept: a handoff passes texts through, which must not be taken for translations."""
    return engine == "handoff"


def read_through(requests: DataFrame, cache: DataFrame, translate_: Callable[[DataFrame], DataFrame], bypass: bool = False) -> tuple[DataFrame, DataFrame]:
    """(requests with translation, the cache after them): what the cache lacks goes through translate_ once and is kept.

    translate_ adds a column translation to distinct keys (null: it failed, which is not kept). With bypass, or for engines
    that bypass, the cache is neither read nor written.
    """
    keys = ["translate_engine", "translate_engine_params", "original_text"]
    past = F.lit(bypass) | bypasses(F.col("translate_engine"))
    known = cache.select(*keys, F.col("translation").alias("__known")).where(~past)
    asked = requests.select(*keys).distinct()
    made = translate_(asked.join(known, keys, "left_anti")).select(*keys, "translation")
    answers = requests.join(known, keys, "left").join(made.select(*keys, F.col("translation").alias("__made")), keys, "left")
    answers = answers.withColumn("translation", F.coalesce("__known", "__made")).drop("__known", "__made")
    return answers, upsert(cache, made.where(~past & F.col("translation").isNotNull()), keys)


def chunk_order(rows: DataFrame, partition: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows numbered from 0 within a partition."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
