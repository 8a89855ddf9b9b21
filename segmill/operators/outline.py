"""Chapters of a book from its outline, and the outline of a book from its parts. Windows are by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUM, S, chapter_file, clean_title, title_of_stem

# Fixed values.
CHAPTER = rf"(?i)^({NUM}+{S}*[-–]{S}*|Chapter{S}+{NUM}+)"
INDEX = r"(?i)^Index([^\p{L}\p{N}_]|$)"
FRONT = "Front Matter"


def chapters(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, index, title, start_page, end_page, page_count, file) from (doc_id, ord, level, title, page) and (doc_id, total_pages).

    Chapters are entries of level 1 and 2 whose title is numbered or an index, within the document, the first of a page.
    Each ends before the next begins; pages before the first are the front matter. Documents without chapters give no rows.
    """
    c = outline.where(F.col("level").isin(1, 2)).withColumn("title", clean_title(F.col("title"))).where(F.col("title").rlike(CHAPTER) | F.col("title").rlike(INDEX))
    c = c.join(pages, "doc_id").where(F.col("page").between(1, F.col("total_pages")))
    c = c.groupBy("doc_id", F.col("page").alias("start_page"), "total_pages").agg(F.min_by("title", "ord").alias("title"))
    front = c.groupBy("doc_id", "total_pages").agg(F.min("start_page").alias("first")).where("first > 1").select("doc_id", F.lit(1).alias("start_page"), "total_pages", F.lit(FRONT).alias("title"))
    order = Window.partitionBy("doc_id").orderBy("start_page")
    r = c.unionByName(front).withColumn("index", F.row_number().over(order)).withColumn("end_page", F.greatest(F.coalesce(F.lead("start_page").over(order) - 1, "total_pages"), "start_page"))
    return r.select("doc_id", "index", "title", "start_page", "end_page", (F.col("end_page") - F.col("start_page") + 1).alias("page_count"), chapter_file(F.col("index"), F.col("title"), F.col("start_page"), F.col("end_page")).alias("file"))


def merged_outline(parts: DataFrame, outlines: DataFrame) -> DataFrame:
    """(book_id, idx, ord, level, title, page) from (book_id, idx, stem, page_count, exists) and (book_id, idx, ord, level, title, page).

    Parts that do not exist take no pages and no rows. Each part is an entry of level 1 at its first page, above its own.
    """
    before = Window.partitionBy("book_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    p = parts.where("exists").withColumn("offset", F.coalesce(F.sum("page_count").over(before), F.lit(0)) + 1)
    tops = p.select("book_id", "idx", F.lit(0).cast("long").alias("ord"), F.lit(1).alias("level"), title_of_stem(F.col("stem")).alias("title"), F.col("offset").alias("page"))
    subs = outlines.join(p.select("book_id", "idx", "offset"), ["book_id", "idx"]).select("book_id", "idx", F.col("ord").cast("long").alias("ord"), (F.col("level") + 1).alias("level"), "title", (F.col("page") + F.col("offset") - 1).alias("page"))
    return tops.unionByName(subs)


def interleaved(pages: DataFrame) -> DataFrame:
    """Order of a bilingual document: page n and then its translation, from (doc_id, pageno, is_translated)."""
    return pages.withColumn("position", F.col("pageno") * 2 + F.col("is_translated").cast("int"))


def batch(chapters_: DataFrame, done: DataFrame, first: int, last: int, group_col: str = "doc_id") -> DataFrame:
    """What a batch runs: the chapters of a range of ordinals without those done; after the first failure none.

    chapters_: (group, index, failed). A chapter runs if no earlier one of its group failed.
    """
    todo = chapters_.where(F.col("index").between(first, last)).join(done, [group_col, "index"], "left_anti")
    fail = Window.partitionBy(group_col)
    return todo.withColumn("first_failure", F.min(F.when(F.col("failed"), F.col("index"))).over(fail)).where("first_failure is null or index <= first_failure").drop("first_failure")
