"""Profiles: directories of a prompt and a glossary, read through Spark so that any store will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jsonl import files, glossary_rows, numbered_lines

PROMPT, GLOSSARY = "system_prompt.txt", "glossary_base.jsonl"
DEFAULT_PROMPT = "Translate the text into {language}. Keep placeholders, numbers and markup as they are."


def available(spark: SparkSession, base: str) -> DataFrame:
    """(name, has_prompt, has_glossary) of each directory below base with a file that is not empty; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.split("path", "/").alias("p"))
    rows = files.select(F.element_at("p", -2).alias("name"), F.element_at("p", -1).alias("file")).where(~F.col("name").startswith("."))
    return rows.groupBy("name").agg(F.bool_or(F.col("file") == PROMPT).alias("has_prompt"), F.bool_or(F.col("file") == GLOSSARY).alias("has_glossary"))


def resolve(name: str, found: list[str], base: str, root: str) -> str | None:
    """The first of base/name, name and root/name that is among the directories found; None without a name."""
    return next((c for c in (f"{base}/{name}", name, f"{root}/{name}") if c in found), None) if name else None


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a profile's glossary."""
    return glossary_rows(numbered_lines(spark, f"{path}/{GLOSSARY}"))


def prompt(spark: SparkSession, path: str | None, language: str) -> str:
    """The prompt of a profile, or the default; the file is one short text."""
    if not path:
        return DEFAULT_PROMPT.format(language=language)
    return spark.read.text(f"{path}/{PROMPT}", wholetext=True).first().value


def assets(found: DataFrame, name: str, system_prompt: str | None = None, glossary_: str | None = None, base: str = "") -> dict[str, str | None]:
    """The prompt and the glossary of a run: what is given explicitly, else the file of the profile (a row of available), else None."""
    row = found.where(F.col("name") == name).first() if name else None
    own = lambda has, file: f"{base}/{name}/{file}" if row is not None and row[has] else None
    return {"system_prompt": system_prompt or own("has_prompt", PROMPT), "glossary": glossary_ or own("has_glossary", GLOSSARY)}


def chapter_files(spark: SparkSession, path: str, done_suffix: str = "-vi.pdf") -> DataFrame:
    """(name, path, n from 1) of the chapters of a directory in the order of their names, without the results beside them."""
    f = files(spark, path, "*.pdf").where(~F.col("name").endswith(done_suffix))
    return f.select("name", "path", F.row_number().over(Window.orderBy("name")).alias("n"))  # the files of one directory
