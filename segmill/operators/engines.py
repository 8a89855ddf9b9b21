"""Translation engines: functions of a text that live outside, and how a table of texts is taken through them.

Each distinct text is translated once. A text whose calls all fail keeps its place with the reasons, and fails no task.
Calls may be made again if a task is; results are to be written before segments are marked.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, max_tokens, normalize_placeholders, strip_controls, utrim

Endpoint = Callable[[str], str]
ENGINES: dict[str, list[Endpoint]] = {}
DEFAULT_PROMPT = "Translate the text into {language}. Keep placeholders, numbers and markup as they are."


def register(name: str, *endpoints: Endpoint) -> None:
    """An engine: endpoints that are tried in order until one gives a text."""
    ENGINES[name] = list(endpoints)


class Limiter:
    """At least `interval` seconds from one call to the next."""

    def __init__(self, interval: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            self.sleep(self.interval - (now - self.last))
        self.last = self.clock()


def first_answer(text: str, endpoints: list[Endpoint]) -> tuple[str | None, str | None]:
    """The first endpoint's answer that is not empty, or the reasons of all."""
    if not text.strip():
        return text, None
    reasons = []
    for e in endpoints:
        try:
            if out := e(text):
                return out, None
            reasons.append(f"{e.__name__}: empty")
        except Exception as x:  # noqa: BLE001  any failure of a service is the segment's, not the job's
            reasons.append(f"{e.__name__}: {x}")
    return None, "; ".join(reasons)


def translate_all(segments: DataFrame, endpoints: list[Endpoint], text_col: str = "source", interval: float = 0.0, parallel: int | None = None) -> DataFrame:
    """segments with translation and error; blank texts pass as they are. interval is for all tasks together, if parallel tells their number."""
    texts = segments.select(F.col(text_col).alias("__text")).where(~is_blank(F.col(text_col))).distinct()
    texts = texts.repartition(parallel) if parallel else texts

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = Limiter(interval * (parallel or 1))
        for pdf in parts:
            rows = []
            for text in pdf["__text"]:
                if interval:
                    limiter.wait()
                rows.append((text, *first_answer(text, endpoints)))
            yield pd.DataFrame(rows, columns=["__text", "__out", "__error"])

    done = texts.mapInPandas(run, "__text string, __out string, __error string")
    j = segments.join(done, F.col(text_col) == F.col("__text"), "left")
    out = F.when(is_blank(F.col(text_col)), F.col(text_col)).otherwise(strip_controls(normalize_placeholders(F.col("__out"))))
    return j.withColumn("translation", out).withColumn("error", F.col("__error")).drop("__text", "__out", "__error")


def fallback(answers: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Of columns of struct(value, error) by endpoint: the first value that is not empty, else the reasons joined."""
    value = F.coalesce(*(F.when(c["value"] != "", c["value"]) for _, c in answers))
    reasons = F.concat_ws("; ", *(F.concat(F.lit(f"{n}: "), F.coalesce(c["error"], F.lit("empty"))) for n, c in answers))
    return value, F.when(value.isNull(), reasons)


def sentence_list(body: Column) -> Column:
    """Text of the JSON answer [[[text, …], …], …]: the first elements of the first list, joined."""
    rows = F.from_json(F.get_json_object(body, "$[0]"), "array<string>")
    return F.array_join(F.transform(rows, lambda r: F.get_json_object(r, "$[0]")), "")


def loose_list(body: Column) -> Column:
    """Text of an answer that is a text, a list of texts, or a list of lists whose first elements are texts."""
    rows = F.from_json(body, "array<string>")
    one = F.transform(rows, lambda r: F.coalesce(F.when(r.startswith("["), F.get_json_object(r, "$[0]")), r))
    return F.when(body.startswith("["), F.array_join(one, "")).otherwise(F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x"))


def scraped(page: Column) -> Column:
    """Text of an answer in HTML: the inside of the result's element."""
    return F.regexp_extract(page, r'(?s)class="(?:t0|result-container)">(.*?)<', 1)


def chat_request(text: Column, system: Column, glossary: Column, model: str, temperature: float = 0.3) -> Column:
    """A chat model's request as a struct: system prompt with the glossary, the text, and a limit of tokens."""
    prompt = F.when(F.coalesce(glossary, F.lit("")) != "", F.concat(system, F.lit("\n\n"), glossary)).otherwise(system)
    return F.struct(F.lit(model).alias("model"), prompt.alias("system"), text.alias("user"), F.lit(temperature).alias("temperature"), max_tokens(text).alias("max_tokens"))


def chat_answer(content: Column) -> tuple[Column, Column]:
    """A chat model's answer, trimmed and without controls, and an error if it is empty."""
    out = strip_controls(utrim(F.coalesce(content, F.lit(""))))
    return F.when(out != "", out), F.when(out == "", "empty response")


def engine_options(defaults: dict[str, str], environment: dict[str, str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Options of an engine: overrides before the environment before defaults; empty values count as absent."""
    out = dict(defaults)
    for more in (environment, overrides or {}):
        out |= {k: v for k, v in more.items() if v}
    return out


def described(error: BaseException) -> str:
    """An error and what led to it, in one line, the outermost first; an error that comes again ends the line."""
    names, known = [], set()
    while error is not None and id(error) not in known:
        known.add(id(error))
        names.append(type(error).__name__ + (f": {text}" if (text := str(error).strip()) else ""))
        error = error.__cause__ or error.__context__
    return " <- ".join(names)


def tagged(text: str) -> str:
    """A stand-in for a service: fails on texts with figures, answers nothing to others with quotes."""
    if any(c in "0123456789" for c in text):
        raise ValueError("figures")
    return "" if '"' in text else f"[1] {text}"


def reversed_words(text: str) -> str:
    """A stand-in for a second service."""
    if "%" in text:
        raise ValueError("per cent")
    return " ".join(reversed(text.split(" ")))
