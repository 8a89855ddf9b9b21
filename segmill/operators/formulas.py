"""Formulas back in translated texts: their text, their backing, and the runs of one font that a text is drawn in."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paragraphs import _TOKEN, wrap, wrapped

# Fixed value: a placeholder, spaced out or not, as services return them.
TOKEN = r"(?i)\{\s*v([\d\s]+)\}"


_WHOLE = re.compile(r"\{\s*v[\d\s]+\}", re.I)


def fill(paragraphs: DataFrame, formulas: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """paragraphs with each placeholder of text_col replaced by the formula (keys, vid, text) of its number; unknown ones go.

    One join by page: the formulas of a page are a map. Null texts stay null.
    """
    of = formulas.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("vid").cast("long"), F.col("text")))).alias("__of"))
    t = F.col(text_col)
    around, numbers = F.split(t, TOKEN, -1), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))
    known = lambda n: F.coalesce(F.try_element_at("__of", F.regexp_replace(n, r"\s", "").try_cast("long")), F.lit(""))
    inner = F.transform(numbers, known)
    filled = F.array_join(F.zip_with(around, inner, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return paragraphs.join(of, keys, "left").withColumn(text_col, F.when(F.contains(t, F.lit("{")), filled).otherwise(t)).drop("__of")


def backing(glyphs: DataFrame, pad: float = 3.0) -> DataFrame:
    """White rectangles behind the formulas (page_id, vid) of scanned pages: (page_id, vid, left, bottom, w, h)."""
    g = glyphs.where("is_scanned").groupBy("page_id", "vid").agg(F.min("x0").alias("l"), F.min("y0").alias("b"), F.max("x1").alias("r"), F.max("y1").alias("t"))
    return g.select("page_id", "vid", (F.col("l") - pad).alias("left"), (F.col("b") - pad).alias("bottom"), (F.col("r") - F.col("l") + 2 * pad).alias("w"), (F.col("t") - F.col("b") + 2 * pad).alias("h"))


def runs_of(text: str, x: float, x0: float, x1: float, size: float, font_of, width, formulas: dict[int, tuple[float, float]]) -> Iterator[tuple]:
    """(line, x, font, text, vid) of the runs of a text: one font, on one line, no formula within; vid is set for formulas.

    Lines are those of wrap; a line without spaces that passes the right edge goes on below, if the text has spaces at all.
    Spaces at the left edge are left out. formulas: width and overhang of each, the next run begins that much earlier.
    """

    def number_of(tok: str) -> int | None:
        digits = "".join(c for c in tok if c.isdigit()) if len(tok) > 1 else ""
        return int(digits) if digits else None

    measure = lambda tok: (formulas.get(number_of(tok), (0.0, 0.0))[0] / size) if len(tok) > 1 else width(tok)
    edge, line = x1 + 0.1 * size, -1
    for k, whole in enumerate(wrap(text, measure, x, x0, x1, size)):
        tokens = [t for t in _TOKEN.findall(whole) if len(t) == 1 or number_of(t) in formulas]
        left = x if k == 0 else x0
        while True:
            line += 1
            lead = 0
            while left == x0 and lead < len(tokens) and tokens[lead] == " ":
                lead += 1
            tokens = tokens[lead:]
            steps = np.array([formulas[number_of(t)][0] - formulas[number_of(t)][1] if len(t) > 1 else width(t) * size for t in tokens])
            at = left + np.concatenate([[0.0], np.cumsum(steps)])
            over = np.flatnonzero(at[:-1] + np.array([formulas[number_of(t)][0] if len(t) > 1 else s for t, s in zip(tokens, steps, strict=True)]) > edge) if x1 > x0 and " " in text.strip() else []
            cut = max(int(over[0]), 1) if len(over) else len(tokens)
            fonts = [None if len(t) > 1 else font_of(t) for t in tokens[:cut]]
            start = 0
            for i in range(1, cut + 1):
                if start < cut and (i == cut or fonts[i] != fonts[start] or fonts[start] is None):
                    vid = number_of(tokens[start]) if fonts[start] is None else None
                    yield line, float(at[start]), fonts[start], None if vid is not None else "".join(tokens[start:i]), vid
                    start = i
            if cut >= len(tokens):
                break
            tokens, left = tokens[cut:], x0


class _Chars:
    """Widths, in parts of the size, and fonts, by number, of characters: tables that grow with the code points met."""

    def __init__(self, fonts: dict[str, int], default: int, widths: dict[str, float], other: float):
        self.fonts, self.default, self.widths, self.other = fonts, default, widths, other
        self.width, self.font = np.empty(0), np.empty(0, np.int64)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = int(codes.max(initial=0))
        if most >= len(self.width):
            new = [chr(i) for i in range(len(self.width), max(most + 1, 256))]
            self.width = np.append(self.width, [self.widths.get(c, self.other) for c in new])
            self.font = np.append(self.font, [self.fonts.get(c, self.default) for c in new])
        return self.width[codes], self.font[codes]


def _runs(text: str, x: float, x0: float, x1: float, size: float, chars: _Chars, formulas: dict[int, tuple[float, float]]) -> tuple[list, list, list, list, list]:
    """Lines, xs, numbers of fonts (-1: formula), texts and vids of the runs of runs_of: a token is a place in arrays of its text."""
    begins_token = np.ones(len(text), bool)
    if "{" in text:
        for m in _WHOLE.finditer(text):
            begins_token[m.start() + 1 : m.end()] = False
    start = np.flatnonzero(begins_token)
    end = np.append(start[1:], len(text)) if len(start) else start
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_space = codes[start] == 32
    width, font = chars.of(codes[start])
    wide = np.flatnonzero(end - start > 1)
    digits = {int(i): "".join(c for c in text[start[i] : end[i]] if c.isdigit()) for i in wide}
    vids = {i: int(d) if d else None for i, d in digits.items()}  # without a number: of no formula
    measure, step, grow, kept = width * size, width * size, width * size, np.ones(len(start), bool)
    font = font.copy()
    for i, vid in vids.items():
        w, over = formulas.get(vid, (0.0, 0.0))
        measure[i], step[i], grow[i], font[i], kept[i] = w / size * size, w - over, w, -1, vid in formulas
    fold, edge, line = x1 > x0 and " " in text.strip(), x1 + 0.1 * size, -1
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    full, blank, steps = bool(kept.all()), is_space.tolist(), step.tolist()
    # most lines keep within the edge; their runs are found from what is known of the whole text
    plain, most = full and bool((step >= 0).all()), float((grow - step).max(initial=0.0)) + 1e-6
    change = (np.flatnonzero((font[1:] != font[:-1]) | (font[1:] < 0)) + 1).tolist()
    numbers, first, last = font.tolist(), start.tolist(), end.tolist()
    for k, (s, e) in enumerate(wrapped(measure, is_space, x, x0, x1, size)):
        left = x if k == 0 else x0
        lead = s
        while left == x0 and lead < e and blank[lead]:
            lead += 1
        sums = list(accumulate(steps[lead:e], initial=0.0))
        if plain and (not fold or left + sums[-1] + most <= edge):
            line += 1
            if lead < e:
                bounds = [lead, *change[bisect_right(change, lead) : bisect_left(change, e)], e]
                for i, j in pairwise(bounds):
                    g = numbers[i]
                    out[0].append(line)
                    out[1].append(left + sums[i - lead])
                    out[2].append(g)
                    out[3].append(text[first[i] : last[j - 1]] if g >= 0 else None)
                    out[4].append(vids[i] if g < 0 else None)
            continue
        ids = np.arange(s, e) if full else s + np.flatnonzero(kept[s:e])
        while True:
            line += 1
            if left == x0 and len(ids) and is_space[ids[0]]:
                ink = np.flatnonzero(~is_space[ids])
                ids = ids[ink[0] if len(ink) else len(ids) :]
            at = left + np.concatenate([[0.0], np.cumsum(step[ids])])
            cut = len(ids)
            if fold:
                over = at[:-1] + grow[ids] > edge
                if over.any():
                    cut = max(int(over.argmax()), 1)
            if cut:
                f = font[ids[:cut]]
                begins = np.concatenate([[0], np.flatnonzero((f[1:] != f[:-1]) | (f[1:] < 0)) + 1])
                ends = [*begins[1:].tolist(), cut]
                for b, stop, g in zip(begins.tolist(), ends, f[begins].tolist(), strict=True):
                    i, j = ids[b], ids[stop - 1]
                    out[0].append(line)
                    out[1].append(float(at[b]))
                    out[2].append(g)
                    # tokens that are left out stand between others
                    out[3].append(None if g < 0 else text[start[i] : end[j]] if full or j - i == stop - 1 - b else "".join(text[start[q] : end[q]] for q in ids[b:stop]))
                    out[4].append(vids[int(i)] if g < 0 else None)
            if cut >= len(ids):
                break
            ids, left = ids[cut:], x0
    return out


def font_runs(paragraphs: DataFrame, formulas: DataFrame, fonts: dict[str, str], default: str, widths: dict[str, float], other: float = 0.5) -> DataFrame:
    """(para_id, seq, line, x, font, text, vid) of paragraphs (para_id, page_id, text, x, x0, x1, size) and formulas (page_id, vid, width, overhang).

    fonts: characters that a font has, by font; the first font that has a character draws it, else the default. Placeholders
    without a formula go. Null texts have no runs.
    """
    first = {}
    for name, chars in fonts.items():
        for c in chars:
            first.setdefault(c, name)

    names = list(dict.fromkeys([*fonts, default]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.int64()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = _Chars({c: names.index(f) for c, f in first.items()}, names.index(default), widths, other)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                out = [[] for _ in kinds]
                for para, text, x, x0, x1, size, known in zip(*(c.to_pylist() for c in part.slice(at, 256).columns), strict=True):
                    of = {f["vid"]: (f["width"], f["overhang"]) for f in known or []}
                    columns = _runs(text or "", x, x0, x1, size, chars, of)
                    n = len(columns[0])
                    columns = ([para] * n, range(n), columns[0], columns[1], [names[f] if f >= 0 else None for f in columns[2]], *columns[3:])
                    for o, c in zip(out, columns, strict=True):
                        o.extend(c)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["para_id", "seq", "line", "x", "font", "text", "vid"])

    of = formulas.groupBy("page_id").agg(F.collect_list(F.struct(F.col("vid").cast("long").alias("vid"), F.col("width").cast("double").alias("width"), F.col("overhang").cast("double").alias("overhang"))).alias("known"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "x0", "x1", "size")]
    j = paragraphs.join(of, "page_id", "left").select(F.col("para_id").cast("long").alias("para_id"), "text", *numbers, "known")
    return j.mapInArrow(run, "para_id long, seq int, line int, x double, font string, text string, vid long")
