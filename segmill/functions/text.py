"""Scalar functions on texts, fonts, options and versions: Column to Column, no Python at run time unless said.

Patterns spell out Unicode classes, as \\s and \\d mean ASCII to Java and Unicode to the rules they stand for.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space around a text, as the inside of a character class.
WS = r"\x09-\x0d\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{WS}]"
#: The same as characters.
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NUM = r"\p{Nd}"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Fixed values.
PLACEHOLDER = r"</?b\d+>"
FORMULA_PLACEHOLDER = r"\{v\d+\}"
FORMULA_FONT = r"^(?:CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Sym|.*Math|.*Typewriter|Cousine|Consolas|Menlo|Monaco|Inconsolata|Source.?Code|Fira.?Code|DejaVu.?Sans.?Mono|Liberation.?Mono|Courier)"
FORMULA_CHARACTER = r"^[\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\x{370}-\x{3ff}]"
BOLD_SIZE = 13.5
BOLD_FONT = "bold|heavy|black|semibold|demi"
HEADING_FONT = "gotham|myriad|bold|semibold|demi|heavy|black"
BULLETS = "•■□▪▸▹►▶●○◆◇★☆‣⬤"
LINE_HEIGHTS = {"zh-cn": 1.4, "zh-tw": 1.4, "zh-hans": 1.4, "zh-hant": 1.4, "zh": 1.4, "ja": 1.1, "ko": 1.2, "en": 1.2, "ar": 1.0, "ru": 0.8, "uk": 0.8, "ta": 0.8, "vi": 1.2}
DEFAULT_LINE_HEIGHT = 1.1
FONT_FAMILIES = ("myriad", "garamond", "gotham", "helvetica", "times")
TARGET_LANGUAGES = "af ca cs cy da de en es et eu fi fr ga gl hr hu id is it lt lv ms mt nl no pl pt ro sk sl sq sv sw tl tr vi".split()
LANGUAGE_ALIASES = {"google": {"zh": "zh-CN"}}
PAGE_RANGES = r"^[1-9][0-9]*(-[1-9][0-9]*)?(,[1-9][0-9]*(-[1-9][0-9]*)?)*$"
SOURCE_LANGUAGE = r"^[A-Za-z]{2,3}(-[A-Za-z]{2,4})?$"


def utrim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return F.length(utrim(F.coalesce(c, F.lit("")))) == 0


def lines_of(c: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(c, LINE_ENDS, -1), utrim), lambda x: x != "")


def source_hash(c: Column) -> Column:
    """16 hex digits that tell a changed source text from an unchanged one."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def placeholders(c: Column, pattern: str = PLACEHOLDER) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def normalize_placeholders(c: Column) -> Column:
    """Placeholders that a service has spaced out, closed up again."""
    return F.regexp_replace(c, rf"<{S}*(/?){S}*b{S}*({NUM}+){S}*>", "<$1b$2>")


def strip_controls(c: Column) -> Column:
    """Without characters of the categories C: controls, line feeds, soft hyphens, joiners."""
    return F.regexp_replace(c, r"\p{C}", "")


def rich_placeholder(n: Column, closing: bool = False) -> Column:
    return F.concat(F.lit("</b" if closing else "<b"), n.cast("string"), F.lit(">"))


def formula_placeholder(n: Column) -> Column:
    return F.concat(rich_placeholder(n), rich_placeholder(n, True))


def _by_part(c: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of each text, some texts at a time: an Arrow batch of whole texts is large, and so are its Python strings."""
    parts = [pa.array([x if x is None else f(x) for x in c.slice(i, 256).to_pylist()], pa.string()) for i in range(0, len(c), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Unicode NFC; Spark has no function for it."""
    return _by_part(s, lambda x: unicodedata.normalize("NFC", x))


@F.arrow_udf(T.StringType())
def html_unescape(s: pa.Array) -> pa.Array:
    """HTML5 entities as characters; Spark has no function for it."""
    return _by_part(s, html.unescape)


def bare_font(c: Column) -> Column:
    """A font's name without the prefix of its subset."""
    return F.element_at(F.split(c, r"\+"), -1)


def is_formula_font(c: Column) -> Column:
    return c.rlike(FORMULA_FONT)


def is_formula_glyph(font: Column, text: Column, font_pattern: str | None = None, text_pattern: str | None = None) -> Column:
    """Whether a glyph belongs to a formula: undecoded, of a formula font, or a sign, modifier, mark, space or Greek letter."""
    by_font = bare_font(font).rlike(font_pattern or FORMULA_FONT)
    by_text = text.rlike(text_pattern) if text_pattern else text.rlike(FORMULA_CHARACTER) & (text != " ")
    return text.startswith("(cid:") | by_font | by_text


def is_bold(font: Column, size: Column) -> Column:
    return F.lower(font).rlike(BOLD_FONT) | (size >= BOLD_SIZE)


def is_italic(font: Column) -> Column:
    return F.lower(font).rlike("italic|oblique")


def is_heading_font(font: Column) -> Column:
    return F.lower(font).rlike(HEADING_FONT)


def font_family(font: Column) -> Column:
    """The first known family in the name, else the bare name up to a hyphen."""
    low = F.lower(font)
    out = F.element_at(F.split(bare_font(low), "-"), 1)
    for family in reversed(FONT_FAMILIES):
        out = F.when(low.contains(family), family).otherwise(out)
    return out


@lru_cache(maxsize=4096)
def font_traits(font: str) -> tuple[bool, bool, bool, bool, str]:
    """What a font's name tells, for folds in Python: formula, bold, italic, heading, family; as the columns of these names."""
    bare, low = font.split("+")[-1], font.lower()
    family = next((f for f in FONT_FAMILIES if f in low), low.split("+")[-1].split("-")[0])
    return re.search(FORMULA_FONT, bare) is not None, re.search(BOLD_FONT, low) is not None, re.search("italic|oblique", low) is not None, re.search(HEADING_FONT, low) is not None, family


def is_formula_text(text: Column) -> Column:
    """Whether a glyph's text alone makes it part of a formula."""
    return text.startswith("(cid:") | (text.rlike(FORMULA_CHARACTER) & (text != " "))


def color_op(color: Column) -> Column:
    """The fill operator for an array of 1, 3 or 4 components; black otherwise."""
    part = lambda i: F.format_string("%.4f", color[i])
    join = lambda n, op: F.concat_ws(" ", *(part(i) for i in range(n)), F.lit(op + " "))
    n = F.size(color)
    return F.when(n == 4, join(4, "k")).when(n == 3, join(3, "rg")).when(n == 1, join(1, "g")).otherwise("0 g ")


def line_height(language: Column) -> Column:
    known = F.create_map(*(F.lit(x) for p in LINE_HEIGHTS.items() for x in p))
    return F.coalesce(F.try_element_at(known, F.lower(language)), F.lit(DEFAULT_LINE_HEIGHT))


def is_bullet(c: Column) -> Column:
    return c.isin(*BULLETS)


def is_page_selection(c: Column) -> Column:
    """Whether a selection of one-based pages such as 1,3-5 is well formed, whatever the length of its numbers."""
    # numbers without leading zeros are in the order of their lengths, then of their digits
    pair = lambda x: F.transform(F.split(x, "-"), lambda y: F.struct(F.length(y), y))
    return F.when(c.rlike(PAGE_RANGES), F.forall(F.split(c, ","), lambda x: F.element_at(pair(x), 1) <= F.element_at(pair(x), -1))).otherwise(F.lit(False))


def page_indices(c: Column) -> Column:
    """Zero-based pages of a well-formed selection, in its order, repeats kept; null if it is malformed or a number is no int.

    For open-ended selections of large documents see in_selection, which lists no pages.
    """
    end = lambda x, i: F.element_at(F.split(x, "-"), i).try_cast("int") - 1
    pages = F.flatten(F.transform(F.split(c, ","), lambda x: F.sequence(end(x, 1), end(x, -1))))
    return F.when(is_page_selection(c), pages)


def in_selection(page: Column, c: Column) -> Column:
    """Whether a zero-based page is selected; a null or empty selection means all pages, a malformed one none."""
    n = (page.cast("long") + 1).cast("string")
    at = F.struct(F.length(n), n)
    pair = lambda x: F.transform(F.split(x, "-"), lambda y: F.struct(F.length(y), y))
    hit = F.exists(F.split(c, ","), lambda x: (F.element_at(pair(x), 1) <= at) & (at <= F.element_at(pair(x), -1)))
    return F.when(c.isNull() | (c == ""), True).otherwise(is_page_selection(c) & hit)


def is_source_language(c: Column) -> Column:
    return (c == "auto") | c.rlike(SOURCE_LANGUAGE)


def target_language(c: Column) -> Column:
    """The language in lower case if its script is supported, else null."""
    return F.when(F.lower(c).isin(*TARGET_LANGUAGES), F.lower(c))


def service_language(engine: str, c: Column) -> Column:
    out = F.lower(c)
    for k, v in LANGUAGE_ALIASES.get(engine, {}).items():
        out = F.when(F.lower(c) == k, v).otherwise(out)
    return out


def version_parts(c: Column) -> Column:
    """Numbers of a version tag, null if it has others or one of over 38 digits: v0.2.0-rc1 is 0, 2, 0."""
    core = F.element_at(F.split(F.element_at(F.split(F.regexp_replace(utrim(c), "^[vV]+", ""), "-", -1), 1), r"\+", -1), 1)
    parts = F.transform(F.split(core, r"\."), lambda x: x.try_cast("decimal(38,0)"))
    return F.when(core.rlike(r"^[0-9]+(\.[0-9]+)*$") & ~F.exists(parts, lambda x: x.isNull()), parts)


def is_newer(tag: Column, current: Column) -> Column:
    """Whether tag is a later version; false if either is malformed. Missing numbers are 0."""
    a, b = version_parts(tag), version_parts(current)
    pad = lambda x, y: F.concat(x, F.array_repeat(F.lit(0).cast("decimal(38,0)"), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    return F.coalesce(pad(a, b) > pad(b, a), F.lit(False))


def chapter_file(index: Column, title: Column, start: Column, end: Column) -> Column:
    safe = F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_\-.]", "_"), 1, 50)
    return F.concat(F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0")), F.lit("_"), safe, F.lit("_p"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(".pdf"))


def clean_title(c: Column) -> Column:
    return F.translate(utrim(c), "\r\n", "  ")


def title_of_stem(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def max_tokens(c: Column) -> Column:
    return F.least(F.length(c) * 4, F.lit(4096))


def truncated(c: Column, limit: int = 5000) -> Column:
    return F.substring(c, 1, limit)


def retry_wait(attempt: Column, most: float = 15) -> Column:
    """Seconds before the next try of a segment within a run."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def call_wait(attempt: Column, least: float = 1, most: float = 60) -> Column:
    """Seconds after the n-th failed call of a service (from 1): doubled each time."""
    return F.least(F.greatest(F.pow(F.lit(2.0), attempt - 1), F.lit(float(least))), F.lit(float(most)))


def progress(done: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """Segments a second (0 before any time has passed) and the seconds left (null without a rate)."""
    rate = F.coalesce(F.try_divide(done.cast("double"), elapsed.cast("double")), F.lit(0.0))
    return rate, F.try_divide((total - done).cast("double"), rate)


def glyph_hex(c: Column, wide: Column) -> Column:
    """Hex of each character's code: four digits for wide fonts, two otherwise."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.lower(F.hex(F.ascii(x))))
    pad = lambda n: F.array_join(F.transform(codes, lambda h: F.lpad(h, F.greatest(F.lit(n), F.length(h)), F.lit("0"))), "")
    return F.when(wide, pad(4)).otherwise(pad(2))


def canonical_params(params: Column) -> Column:
    """A map<string,string> as JSON whose keys are sorted: the name of a cache's space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def canonical_json(c: Column) -> Column:
    """JSON text without spaces, the keys of all its objects sorted; null if it is no JSON or an object repeats a key.

    The fields of a variant's objects are kept in the order of their names, at every depth.
    """
    return F.to_json(F.try_parse_json(c))


def merged_params(params: Column, more: Column) -> Column:
    """Parameters with others added or replaced, as canonical JSON."""
    kept = F.map_filter(params, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return canonical_params(F.map_concat(kept, more))


def valid_threads(c: Column) -> Column:
    """Whether a text is a number of threads, 1 to 8."""
    return F.coalesce(c.rlike("^[0-9]+$") & c.try_cast("int").between(1, 8), F.lit(False))


def option_problem(engine: Column, output: Column, segments: Column, emit: Column) -> Column:
    """What is wrong with the options of a run (null: not given), or null: the first of the checks that fails."""
    both = segments.isNull() & emit.isNull()
    return (
        F.when(output.isNull() & emit.isNull(), "an output directory is needed unless segments are emitted")
        .when((engine == "handoff") & both, "handoff needs segments, a path to emit them to, or both")
        .when((engine != "handoff") & ~both, "segments are for handoff only")
    )


def minutes(seconds: Column) -> Column:
    """Seconds as minutes and seconds: 2m 05.0s."""
    return F.format_string("%dm %04.1fs", F.floor(seconds / 60).cast("long"), F.pmod(seconds.cast("double"), F.lit(60.0)))


def stage_line(name: Column, seconds: Column, total: Column, note: Column) -> Column:
    """A line of a run's summary: name, seconds, share of the total in per cent, note."""
    share = F.coalesce(F.try_divide(seconds * 100.0, total), F.lit(0.0))
    return F.format_string("%s: %.2fs (%.1f%%) [%s]", name, seconds.cast("double"), share, note)
