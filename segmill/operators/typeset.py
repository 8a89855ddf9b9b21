"""Typesetting: how lines fit a box, and the drawing operations of a page as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading is taken back in steps down to a least; type shrinks to half at most; components of colour spaces;
# fonts, and where those of Vietnamese are looked for by weight, in that order.
LEADING_STEP, LEADING_LEAST, SHRINK_MOST = 0.05, 0.8, 0.5
COMPONENTS = {"CalGray": 1, "CalRGB": 3, "Lab": 3, "Separation": 1, "Indexed": 1, "Pattern": 1, "DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}
GENERAL_FONT = "GoNotoKurrent-Regular.ttf"
VIETNAMESE_FONTS = {
    "regular": ["/System/Library/Fonts/Supplemental/Times New Roman.ttf", "/Library/Fonts/Times New Roman.ttf", "C:/Windows/Fonts/times.ttf", "/usr/share/fonts/truetype/msttcorefonts/Times_New_Roman.ttf", "/usr/share/fonts/truetype/liberation/LiberationSerif-Regular.ttf"],
    "bold": ["/System/Library/Fonts/Supplemental/Times New Roman Bold.ttf", "/Library/Fonts/Times New Roman Bold.ttf", "C:/Windows/Fonts/timesbd.ttf", "/usr/share/fonts/truetype/msttcorefonts/Times_New_Roman_Bold.ttf", "/usr/share/fonts/truetype/liberation/LiberationSerif-Bold.ttf"],
    "italic": ["/System/Library/Fonts/Supplemental/Times New Roman Italic.ttf", "/Library/Fonts/Times New Roman Italic.ttf", "C:/Windows/Fonts/timesi.ttf", "/usr/share/fonts/truetype/msttcorefonts/Times_New_Roman_Italic.ttf", "/usr/share/fonts/truetype/liberation/LiberationSerif-Italic.ttf"],
    "bold italic": ["/System/Library/Fonts/Supplemental/Times New Roman Bold Italic.ttf", "/Library/Fonts/Times New Roman Bold Italic.ttf", "C:/Windows/Fonts/timesbi.ttf", "/usr/share/fonts/truetype/msttcorefonts/Times_New_Roman_Bold_Italic.ttf", "/usr/share/fonts/truetype/liberation/LiberationSerif-BoldItalic.ttf"],
}
SERIF_REGIONS = {"CN": ["zh-cn", "zh-hans", "zh"], "TW": ["zh-tw", "zh-hant"], "JP": ["ja"], "KR": ["ko"]}


def fitted_leading(lines: Column, size: Column, height: Column, leading: Column) -> Column:
    """The leading after it was taken back step by step while the lines are higher than the box and it is not below the least.

    There are as many steps as the leading asks for.
    """
    steps = F.greatest(F.lit(0.0), F.ceil((leading.cast("double") - LEADING_LEAST) / LEADING_STEP).cast("double")).cast("int") + 1
    too_high = lambda l: (lines * size * l > height) & (l >= LEADING_LEAST)
    return F.aggregate(F.sequence(F.lit(0), steps), leading.cast("double"), lambda l, _: F.when(too_high(l), l - LEADING_STEP).otherwise(l))


def fitted_size(lines: Column, size: Column, height: Column, leading: Column) -> Column:
    """The type size that lets more than one line fit at a fitted leading."""
    need = lines * size * leading
    return F.when((lines > 1) & (need > height), size * F.greatest(height / need, F.lit(SHRINK_MOST))).otherwise(size)


def text_op(font: Column, size: Column, x: Column, y: Column, codes: Column, color: Column) -> Column:
    return F.format_string("%s/%s %f Tf 1 0 0 1 %f %f Tm [<%s>] TJ ", color, font, size, x, y, codes)


def line_op(x: Column, y: Column, dx: Column, dy: Column, width: Column) -> Column:
    return F.format_string("ET q 1 0 0 1 %f %f cm [] 0 d 0 J %f w 0 0 m %f %f l S Q BT ", x, y, width, dx, dy)


def rectangle_op(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("q 1 1 1 rg %f %f %f %f re f Q ", x, y, w, h)


def resized(h: Column, w: Column, new_h: Column, new_w: Column, stride: int = 32) -> Column:
    """Sizes of an image that is scaled into a box and padded to a multiple of the stride: struct of h, w, top, bottom, left, right."""
    r = F.least(new_h / h, new_w / w)
    rh, rw = F.bround(h * r).cast("int"), F.bround(w * r).cast("int")
    pad_h, pad_w = F.pmod(new_h.cast("int") - rh, F.lit(stride)), F.pmod(new_w.cast("int") - rw, F.lit(stride))
    half = lambda x: F.floor(x / 2).cast("int")
    return F.struct(rh.alias("h"), rw.alias("w"), half(pad_h).alias("top"), (pad_h - half(pad_h)).alias("bottom"), half(pad_w).alias("left"), (pad_w - half(pad_w)).alias("right"))


def page_ops(ops: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each page from (keys, is_backing, para_id, seq, op): backing first, then the text object in order."""
    parts = F.array_sort(F.collect_list(F.struct("para_id", "seq", "op", "is_backing")))
    joined = lambda back: F.array_join(F.transform(F.filter("p", lambda x: x["is_backing"] == back), lambda x: x["op"]), "")
    return ops.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.concat(joined(True), F.lit("BT "), joined(False), F.lit("ET ")).alias("ops"))


def components(space: Column, declared: Column, names: Column) -> Column:
    """Components of a colour space: as declared for ICC profiles, by its names for DeviceN, else as predefined; null if unknown."""
    known = F.create_map(*(F.lit(x) for p in COMPONENTS.items() for x in p))
    return F.when((space == "ICCBased") & declared.isNotNull(), declared).when((space == "DeviceN") & names.isNotNull(), F.size(names)).otherwise(F.try_element_at(known, space))


def operands(stack: Column, n: Column) -> Column:
    """The last n of a stack, or one without a colour space; all if there are fewer."""
    k = F.coalesce(n, F.lit(1))
    return F.when(k >= F.size(stack), stack).when(k == 0, F.slice(stack, 1, 0)).otherwise(F.slice(stack, F.size(stack) - k + 1, k))


def font_file(language: Column) -> Column:
    """The font of a target language: a serif of its region for Chinese, Japanese and Korean, else the general one."""
    regions = F.create_map(*(F.lit(x) for r, langs in SERIF_REGIONS.items() for lang in langs for x in (lang, f"SourceHanSerif{r}-Regular.ttf")))
    return F.coalesce(F.try_element_at(regions, F.lower(language)), F.lit(GENERAL_FONT))


def weighted_fonts(language: Column, overrides: Column, present: Column) -> Column:
    """The fonts of a language by weight (map): for Vietnamese, the first present of an override and the usual places, for each weight.

    overrides: map of weight to path. Weights without a file are left out; what is left for the regular one is the language's own font.
    """
    found = []
    for weight, places in VIETNAMESE_FONTS.items():
        paths = F.concat(F.array(F.try_element_at(overrides, F.lit(weight))), F.array(*map(F.lit, places)))
        found.append(F.struct(F.lit(weight).alias("key"), F.when(F.lower(language) == "vi", first_present(paths, present)).alias("value")))
    fonts = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    regular = F.when(~F.exists(fonts, lambda x: x["key"] == "regular"), F.array(F.struct(F.lit("regular").alias("key"), font_file(language).alias("value"))))
    return F.map_from_entries(F.concat(fonts, F.coalesce(regular, F.slice(fonts, 1, 0))))


def first_present(candidates: Column, present: Column) -> Column:
    """The first of an array of paths that is among those present; null if none is."""
    return F.get(F.filter(candidates, lambda c: c.isNotNull() & F.array_contains(present, c)), 0)
