import pytest
from pyspark.sql import functions as F

from segmill.functions import text as t


def values(spark, f, *rows):
    """f over rows of one value or tuples of them, as a list."""
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    names = [f"c{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, ["i", *names])
    return [r.v for r in df.select("i", f(*(F.col(n) for n in names)).alias("v")).orderBy("i").collect()]


def test_trim_and_lines(spark):
    assert values(spark, t.utrim, "  a b\t\n", "\x1cx\x85", "　", "") == ["a b", "x", "", ""]
    assert values(spark, t.lines_of, "a\r\n\n b\x0bc d\x85", "") == [["a", "b", "c", "d"], []]


def test_placeholders(spark):
    got = values(spark, t.normalize_placeholders, "< b 1 >x< / b 1 >", "<b2></b2>", "< c 1>", "< b\t10>")
    assert got == ["<b1>x</b1>", "<b2></b2>", "< c 1>", "<b10>"]
    assert values(spark, t.placeholders, "a<b0>x</b0><b12>") == [["<b0>", "</b0>", "<b12>"]]
    assert values(spark, t.strip_controls, "a\n\t­b‍😀") == ["ab😀"]
    assert values(spark, t.formula_placeholder, 3) == ["<b3></b3>"]


def test_python_functions(spark):
    assert values(spark, t.nfc, "é", None) == ["é", None]
    assert values(spark, t.html_unescape, "&amp;&eacute;&#39;", None) == ["&é'", None]


def test_hash_and_length(spark):
    assert values(spark, t.source_hash, "Hello") == ["185f8db32271fe25"]
    assert values(spark, t.max_tokens, "ab", "x" * 5000) == [8, 4096]


@pytest.mark.parametrize(("spec", "want"), [("1,3-5", [0, 2, 3, 4]), ("5-3", None), ("0", None), ("2,2", [1, 1]), ("1,", None), ("a", None)])
def test_pages(spark, spec, want):
    assert values(spark, t.page_indices, spec) == [want]
    assert values(spark, t.is_page_selection, spec) == [want is not None]


def test_languages(spark):
    assert values(spark, t.target_language, "FR", "zh", "ja", "ko", "ar", "he", "th", "hi", "vi") == ["fr", None, None, None, None, None, None, None, "vi"]
    assert values(spark, t.is_source_language, "auto", "zh-CN", "e", "english") == [True, True, False, False]
    assert values(spark, t.line_height, "ZH-tw", "vi", "xx") == [1.4, 1.2, 1.1]
    assert values(spark, lambda c: t.service_language("google", c), "zh", "VI") == ["zh-CN", "vi"]


def test_versions(spark):
    newer = [("0.10.0", "0.9.0", True), ("0.2", "0.2.0", False), ("v0.2.0-rc1", "0.1.9", True), ("V1.0+x", "0.9", True), ("nightly", "0", False), ("", "0", False), ("v", "0", False), ("1.x", "0", False), ("0.9", "0.10", False)]
    assert values(spark, t.is_newer, *((a, b) for a, b, _ in newer)) == [w for *_, w in newer]


def test_fonts(spark):
    names = ["CMMI10", "CMR10", "ABC+CMSY7", "FiraCode-Regular", "Some-Mono", "xCMMI", "Times"]
    assert values(spark, lambda c: t.is_formula_font(t.bare_font(c)), *names) == [True, False, True, True, True, False, False]
    assert values(spark, t.is_formula_glyph, ("Times", "α"), ("Times", " "), ("Times", "(cid:4)"), ("Times", "x"), ("Times", " "), ("Q+MT", "x")) == [True, False, True, False, True, True]
    assert values(spark, t.font_family, "ABC+MyriadPro", "X+Roboto-Bold", "Times") == ["myriad", "roboto", "times"]
    assert values(spark, t.is_bold, ("Semibold", 9.0), ("x", 13.5), ("x", 9.0)) == [True, True, False]
    assert values(spark, t.color_op, [1.0], [0.25, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0], [1.0, 1.0]) == ["1.0000 g ", "0.2500 0.0000 1.0000 rg ", "0.0000 0.0000 0.0000 1.0000 k ", "0 g "]


def test_files_and_codes(spark):
    assert values(spark, lambda c: t.chapter_file(F.lit(3), c, F.lit(1), F.lit(9)), "Giải phẫu (A) – 1") == ["03_Giải_phẫu__A____1_p1-9.pdf"]
    assert values(spark, lambda c: t.glyph_hex(c, F.lit(True)), "aé") == ["006100e9"]
    assert values(spark, lambda m: t.canonical_params(m), {"b": "1", "a": "2"}) == ['{"a":"2","b":"1"}']


def test_progress(spark):
    rate, eta = t.progress(F.col("d"), F.col("n"), F.col("s"))
    df = spark.createDataFrame([(5, 10, 2.0), (0, 10, 0.0)], "d int, n int, s double")
    assert [tuple(r) for r in df.select(rate, eta).collect()] == [(2.5, 2.0), (0.0, None)]
    assert values(spark, t.retry_wait, 0, 3, 9) == [1.0, 8.0, 15.0]
