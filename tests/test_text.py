import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import text as tx

PIECES = ["a", "B", " ", "\t", "\n", "\n\n", "\r\n", " ", " ", "\x1c", "\x0b", "É", "'", "-", "x1", '"', "."]


def _column(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_white_space_is_pythons(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=20, max_size=60))
    def check(texts):
        assert _column(spark, texts, tx.squeeze) == [" ".join(t.split()) for t in texts]
        assert _column(spark, texts, tx.tokens) == [t.split() for t in texts]
        assert _column(spark, texts, tx.strip) == [t.strip() for t in texts]

    check()


def test_match_tokens_and_phrases(spark):
    texts = ["It's  V2.0, (really)!", "...", "", None]
    assert _column(spark, texts, tx.match_tokens) == [["its", "v20", "really"], [], [], []]
    assert _column(spark, ['say " Foo  Bar " or "" or "x"', None], tx.quoted_phrases) == [["foo  bar", "or"], []]
    assert _column(spark, ["a\r\n\r\nb c\n \n\n d", " \n ", None], tx.paragraphs) == [["a", "b c", "d"], [], []]


def test_code_and_digits(spark):
    words = ["a_b", "c.d", "x-1y", "a-b", "plain", "3rd", "::"]
    assert _column(spark, words, lambda c: tx.has_code(F.array(c))) == [True, True, True, False, False, True, True]


def test_page_numbers(spark):
    import pytest

    assert _column(spark, [" 7 ", "0012"], tx.page_number) == [7, 12]
    for bad in ("x", "-3", "1.5", None):
        with pytest.raises(Exception, match="not a page id"):
            _column(spark, [bad], tx.page_number)


def test_titled(spark):
    rows = spark.createDataFrame([("t", "b"), ("", "b"), ("t", ""), (None, None)], "t string, b string")
    assert [r[0] for r in rows.select(tx.titled(F.col("t"), F.col("b"))).collect()] == ["t\n\nb", "b", "t", ""]


def test_first_tokens(spark):
    texts = [" a  b\n\tc d", "a b", " x ", "", None, "\x1c one　two three four"]
    assert _column(spark, texts, lambda c: tx.first_tokens(c, 3)) == [["a", "b", "c"], ["a", "b"], ["x"], [], [], ["one", "two", "three"]]


def test_squeezing_and_paragraphs_of_odd_white_space(spark):
    """What is white space to Python is white space here; a single space is none to replace."""
    space = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    texts = [f"a{x}b{x}{y} c {x}" for x in space for y in (" ", "\n", "　")] + [space, "", " a  b ", "\r\n\r\n a\r\rb \n \n\nc\n", "é à"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.squeeze(F.col("t")).alias("s"), tx.paragraphs(F.col("t")).alias("p")).collect()
    for r in rows:
        assert r["s"] == " ".join(r["t"].split())
        unix = r["t"].replace("\r\n", "\n").replace("\r", "\n").strip()
        assert r["p"] == [x for x in (" ".join(p.split()) for p in re.split(r"\n\s*\n+", unix)) if x]
