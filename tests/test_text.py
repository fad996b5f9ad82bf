import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.functions import text as T


def python_splitlines(column):
    """The measure for ``lines``."""
    import pandas as pd

    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else t.splitlines())

    return F.pandas_udf(split, "array<string>")(column)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first().r


FIVE = "one\ntwo\nthree\nfour\nfive\n"


@pytest.mark.parametrize(("a", "b", "want"), [(2, 3, "two\nthree"), (-4, 1, "one"), (4, 99, "four\nfive"), (9, 12, ""), (3, 3, "three")])
def test_line_slices(spark, a, b, want):
    assert one(spark, FIVE, lambda c: T.line_slice(c, a, b)) == want


def test_byte_slices(spark):
    data = bytearray("Hello 世界".encode())
    assert one(spark, data, lambda c: T.byte_slice(c, 0, 6), "binary") == "Hello "
    assert one(spark, data, lambda c: T.byte_slice(c, -5, 99), "binary") == "Hello 世界"
    assert one(spark, data, lambda c: T.byte_slice(c, 6, 8, strict=False), "binary") is None
    with pytest.raises(Exception, match="UTF"):
        one(spark, data, lambda c: T.byte_slice(c, 6, 8), "binary")


def test_ranges_are_checked():
    with pytest.raises(ValueError):
        T.check_range(3, 2)
    T.check_range(2, 2)
    with pytest.raises(ValueError):
        T.check_range(2, 2, strict=True)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x85  é", max_size=12), min_size=20, max_size=20))
def test_lines_equal_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.lines(F.col("t")).alias("ours"), python_splitlines("t").alias("theirs")).collect():
        assert r.ours == r.theirs, repr(r.t)


@pytest.mark.parametrize(("raw", "clean"), [("/* a */", "a"), ("// b", "b"), ("/**\n * c\n *d\n */", "c\nd"), ("plain", "plain")])
def test_comments(spark, raw, clean):
    assert one(spark, raw, T.clean_comment).strip("*").strip() == clean


@pytest.mark.parametrize(("raw", "clean"), [('"""a"""', "a"), ("'b'", "b"), ('r"c"', 'r"c"'), ('" d "', "d")])
def test_docstrings(spark, raw, clean):
    assert one(spark, raw, T.clean_docstring) == clean
