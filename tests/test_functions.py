import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from colonnade.functions import expressions as E
from colonnade.functions import unicode
from colonnade.functions.catalog import FUNCTIONS
from colonnade.functions.registry import arguments, call, expression, names

BIG = 2**63 - 1
NAN, INF = float("nan"), float("inf")


def column(df, c):
    return df.orderBy("pos").select(c.alias("v")).toArrow()["v"].to_pylist()


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(BIG, 1), (-BIG - 1, -1), (5, 0), (None, 3), (7, None), (-7, 2), (7, -2), (BIG, BIG)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "pos int, i long, j long")


@pytest.mark.parametrize("name", ["add", "subtract", "multiply"])
def test_integers_wrap_as_arrow_does(pairs, name):
    t = pairs.orderBy("pos").toArrow()
    assert column(pairs, call(name)) == getattr(pc, name)(t["i"], t["j"]).to_pylist()
    assert column(pairs, getattr(E, name)(F.col("i"), F.col("j"))) == column(pairs, call(name))


def test_division(pairs):
    assert column(pairs, call("divide")) == [BIG, -BIG - 1, 0, None, None, -3, -3, 1]
    assert column(pairs, E.divide_int(F.col("i"), F.col("j"))) == column(pairs, call("divide"))
    assert column(pairs, call("modulo")) == [0, 0, None, None, None, 1, -1, 0]


@pytest.mark.parametrize("name,row", [("add_checked", 0), ("multiply_checked", 7), ("divide_checked", 2), ("subtract_checked", 1), ("negate_checked", 1), ("abs_checked", 1)])
def test_checked_functions_raise(pairs, name, row):
    df = pairs.where(f"pos = {row}")
    if name == "subtract_checked":
        df = df.withColumn("j", F.lit(1).cast("long"))
    with pytest.raises(Exception):  # noqa: B017
        column(df, call(name))


def test_floats(spark):
    values = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (NAN, 1.0), (None, 1.0), (NAN, NAN), (2.0, INF)]
    df = spark.createDataFrame([(n, *v) for n, v in enumerate(values)], "pos int, x double, y double")
    t = df.orderBy("pos").toArrow()
    show = lambda xs: [None if x is None else str(x) for x in xs]
    assert show(column(df, call("divide_float"))) == show(pc.divide(t["x"], t["y"]).to_pylist())
    assert show(column(df, E.divide(F.col("x"), F.col("y")))) == show(column(df, call("divide_float")))
    for name in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"):
        assert column(df, call(name)) == getattr(pc, name)(t["x"], t["y"]).to_pylist(), name
    assert column(df, E.eq(F.col("x"), F.col("y"))) == column(df, call("equal"))
    assert df.agg(E.max_(F.col("x"))).first()[0] == 2.0


def test_fills_take_one_pass(spark):
    values = [None, 1.0, None, None, NAN, None, -INF, -0.0, None, INF, None, None]
    df = spark.createDataFrame([(n, "ab"[n % 2], x) for n, x in enumerate(values)], "pos int, k string, x double")
    show = lambda xs: [None if x is None else str(x) for x in xs]
    for name in ("fill_null_forward", "fill_null_backward"):
        fill = getattr(pc, name)
        filled = df.withColumn("all", call(name)).withColumn("own", call(name, by="k"))
        assert show(column(filled, F.col("all"))) == show(fill(pa.array(values)).to_pylist())
        for n in (0, 1):
            assert show(column(filled.where(f"pos % 2 = {n}"), F.col("own"))) == show(fill(pa.array(values[n::2])).to_pylist())
        # a frame that ends at the last row is folded anew for each row: the square of a window's rows
        assert "unboundedfollowing" not in df.select(call(name))._jdf.queryExecution().toString().lower()


def test_logic(spark):
    tri = [True, False, None]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate((a, b) for a in tri for b in tri)], "pos int, b boolean, c boolean")
    t = df.orderBy("pos").toArrow()
    for name in ("and_", "or_", "and_kleene", "or_kleene", "and_not", "and_not_kleene", "xor"):
        assert column(df, call(name)) == getattr(pc, name)(t["b"], t["c"]).to_pylist(), name
    assert column(df, E.and_(F.col("b"), F.col("c"))) == column(df, call("and_"))


STRINGS = ["", " a b ", "straße", "HELLO", "hello world", "Title Case", "12", "½²", "\t\n", "é", None, "日本"]


@pytest.mark.parametrize("name", [n for n in names("string predicates") if n != "utf8_is_digit"])
def test_string_predicates(spark, name):
    df = spark.createDataFrame([(n, s) for n, s in enumerate(STRINGS)], "pos int, s string")
    assert column(df, call(name)) == getattr(pc, name)(pa.array(STRINGS)).to_pylist()


def test_padding_never_truncates(spark):
    df = spark.createDataFrame([(0, "longer than eight"), (1, "ab"), (2, None)], "pos int, s string")
    assert column(df, call("utf8_lpad")) == ["longer than eight", "******ab", None]
    assert column(df, call("utf8_center")) == ["longer than eight", "***ab***", None]


def test_calls_put_in_columns():
    assert arguments(FUNCTIONS["if_else"]) == ["i", "j", "b"]
    assert expression("is_null", "a + b") == "(a + b) IS NULL"
    assert "PARTITION BY k ORDER BY pos" in expression("pairwise_diff", i="v", by="k")
    with pytest.raises(KeyError):
        expression("no_such_function")
    with pytest.raises(TypeError):
        expression("is_null", "a", "b")


def test_temporal(spark):
    t = datetime.datetime(2024, 12, 30, 23, 59, 59, 123456)
    df = spark.createDataFrame([(0, t)], "pos int, ts timestamp_ntz")
    want = pa.array([t], pa.timestamp("us"))
    for name in ("year", "month", "day", "hour", "minute", "second", "quarter", "day_of_week", "day_of_year", "iso_week", "iso_year", "us_week", "us_year", "millisecond", "microsecond", "is_leap_year"):
        assert column(df, call(name)) == getattr(pc, name)(want).to_pylist(), name


def test_unicode(spark):
    df = spark.createDataFrame([(0, "é", 0.975), (1, None, None)], "pos int, s string, q double")
    assert column(df, unicode.utf8_normalize("s")) == ["é", None]
    assert column(df, unicode.normal_ppf("q"))[0] == pytest.approx(1.959964, abs=1e-6)
    assert column(df.withColumn("s", F.lit("xa1")), unicode.regex_spans("s", r"([a-z])(\d)"))[0] == [{"start": 1, "length": 1}, {"start": 2, "length": 1}]


def test_options(spark):
    from colonnade.functions.options import OPTIONS, others
    from colonnade.functions.registry import call, expression

    df = spark.createDataFrame([("hello", 5), ("Hannah", 9), (None, None)], "t string, k bigint")
    got = df.select(call("starts_with", s="t", options={"pattern": "Han"}), call("replace_substring", s="t", options={"pattern": "l'", "replacement": "x"}), call("count_substring", s="t", options={"pattern": "n"}), call("is_in", i="k", options={"value_set": [9, 10]})).collect()
    assert [tuple(r) for r in got] == [(False, "hello", 0, False), (True, "Hannah", 2, True), (None, None, None, False)]
    assert df.select(call("quantile", i="k", options={"q": 1.0})).first()[0] == 9 and df.select(call("stddev", i="k", options={"ddof": "1"})).first()[0] == pytest.approx(8**0.5)
    with pytest.raises(TypeError):
        call("starts_with", s="t", options={"width": 3})
    assert all(expression(name, options=others(name)) != expression(name) for name in OPTIONS)
