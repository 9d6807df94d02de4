import pytest
from pyspark.sql import functions as F

from colonnade.operators.joining import small
from colonnade.operators.ordering import global_cumulative, with_positions
from colonnade.plans.frame import Frame, concat, query, scan

NAN = float("nan")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(n, None if n % 23 == 5 else n % 7, None if n % 17 == 3 else NAN if n % 19 == 4 else float(n % 50), n % 40 - 10) for n in range(500)]
    return scan(spark, spark.createDataFrame(rows, "pos long, region int, amount double, qty long"))


def test_nulls_and_nan_are_groups(sales):
    got = {r["region"]: r for r in sales.group_by("region").agg(n=("count", None), hi=("max", "amount")).collect()}
    assert None in got and sum(r["n"] for r in got.values()) == 500
    assert all(r["hi"] <= 49 for r in got.values())


def test_empty_aggregate_gives_one_row(sales):
    assert [tuple(r) for r in sales.filter("qty > 1000").agg(n=("count", None), s=("sum", "qty"), m=("min", "amount")).collect()] == [(0, None, None)]


@pytest.mark.parametrize("order,want", [("ieee", [-1.0, 2.0, "nan", None]), ("nan_largest", [-1.0, 2.0, "nan", None])])
def test_sort_places(spark, order, want):
    f = Frame(spark.createDataFrame([(2.0,), (NAN,), (None,), (-1.0,)], "x double"))
    show = lambda g: ["nan" if r[0] is not None and r[0] != r[0] else r[0] for r in g.collect()]
    assert show(f.sort("x", float_order=order)) == want
    down = show(f.sort("x", descending=True, float_order=order))
    assert down == ([2.0, -1.0, "nan", None] if order == "ieee" else ["nan", 2.0, -1.0, None])
    assert show(f.sort("x", nulls="first", float_order=order))[0] is None


def test_negative_zero_first_in_total_order(spark):
    f = Frame(spark.createDataFrame([(0.0,), (-0.0,)], "x double"))
    assert [str(r[0]) for r in f.sort("x", float_order="total").collect()] == ["-0.0", "0.0"]


def test_unique_keeps_the_first(sales):
    got = {r["region"]: r["pos"] for r in sales.unique(["region"], ["pos"]).collect()}
    assert got[0] == 0 and got[None] == 5 and len(got) == 8


def test_join_names_and_keys(spark):
    a = Frame(spark.createDataFrame([(1, 10, 5), (None, 20, 6)], "k int, v int, v_right int"))
    b = Frame(spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "k int, v int"))
    full = a.join(b, "k", "full")
    assert full.columns == ["k", "v", "v_right", "v_right2"]
    assert sorted((str(r["k"]), str(r["v_right2"])) for r in full.collect()) == [("1", "7"), ("2", "8"), ("None", "9"), ("None", "None")]
    assert a.join(b, "k", "semi").df.count() == 1 and a.join(b, "k", "anti").df.count() == 1
    with pytest.raises(ValueError):
        a.join(b, "k", "cross")


def test_asof(spark):
    left = Frame(spark.createDataFrame([("a", 5), ("a", 1), ("a", None), ("b", 9), (None, 4)], "g string, t long"))
    right = Frame(spark.createDataFrame([("a", 2, 20), ("a", 6, 60), ("a", None, 0), ("b", 20, 1)], "g string, t long, v long"))
    show = lambda f: {(r["g"], r["t"]): r["v"] for r in f.collect()}
    assert show(left.join_asof(right, "t", ["g"])) == {("a", 5): 20, ("a", 1): None, ("a", None): None, ("b", 9): None, (None, 4): None}
    assert show(left.join_asof(right, "t", ["g"], "forward"))[("a", 5)] == 60
    assert show(left.join_asof(right, "t", ["g"], "nearest"))[("a", 5)] == 60
    assert show(left.join_asof(right, "t", ["g"], "nearest", 0))[("a", 5)] is None
    tie = Frame(spark.createDataFrame([("a", 4)], "g string, t long"))
    assert show(tie.join_asof(right, "t", ["g"], "nearest"))[("a", 4)] == 20


def test_window_and_explode(spark):
    f = Frame(spark.createDataFrame([(1, 1, 2.0, [1, 2]), (1, 2, None, []), (1, 3, NAN, None), (2, 1, 5.0, [3])], "g int, o int, x double, l array<int>"))
    got = f.window(["g"], ["o"], s=("cum_sum", "x"), r=("rolling_max", "x", 2), hi=("max", "x")).sort("g", "o").collect()
    assert got[1]["s"] is None and got[0]["hi"] == 2.0 and got[1]["r"] is None
    assert f.explode("l").df.count() == 5


def test_concat_and_errors(sales):
    assert concat([sales, sales]).df.count() == 1000
    with pytest.raises(ValueError):
        concat([sales, sales.drop("qty")])
    with pytest.raises(KeyError):
        sales.drop("nothing")


def test_positions_and_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r["v"] == r["pos"] for r in with_positions(df, ["v"]).collect())
    got = {r["v"]: r["cumulative"] for r in global_cumulative(df, "v", ["v"]).collect()}
    assert got[999] == 999 * 500 and got[10] == 55


def test_dense_key_query(sales):
    got = query(sales.df, "qty > 0", "region", 9, n=("count", None)).orderBy("region").collect()
    assert [r["region"] for r in got] == list(range(9)) and got[8]["n"] == 0


def test_plans(spark):
    lineitem = scan(spark, "/root/testdata/sf0.001/lineitem.parquet")
    text = lineitem.filter("l_quantity > 45").select("l_orderkey").explain()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "TakeOrderedAndProject" in lineitem.sort("l_extendedprice", descending=True).limit(5).explain()
    assert "BroadcastHashJoin" in lineitem.join(Frame(small(scan(spark, "/root/testdata/sf0.001/supplier.parquet").df)), "l_suppkey", right_on="s_suppkey").explain()
