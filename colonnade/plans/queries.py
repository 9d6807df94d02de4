"""Queries of the relational operators over the test tables, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import unicode
from colonnade.operators import ordering, rows
from colonnade.plans.frame import Frame, concat, query, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> Frame:
    return scan(spark, f"{d}/{name}.parquet")


@_q("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    f = _t(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").with_columns(disc=disc)
    g = f.group_by("l_returnflag", "l_linestatus").agg(sum_qty=("sum", "l_quantity"), sum_base=("sum", "l_extendedprice"), sum_disc=("sum", "disc"), avg_qty=("mean", "l_quantity"), n=("count", None))
    return g.with_columns(sum_qty=F.round("sum_qty", 2), sum_base=F.round("sum_base", 2), sum_disc=F.round("sum_disc", 2), avg_qty=F.round("avg_qty", 6)).df


@_q("SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem WHERE l_linenumber < 3 AND l_quantity > 10")
def filter_sum(spark, d):
    f = _t(spark, d, "lineitem").filter("l_linenumber < 3 AND l_quantity > 10").agg(total=("sum", "l_extendedprice"), n=("count", None))
    return f.with_columns(total=F.round("total", 2)).df


@_q("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC LIMIT 10")
def group_top10(spark, d):
    f = _t(spark, d, "lineitem").group_by("l_suppkey").agg(total=("sum", "l_extendedprice"), n=("count", None))
    return f.sort("total", descending=True, ties=["l_suppkey"]).limit(10).with_columns(total=F.round("total", 2)).df


@_q("SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1")
def join_group(spark, d):
    f = _t(spark, d, "orders").filter("o_orderstatus = 'F'").join(_t(spark, d, "customer"), "o_custkey", right_on="c_custkey").join(_t(spark, d, "nation"), "c_nationkey", right_on="n_nationkey")
    return f.group_by("n_name").agg(total=("sum", "o_totalprice"), n=("count", None)).with_columns(total=F.round("total", 2)).df


@_q("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS most FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL")
def three_way_join(spark, d):
    f = _t(spark, d, "customer").join(_t(spark, d, "orders"), "c_custkey", right_on="o_custkey")
    o = f.with_columns(l_orderkey="o_orderkey")
    j = o.join(Frame(_t(spark, d, "lineitem").df.where("l_returnflag = 'R'").select("l_orderkey")), "l_orderkey")
    return j.group_by("c_mktsegment", "o_orderpriority").agg(n=("count", None), most=("max", "o_totalprice")).with_columns(most=F.round("most", 2)).df


# Keys of which both sides leave some unmatched: floors of balances and of prices.
_SIDES = "(SELECT CAST(floor(c_acctbal) AS BIGINT) AS k, c_name AS name, c_nationkey AS v FROM customer) l {how} JOIN (SELECT CAST(floor(o_totalprice / 100) AS BIGINT) AS k, max(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1) r ON l.k = r.k"


def _sides(spark, d):
    left = _t(spark, d, "customer").with_columns(k=F.floor("c_acctbal").cast("long")).select("k", ("name", "c_name"), ("v", "c_nationkey"))
    right = _t(spark, d, "orders").with_columns(k=F.floor(F.col("o_totalprice") / 100).cast("long")).group_by("k").agg(v=("max", "o_totalprice"), n=("count", None))
    return left, right


for _how, _duck in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("semi", "SEMI"), ("anti", "ANTI")):
    def _join(spark, d, how=_how):
        left, right = _sides(spark, d)
        return left.join(right, "k", how).df

    QUERIES[f"join_{_how}"] = _join
    _cols = "l.k, name, l.v" if _how in ("semi", "anti") else "coalesce(l.k, r.k) AS k, name, l.v AS v, r.v AS v_right, n"
    ORACLE_SQL[f"join_{_how}"] = f"SELECT {_cols} FROM {_SIDES.format(how=_duck)}"

_LEFT = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"
_RIGHT = "(SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ALL)"


def _trades(spark, d):
    e = _t(spark, d, "events").df
    return Frame(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")), Frame(e.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value")))


@_q(f"SELECT l.event_id, l.user_id, l.ts, r.value FROM {_LEFT} l ASOF LEFT JOIN {_RIGHT} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(spark, d):
    left, right = _trades(spark, d)
    return left.join_asof(right, "ts", ["user_id"]).df


@_q(f"SELECT l.event_id, l.user_id, l.ts, r.value FROM {_LEFT} l ASOF LEFT JOIN {_RIGHT} r ON l.user_id = r.user_id AND l.ts <= r.ts")
def asof_forward(spark, d):
    left, right = _trades(spark, d)
    return left.join_asof(right, "ts", ["user_id"], "forward").df


@_q(f"SELECT event_id, user_id, ts, CASE WHEN a.ts IS NULL OR epoch_us(l.ts) - epoch_us(b.ts) <= epoch_us(a.ts) - epoch_us(l.ts) THEN b.value ELSE a.value END AS value FROM {_LEFT} l ASOF LEFT JOIN {_RIGHT} b ON l.user_id = b.user_id AND l.ts >= b.ts ASOF LEFT JOIN {_RIGHT} a ON l.user_id = a.user_id AND l.ts <= a.ts".replace("SELECT event_id, user_id, ts,", "SELECT l.event_id, l.user_id, l.ts,"))
def asof_nearest(spark, d):
    left, right = _trades(spark, d)
    return left.join_asof(right, "ts", ["user_id"], "nearest").df


@_q(f"SELECT l.event_id, l.user_id, l.ts, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 86400000000 THEN r.value END AS value FROM {_LEFT} l ASOF LEFT JOIN {_RIGHT} r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_tolerance(spark, d):
    left, right = _trades(spark, d)
    return left.join_asof(right, "ts", ["user_id"], tolerance=86_400_000_000).df


@_q("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def unique_keep_first(spark, d):
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").unique(["o_custkey"], ["o_orderkey"]).df


@_q("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def unique_rows(spark, d):
    return _t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").unique().df


@_q("SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2) OVER w AS ahead, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, CASE WHEN count(*) OVER r >= 3 THEN round(avg(o_totalprice) OVER r, 4) END AS rolled, CASE WHEN count(*) OVER r >= 3 THEN min(o_totalprice) OVER r END AS low, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority), r AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING)")
def window_functions(spark, d):
    f = _t(spark, d, "orders")
    f = f.window(["o_custkey"], ["o_orderkey"], rn=("row_number",), prev=("lag", "o_orderkey", 1), ahead=("lead", "o_orderkey", 2), running=("cum_sum", "o_totalprice"), rolled=("rolling_mean", "o_totalprice", 3), low=("rolling_min", "o_totalprice", 3), n=("count", None))
    f = f.window(["o_custkey"], ["o_orderpriority"], rk=("rank",), dr=("dense_rank",))
    return f.select("o_orderkey", "rn", "rk", "dr", "prev", "ahead", ("running", F.round("running", 2)), ("rolled", F.round("rolled", 4)), "low", "n").df


@_q("SELECT doc_id, unnest(string_split(coalesce(source, ''), 'c')) AS part FROM documents")
def explode_list(spark, d):
    return _t(spark, d, "documents").select("doc_id", ("part", F.split(F.coalesce("source", F.lit("")), "c"))).explode("part").df


@_q("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def concat_frames(spark, d):
    return concat([_t(spark, d, "nation").select(("name", "n_name")), _t(spark, d, "region").select(("name", "r_name"))]).df


@_q("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 10")
def sort_limit_offset(spark, d):
    f = _t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return f.sort("p_retailprice", descending=True, ties=["p_partkey"]).limit(20, 10).df


@_q("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def top_k(spark, d):
    return ordering.top_k(_t(spark, d, "part").df.select("p_partkey", "p_retailprice"), "p_retailprice", 100, ties=["p_partkey"])


@_q("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 100")
def bottom_k(spark, d):
    return ordering.top_k(_t(spark, d, "part").df.select("p_partkey", "p_retailprice"), "p_retailprice", 100, False, ["p_partkey"])


@_q("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def global_positions(spark, d):
    return ordering.with_positions(_t(spark, d, "orders").df.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "pos")


@_q("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders")
def global_running_sum(spark, d):
    return ordering.global_cumulative(_t(spark, d, "orders").df.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], "sum", "running").select("o_orderkey", "running")


@_q("SELECT DISTINCT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey < c_custkey) AS index FROM customer")
def search_sorted(spark, d):
    return rows.search_sorted(_t(spark, d, "orders").df, _t(spark, d, "customer").df, "o_custkey", "c_custkey")


@_q("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, CAST(max(n) AS INTEGER) AS run_end, event_type AS value FROM r GROUP BY user_id, event_type, g")
def run_end_encode(spark, d):
    return rows.run_end_encode(_t(spark, d, "events").df, "event_type", "event_id", ["user_id"])


@_q("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS n, event_type AS value FROM events")
def run_end_decode(spark, d):
    return rows.run_end_decode(run_end_encode(spark, d), ["user_id"])


@_q("SELECT event_type, count(*) AS count, min(event_id) AS first_pos FROM events GROUP BY 1")
def value_counts(spark, d):
    return rows.value_counts(_t(spark, d, "events").df, "event_type", "event_id")


@_q("SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1")
def unique_values(spark, d):
    return rows.unique(_t(spark, d, "events").df, "event_type", "event_id")


@_q("WITH f AS (SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS code FROM events GROUP BY 1) SELECT event_id, event_type, code FROM events JOIN f USING (event_type)")
def dictionary_encode(spark, d):
    return rows.dictionary_encode(_t(spark, d, "events").df.select("event_id", "event_type"), "event_type", "event_id")


@_q("SELECT event_id, event_type FROM events")
def dictionary_decode(spark, d):
    e = _t(spark, d, "events").df.select("event_id", "event_type")
    codes = rows.dictionary(e, "event_type", "event_id")
    return rows.dictionary_decode(rows.dictionary_encode(e, "event_type", "event_id", codes).select("event_id", "code"), codes).select("event_id", "event_type")


@_q("SELECT o_orderkey FROM orders WHERE o_custkey % 4 <> 0")
def indices_nonzero(spark, d):
    return rows.indices_nonzero(_t(spark, d, "orders").df.withColumn("m", F.expr("o_custkey % 4")), "m", "o_orderkey")


@_q("SELECT n_nationkey AS i, s_name FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey")
def take_rows(spark, d):
    s = _t(spark, d, "supplier").df.select(F.col("s_suppkey").cast("int").alias("pos"), "s_name")
    return rows.take(s, _t(spark, d, "nation").df.select(F.col("n_nationkey").alias("i")), "i", "pos").select("i", "s_name")


@_q("SELECT slot, max(n_nationkey) AS position FROM range(30) t(slot) LEFT JOIN nation ON (n_nationkey * 7) % 30 = slot GROUP BY slot")
def inverse_permutation(spark, d):
    n = _t(spark, d, "nation").df.withColumn("at", F.expr("n_nationkey * 7 % 30"))
    return rows.inverse_permutation(n, "at", "n_nationkey", 30)


@_q("SELECT slot, arg_max(n_name, n_nationkey) AS n_name FROM range(30) t(slot) LEFT JOIN nation ON (n_nationkey * 7) % 30 = slot GROUP BY slot")
def scatter_rows(spark, d):
    n = _t(spark, d, "nation").df.withColumn("at", F.expr("n_nationkey * 7 % 30"))
    return rows.scatter(n, "at", "n_nationkey", "n_name", 30)


@_q("SELECT unnest(embedding) AS value FROM embeddings")
def list_flatten(spark, d):
    return rows.list_flatten(_t(spark, d, "embeddings").df, "embedding")


@_q("SELECT vec_id AS parent, CAST(unnest(range(len(embedding))) AS INTEGER) AS offset, unnest(embedding) AS value FROM embeddings")
def list_parent_indices(spark, d):
    return rows.list_parent_indices(_t(spark, d, "embeddings").df, "embedding", "vec_id")


@_q("SELECT p_partkey, least(greatest(p_retailprice, lo), hi) AS p_retailprice FROM part, (SELECT quantile_disc(p_retailprice, 0.05) AS lo, quantile_disc(p_retailprice, 0.95) AS hi FROM part)")
def winsorize(spark, d):
    return rows.winsorize(_t(spark, d, "part").df.select("p_partkey", "p_retailprice"), "p_retailprice", 0.05, 0.95)


@_q("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def utf8_normalize(spark, d):
    return _t(spark, d, "documents").df.select("doc_id", unicode.utf8_normalize("text").alias("text"))


@_q("SELECT CAST(k AS INTEGER) AS n_regionkey, count(n_name) AS n, max(n_nationkey) AS top FROM range(7) t(k) LEFT JOIN nation ON n_regionkey = k AND n_nationkey > 3 GROUP BY 1")
def dense_key_query(spark, d):
    return query(_t(spark, d, "nation").df, "n_nationkey > 3", "n_regionkey", 7, n=("count", "n_name"), top=("max", "n_nationkey"))


@_q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice > 100000 AND (o_orderstatus = 'O' OR o_custkey % 5 = 0)")
def filter_rows(spark, d):
    return _t(spark, d, "orders").filter("o_totalprice > 100000").filter("o_orderstatus = 'O' OR o_custkey % 5 = 0").select("o_orderkey", "o_totalprice").df


@_q("SELECT * EXCLUDE (props, ts) REPLACE (value * 2 AS value) RENAME (user_id AS who) FROM events")
def edit_columns(spark, d):
    return _t(spark, d, "events").drop("props", "ts").with_columns(value=F.col("value") * 2).rename({"user_id": "who"}).df


@_q("SELECT CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN o_totalprice < 0 THEN 1 END) AS s, max(o_orderdate) AS m FROM orders WHERE o_totalprice < 0".replace("sum(CASE WHEN o_totalprice < 0 THEN 1 END)", "CAST(sum(o_totalprice) AS DOUBLE)"))
def agg_empty(spark, d):
    return _t(spark, d, "orders").filter("o_totalprice < 0").agg(n=("count", None), s=("sum", "o_totalprice"), m=("max", "o_orderdate")).df


@_q("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_extra(spark, d):
    return _t(spark, d, "orders").df.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_q("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_extra(spark, d):
    return _t(spark, d, "customer").df.select("c_custkey").subtract(_t(spark, d, "orders").df.select("o_custkey"))


@_q("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
def sort_indices(spark, d):
    return rows.sort_indices(_t(spark, d, "orders").df, ["o_orderpriority", "o_totalprice"], "o_orderkey", [False, True])


@_q("SELECT event_id, props FROM events WHERE props IS NOT NULL AND event_id IS NOT NULL")
def drop_null(spark, d):
    return rows.drop_null(_t(spark, d, "events").df.select("event_id", "props"))


@_q("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END")
def filter_null_mask(spark, d):
    return rows.filter_rows(_t(spark, d, "events").df.select("event_id"), "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END")


@_q("SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE list_product(list_transform(range(0, n_nationkey + 1), lambda k: CASE WHEN k % 5 = 4 THEN 1 ELSE k % 3 + 1 END)) END AS BIGINT) AS cumulative FROM nation")
def cumulative_prod(spark, d):
    n = _t(spark, d, "nation").df.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey % 3 + 1 END").alias("v"))
    return ordering.global_cumulative_product(n, "v", ["n_nationkey"]).select("n_nationkey", "cumulative")


@_q(ORACLE_SQL["cumulative_prod"])
def cumulative_prod_checked(spark, d):
    n = _t(spark, d, "nation").df.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey % 3 + 1 END").alias("v"))
    return ordering.global_cumulative_product(n, "v", ["n_nationkey"], checked=True).select("n_nationkey", "cumulative")


@_q()
def rank_normal(spark, d):
    from colonnade.functions.registry import call

    e = _t(spark, d, "events").df.select("event_id", "user_id", "value")
    return e.select("event_id", unicode.normal_ppf(call("rank_quantile", i="value", by="user_id")).alias("rank_normal"))


@_q("SELECT CAST(count(*) AS BIGINT) AS n, true AS inside FROM range(1000)")
def random_values(spark, d):
    return rows.random_rows(spark, 1000, 42).agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("random") >= 0) & (F.col("random") < 1)).alias("inside"))


@_q("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(15,2)) AS v FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def slice_rows(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", ("v", F.round("o_totalprice", 2).cast("decimal(15,2)"))).slice(100, 50, ["o_orderkey"]).df
