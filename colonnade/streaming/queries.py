"""Queries of streams, sources and sinks, with their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.session import shared_folder
from colonnade.sources import files
from colonnade.streaming.stream import Stream, available_now, scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lineitem(spark: SparkSession, d: str) -> Stream:
    return scan_parquet(spark, f"{d}/lineitem.parquet")


@_q("SELECT round(sum(l_quantity), 2) AS s, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi, round(avg(l_discount), 9) AS m, round(var_pop(l_discount), 9) AS v, round(stddev_pop(l_discount), 9) AS d FROM lineitem WHERE l_quantity > 5")
def stream_agg(spark, d):
    got = _lineitem(spark, d).filter("l_quantity > 5").agg(s=("sum", "l_quantity"), n=("count", None), lo=("min", "l_tax"), hi=("max", "l_tax"), m=("mean", "l_discount"), v=("variance", "l_discount"), d=("stddev", "l_discount"))
    return got.select(F.round("s", 2).alias("s"), "n", "lo", "hi", *[F.round(c, 9).alias(c) for c in "mvd"])


@_q("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def stream_group_by(spark, d):
    return _lineitem(spark, d).group_by("l_suppkey", total=("sum", "l_extendedprice"), n=("count", None)).withColumn("total", F.round("total", 2))


@_q("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def stream_top_k(spark, d):
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice").top_k("l_extendedprice", 50, ties=["l_orderkey", "l_linenumber"])


@_q("SELECT o_orderkey, o_totalprice FROM orders")
def stream_sort(spark, d):
    return scan_parquet(spark, f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").sort("o_totalprice", "o_orderkey")


@_q("SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def stream_join_agg(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return _lineitem(spark, d).join_agg(orders, "l_orderkey", ["o_orderpriority"], total=("sum", "l_extendedprice")).withColumn("total", F.round("total", 2))


@_q("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def stream_join_partitioned(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _lineitem(spark, d).join_partitioned(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "o_custkey").df


@_q("SELECT count(DISTINCT l_partkey) BETWEEN 0 AND 1000000000 AS near FROM lineitem")
def stream_count_distinct_approx(spark, d):
    s = _lineitem(spark, d)
    exact = s.df.agg(F.countDistinct("l_partkey").alias("n"))
    return s.count_distinct_approx("l_partkey", 14).join(F.broadcast(exact)).select((F.abs(F.col("count_distinct") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("near"))


@_q("SELECT true AS near")
def stream_quantile(spark, d):
    s = _lineitem(spark, d)
    got = s.quantile("l_extendedprice", 0.5)
    rank = s.df.join(F.broadcast(got)).agg((F.sum(F.when(F.col("l_extendedprice") <= F.col("quantile"), 1).otherwise(0)) / F.count(F.lit(1))).alias("r"))
    return rank.select((F.abs(F.col("r") - 0.5) < 0.01).alias("near"))


@_q("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def structured_group_by(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    got = available_now(source, lambda s: s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), f"t{uuid.uuid4().hex}", _new(spark, "query"))
    return got.withColumn("total", F.round("total", 4))


@_q("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def structured_windows(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    timed = lambda s: s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    got = available_now(source, timed, f"t{uuid.uuid4().hex}", _new(spark, "query"))
    return got.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_q("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 10 AND p_retailprice < 1500")
def parquet_read(spark, d):
    return files.read_parquet(spark, f"{d}/part.parquet", ["p_partkey", "p_name", "p_retailprice"], [("p_size", ">", 10), ("p_retailprice", "<", 1500.0)])


@_q("SELECT * FROM supplier")
def parquet_round_trip(spark, d):
    at = _new(spark, "parquet")
    files.write_parquet(spark.read.parquet(f"{d}/supplier.parquet"), at, "zstd", 1 << 20)
    return files.read_parquet(spark, at)


@_q("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def partitioned_sink(spark, d):
    at = _new(spark, "partitioned")
    scan_parquet(spark, f"{d}/nation.parquet").sink_partitioned(at, ["n_regionkey"])
    return spark.read.parquet(at).select("n_regionkey", "n_nationkey", "n_name")


@_q("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    at = _new(spark, "csv")
    files.write_csv(spark.read.parquet(f"{d}/customer.parquet"), at)
    return files.read_csv(spark, at)


@_q("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_round_trip(spark, d):
    at = _new(spark, "json")
    e = spark.read.parquet(f"{d}/events.parquet")
    files.write_json(e.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), at)
    got = files.read_json(spark, at)
    return got.withColumn("value", F.col("value").cast("double"))


@_q("SELECT vec_id, embedding, label FROM embeddings")
def ipc_round_trip(spark, d):
    at = _new(spark, "ipc")
    files.write_ipc(spark.read.parquet(f"{d}/embeddings.parquet"), at)
    return files.read_ipc(spark, at)


@_q()
def parquet_metadata(spark, d):
    return files.parquet_metadata(spark, f"{d}/orders.parquet")
