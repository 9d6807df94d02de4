"""One query and one oracle for each function of the catalogue, over the events table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from colonnade.functions.catalog import FUNCTIONS, Function
from colonnade.functions.options import OPTIONS, others, with_options

_COMMON = """
SELECT event_id AS pos, user_id % 50 AS g,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 1000 - 50 END AS i,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 13 - 6 END AS j,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 23 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN event_id % 29 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE value - 5 END AS x,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(event_id % 10 AS DOUBLE) / 4 - 1 END AS y,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS b,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 < 2 END AS c,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(event_id % 70 AS INT) END AS n,
  CASE event_id % 14 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  padded  ' WHEN 3 THEN 'straße' WHEN 4 THEN 'Hello World' WHEN 5 THEN '12345'
       WHEN 6 THEN 'HELLO' WHEN 7 THEN 'hello' WHEN 8 THEN 'Élan vital' WHEN 9 THEN chr(9) || ' ' || chr(10) WHEN 10 THEN 'a-b_c 1' WHEN 11 THEN '+42' WHEN 12 THEN 'x²½' ELSE event_type END AS s,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 2 = 0 THEN '12' ELSE event_type END AS p,
  CASE WHEN event_id % 15 = 0 THEN NULL ELSE CAST((event_id % 977) * 1.125 - 500 AS DECIMAL(12,3)) END AS q,
  CAST(event_id % 20 AS DECIMAL(12,3)) AS r,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL '40' DAY ELSE ts - INTERVAL '1' HOUR END AS ts2
"""
_SPARK = f"SELECT *, array(i, j, 5L) AS arr, array(s, p) AS sarr, map('k', i) AS m, named_struct('a', i, 'b', s) AS st FROM ({_COMMON} FROM {{events}})"
_DUCK = f"(SELECT *, [i, j, 5] AS arr, [s, p] AS sarr, map {{'k': i}} AS m, {{'a': i, 'b': s}} AS st FROM ({_COMMON} FROM events))"

#: Rows on which a function that checks its arguments doesn't raise; nulls are among them.
_RAISES = {
    "divide_checked": "j <> 0", "remainder_checked": "j <> 0", "modulo_checked": "j <> 0", "sqrt_checked": "x >= 0", "ascii_reverse": "s NOT IN ('straße', 'Élan vital', 'x²½')",
    "ln_checked": "x > 0 AND NOT isnan(x)", "log10_checked": "x > 0 AND NOT isnan(x)", "log2_checked": "x > 0 AND NOT isnan(x)", "log1p_checked": "x > -1 AND NOT isnan(x)", "logb_checked": "x > 0 AND y > 0 AND y <> 1 AND NOT isnan(x) AND NOT isnan(y)",
    "acos_checked": "abs(x) <= 1", "asin_checked": "abs(x) <= 1", "acosh_checked": "x >= 1 AND NOT isnan(x)", "atanh_checked": "abs(x) < 1", "cos_checked": "abs(x) < 1e6", "sin_checked": "abs(x) < 1e6", "tan_checked": "abs(x) < 1e6",
    "shift_left_checked": "n < 63", "shift_right_checked": "n < 63", "power_checked": "n < 6",
}
_PLACES = 6
_WRAPPED = "((({0}) % 18446744073709551616 + 27670116110564327424) % 18446744073709551616 - 9223372036854775808)"
#: DuckDB's form of functions that the catalogue holds for Spark alone.
_DUCKDB = {
    "cast_safe": "try_cast(s AS BIGINT)", "power_checked": "CAST(pow(i, n) AS BIGINT)", "utf8_reverse": "reverse(s)", "shift_right_checked": "i >> n",
    "shift_left_checked": f"CAST({_WRAPPED.format('i::HUGEINT * (1::HUGEINT << n)')} AS BIGINT)",
}


def _select(f: Function, text: str, from_: str) -> str:
    value = f"round(CAST({text} AS DOUBLE), {_PLACES}) + 0.0e0" if f.double else text
    where = f" WHERE coalesce({_RAISES[f.name]}, true)" if f.name in _RAISES else ""
    if f.kind == "agg":
        return f"SELECT g, {value} AS {f.name} FROM {from_}{where} GROUP BY g" if f.section == "grouped" else f"SELECT {value} AS {f.name} FROM {from_}{where}"
    if f.kind == "window":
        value = value.replace("OVER (ORDER", "OVER (PARTITION BY g ORDER").replace("OVER ()", "OVER (PARTITION BY g)")
    return f"SELECT pos, {value} AS {f.name} FROM {from_}{where}"


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of all functions, made from events; nulls, NaN, infinities and odd strings included."""
    return spark.sql(_SPARK.format(events="{df}"), df=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _query(f: Function) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_select(f, f.spark.replace("{", "{{").replace("}", "}}"), "{df}"), df=inputs(spark, sf_dir))

    run.__name__ = f"fn_{f.name}"
    return run


QUERIES = {f"fn_{k}": _query(f) for k, f in FUNCTIONS.items()}
ORACLE_SQL = {f"fn_{k}": _select(f, f.duckdb or _DUCKDB[k], _DUCK) for k, f in FUNCTIONS.items() if f.duckdb is not None or k in _DUCKDB}

# Functions whose values need another form to be compared: infinite, or beyond the places that are kept.
_INFINITE = "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isinf(x) OR isinf(y) THEN CAST('Infinity' AS DOUBLE) ELSE sqrt(x * x + y * y) END"
_PRODUCT = f"CAST(list_reduce(list_prepend(1::HUGEINT, coalesce(list(n::HUGEINT) FILTER (WHERE n IS NOT NULL), [])), lambda a, v: {_WRAPPED.format('a * v')}) AS BIGINT)"
_LARGE = "sign({0}) * ln(1 + abs({0}))"  # values beyond the places that are compared
_WHOLE = {k: (_LARGE.format(FUNCTIONS[k].spark), _LARGE.format(FUNCTIONS[k].duckdb)) for k in ("cosh", "sinh")}
_WHOLE |= {"hypot": (FUNCTIONS["hypot"].spark, _INFINITE)}


def _whole(f: Function, text: str, from_: str) -> str:
    value = f"round(CAST({text} AS DOUBLE), {_PLACES}) + 0.0e0"
    if f.kind == "agg":
        return f"SELECT g, {value} AS {f.name} FROM {from_} GROUP BY g" if f.section == "grouped" else f"SELECT {value} AS {f.name} FROM {from_}"
    return f"SELECT pos, {value} AS {f.name} FROM {from_}"


def _whole_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("__inputs", "{df}"), df=inputs(spark, sf_dir))


for _name, (_spark, _duck) in _WHOLE.items():
    QUERIES[f"fn_{_name}"] = _whole_query(_whole(FUNCTIONS[_name], _spark, "__inputs"))
    ORACLE_SQL[f"fn_{_name}"] = _whole(FUNCTIONS[_name], _duck, _DUCK)
# one product for each user, so that no list holds more than a user's rows
_BY_USER = "SELECT user_id, {0} AS product FROM {1} GROUP BY user_id"
_USER = _COMMON.replace("SELECT event_id AS pos,", "SELECT user_id, event_id AS pos,")
QUERIES["fn_product"] = lambda spark, sf_dir: spark.sql(_BY_USER.format(FUNCTIONS["product"].spark, f"({_USER} FROM {{df}})"), df=spark.read.parquet(f"{sf_dir}/events.parquet"))
ORACLE_SQL["fn_product"] = _BY_USER.format(_PRODUCT, f"({_USER} FROM events)")



# Each function that has options, with other values of all of them.
for _name in OPTIONS:
    _f = FUNCTIONS[_name]
    _text = with_options(_name, _f.spark, "spark", others(_name))
    _other = replace(_f, name=f"{_name}_options")
    QUERIES[f"fn_{_name}_options"] = _whole_query(_select(_other, _text, "__inputs"))
    if _f.duckdb is not None and all(o.duckdb for o in OPTIONS[_name].values()):
        ORACLE_SQL[f"fn_{_name}_options"] = _select(_other, with_options(_name, _f.duckdb, "duckdb", others(_name)), _DUCK)
