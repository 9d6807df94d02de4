"""Functions that choose, move or make rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def indices_nonzero(df: DataFrame, column: str, pos: str) -> DataFrame:
    return df.where(F.col(column) != 0).select(pos)


def take(df: DataFrame, indices: DataFrame, index: str, pos: str) -> DataFrame:
    """The rows at ``indices``; a null or unknown index gives a row of nulls."""
    return indices.join(df, indices[index] == df[pos], "left")


def inverse_permutation(df: DataFrame, index: str, pos: str, size: int) -> DataFrame:
    """For each of 0..size-1 the position whose index it is, or null; of several the last."""
    last = df.where(F.col(index).isNotNull()).groupBy(F.col(index).alias("slot")).agg(F.max(pos).alias("position"))
    return df.sparkSession.range(size).select(F.col("id").alias("slot")).join(last, "slot", "left")


def scatter(df: DataFrame, index: str, pos: str, value: str, size: int) -> DataFrame:
    """Slots 0..size-1 with the value that goes there, or null; of several the last."""
    at = df.where(F.col(index).isNotNull()).groupBy(F.col(index).alias("slot")).agg(F.max_by(value, pos).alias(value))
    return df.sparkSession.range(size).select(F.col("id").alias("slot")).join(at, "slot", "left")


def unique(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Distinct values, null among them, with the position of the first."""
    return df.groupBy(column).agg(F.min(pos).alias("first_pos"))


def value_counts(df: DataFrame, column: str, pos: str | None = None) -> DataFrame:
    first = [F.min(pos).alias("first_pos")] if pos else []
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"), *first)


def dictionary(df: DataFrame, column: str, pos: str) -> DataFrame:
    """Codes of distinct values in order of first appearance.

    The distinct values are numbered in one task, as a dictionary is small by
    its nature; the rows themselves are not.
    """
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(pos).alias("__f"))
    return first.select(column, (F.row_number().over(W.orderBy("__f")) - 1).alias("code"))


def dictionary_encode(df: DataFrame, column: str, pos: str, codes: DataFrame | None = None) -> DataFrame:
    return df.join(codes if codes is not None else dictionary(df, column, pos), column, "left")


def dictionary_decode(encoded: DataFrame, codes: DataFrame) -> DataFrame:
    return encoded.join(codes, "code", "left")


def list_flatten(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("value"))


def list_parent_indices(df: DataFrame, column: str, pos: str) -> DataFrame:
    return df.select(F.col(pos).alias("parent"), F.posexplode(column).alias("offset", "value"))


def run_end_encode(df: DataFrame, column: str, pos: str, by: Sequence[str] = ()) -> DataFrame:
    """by, run_end (exclusive), value of each run of equal neighbours, null equal to null."""
    w = W.partitionBy(*by).orderBy(pos)
    new = F.when(F.lag(pos).over(w).isNull() | ~F.lag(column).over(w).eqNullSafe(F.col(column)), F.lit(1)).otherwise(F.lit(0))
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return runs.groupBy(*by, "__run").agg(F.max("__n").alias("run_end"), F.min_by(column, pos).alias("value")).drop("__run")


def run_end_decode(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n (from 0), value of each row of the runs."""
    before = F.coalesce(F.lag("run_end").over(W.partitionBy(*by).orderBy("run_end")), F.lit(0))
    return runs.withColumn("__b", before).select(*by, F.explode(F.sequence(F.col("__b"), F.col("run_end") - 1)).alias("n"), "value")


def search_sorted(values: DataFrame, needles: DataFrame, value: str, needle: str, side: str = "left") -> DataFrame:
    """needle and the index at which it would enter the sorted values.

    Values and needles are united in one order and counted along range
    partitions: no join of all pairs.
    """
    from colonnade.operators.ordering import global_cumulative

    a = values.where(F.col(value).isNotNull()).select(F.col(value).alias("__v"), F.lit(1).alias("__one"), F.lit(1 if side == "left" else 0).alias("__side"))
    b = needles.where(F.col(needle).isNotNull()).select(needle).distinct().select(F.col(needle).alias("__v"), F.lit(0).alias("__one"), F.lit(0 if side == "left" else 1).alias("__side"))
    both = global_cumulative(a.unionByName(b), "__one", ["__v", "__side"], "sum", "__at")
    return both.where("__one = 0").select(F.col("__v").alias(needle), F.col("__at").cast("long").alias("index"))


def winsorize(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """Values clamped to the nearest-rank quantiles at ``lower`` and ``upper``."""
    ends = df.agg(F.expr(f"percentile_disc({lower}) WITHIN GROUP (ORDER BY {column})").alias("__lo"), F.expr(f"percentile_disc({upper}) WITHIN GROUP (ORDER BY {column})").alias("__hi"))
    out = df.join(F.broadcast(ends))  # one row
    clamped = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("__lo")), F.col("__hi")))
    return out.withColumn(column, clamped).drop("__lo", "__hi")


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def filter_rows(df: DataFrame, mask: str) -> DataFrame:
    """Rows whose mask is true; a null mask drops the row."""
    return df.where(mask)


def sort_indices(df: DataFrame, by: Sequence[str], pos: str, descending: Sequence[bool] = ()) -> DataFrame:
    """Positions in sorted order, with their rank from 0; ties stay in the order of positions."""
    from colonnade.operators.ordering import with_positions

    down = [*descending, *[False] * (len(by) - len(descending))]
    keys = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in zip(by, down)]
    return with_positions(df.select(pos, *[c for c in by if c != pos]), [*keys, F.col(pos).asc()], "rank").select("rank", pos)


def random_column(df: DataFrame, seed: int, name: str = "random") -> DataFrame:
    """Uniform values in [0, 1), the same for a seed and a partitioning."""
    return df.withColumn(name, F.rand(seed))


def random_rows(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return random_column(spark.range(n), seed)


#: Functions of whole tables, by the names that column functions of this kind have.
TABLE_FUNCTIONS = {
    "indices_nonzero": indices_nonzero, "take": take, "array_take": take, "inverse_permutation": inverse_permutation, "scatter": scatter, "unique": unique, "value_counts": value_counts,
    "dictionary_encode": dictionary_encode, "dictionary_decode": dictionary_decode, "list_flatten": list_flatten, "list_parent_indices": list_parent_indices, "run_end_encode": run_end_encode,
    "run_end_decode": run_end_decode, "search_sorted": search_sorted, "winsorize": winsorize, "drop_null": drop_null, "filter": filter_rows, "array_filter": filter_rows, "sort_indices": sort_indices, "random": random_rows,
}
