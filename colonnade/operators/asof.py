"""As-of join: each left row takes the nearest right row by an ordered key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def join_asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), strategy: str = "backward", tolerance: object = None, suffix: str = "_right") -> DataFrame:
    """A left join to the nearest right row with the same ``by``.

    backward takes the last right key at or before the left one, forward the
    first at or after, nearest the closer of both (ties go backward). Null keys
    match nothing. Of right rows with one key, the last in the order of their
    columns is taken backward, the first forward.

    Both sides are united and sorted once by (by, on), and a window carries the
    last right row along: one shuffle on ``by``, no pairs. Without ``by`` all rows
    meet in one task, so give a key.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError("strategy is backward, forward or nearest")
    by = list(by)
    carried = [c for c in right.columns if c not in by and c != on]
    renamed = {c: c + suffix if c in left.columns else c for c in carried}
    key = F.col(f"`{on}`")
    row = F.struct(key.alias("__on"), *[F.col(f"`{c}`") for c in carried])
    lefts = left.select(*[F.col(f"`{c}`") for c in by], key.alias("__key"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"))
    rights = right.where(key.isNotNull()).dropna(subset=by or None if by else []) if by else right.where(key.isNotNull())
    rights = rights.select(*[F.col(f"`{c}`") for c in by], key.alias("__key"), F.lit(0).alias("__side"), row.alias("__right"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    back = F.last("__right", True).over(part.orderBy(F.col("__key").asc_nulls_first(), "__side", "__right").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last("__right", True).over(part.orderBy(F.col("__key").desc_nulls_first(), "__side", F.col("__right").desc()).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("__back", back) if strategy != "forward" else both.withColumn("__back", F.lit(None).cast(both.schema["__right"].dataType))
    found = found.withColumn("__ahead", ahead) if strategy != "backward" else found.withColumn("__ahead", F.lit(None).cast(both.schema["__right"].dataType))
    number = (lambda c: F.unix_micros(c.cast("timestamp"))) if left.schema[on].dataType.simpleString().startswith("timestamp") else (lambda c: F.unix_date(c)) if left.schema[on].dataType.simpleString() == "date" else (lambda c: c)
    gap_back, gap_ahead = number(F.col("__key")) - number(F.col("__back")["__on"]), number(F.col("__ahead")["__on"]) - number(F.col("__key"))
    picked = F.when(F.col("__ahead").isNull() | (gap_back <= gap_ahead), F.col("__back")).otherwise(F.col("__ahead"))
    found = found.where("__side = 1").withColumn("__got", F.when(F.col("__key").isNotNull(), picked))
    if tolerance is not None:
        gap = F.abs(number(F.col("__key")) - number(F.col("__got")["__on"]))
        found = found.withColumn("__got", F.when(gap <= F.lit(tolerance), F.col("__got")))
    return found.select("__left.*", *[F.col("__got")[c].alias(renamed[c]) for c in carried])
