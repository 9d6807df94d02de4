"""Order: sort keys with placements of nulls and NaN, keep-first, top-k, and global positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from colonnade.functions.expressions import multiply
from colonnade.session import materialized

FLOAT_ORDERS = ("ieee", "total", "nan_largest")


def sort_keys(column: str, descending: bool = False, nulls: str = "last", float_order: str = "ieee", is_float: bool = False) -> list[Column]:
    """Order-by keys of one column.

    ieee puts NaN beside the nulls, whichever way values run; total puts -0.0
    before 0.0 and NaN above infinity; nan_largest treats NaN as the largest.
    """
    if float_order not in FLOAT_ORDERS or nulls not in ("first", "last"):
        raise ValueError("nulls is first or last; float_order is ieee, total or nan_largest")
    c = F.col(f"`{column}`")
    way = (lambda k: k.desc_nulls_last()) if descending else (lambda k: k.asc_nulls_last())
    last = nulls == "last"
    null_key = F.when(c.isNull(), F.lit(1 if last else -1)).otherwise(F.lit(0)).asc()
    if not is_float:
        return [null_key, way(c)]
    if float_order == "ieee":
        place = F.when(c.isNull(), F.lit(2)).when(F.isnan(c), F.lit(1)).otherwise(F.lit(0))
        return [place.asc() if last else place.desc(), way(c)]
    if float_order == "total":
        zero = F.when(c.cast("string") == "-0.0", F.lit(-1)).otherwise(F.lit(0))
        return [null_key, way(c), way(zero)]
    return [null_key, way(c)]


def keep_first(df: DataFrame, subset: Sequence[str] | None, order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each key; null is a key.

    One row a key is chosen by an aggregate, so that partial results shrink
    before the shuffle and a hot key is no burden.
    """
    if not subset:
        return df.dropDuplicates()
    columns = df.columns
    key = F.struct(*[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in columns if c not in order])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if any("map<" in t or "variant" in t for t in types.values()):  # maps have no order
        w = W.partitionBy(*subset).orderBy(*order)
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    first = df.groupBy(*[F.col(f"`{c}`").alias(f"__k{n}") for n, c in enumerate(subset)]).agg(F.min(key).alias("__first"))
    return first.select(*[F.col("__first")[c].alias(c) for c in columns])


def top_k(df: DataFrame, by: str, k: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """k rows by one column; each task keeps k rows, and k rows of each task meet in one."""
    key = F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last()
    return df.orderBy(key, *ties).limit(k)


def with_positions(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Adds the global row number, from 0, in an order.

    Rows are range-partitioned and numbered within their partition; only the
    counts of partitions, one row each, are summed up in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialized(ranged)
    inside = ranged.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__part", (F.sum("__c").over(W.orderBy("__part")) - F.col("__c")).alias("__b"))
    out = inside.join(F.broadcast(before), "__part")  # one row for each shuffle partition
    return out.withColumn(name, F.col("__n") + F.col("__b")).drop("__part", "__n", "__b")


def global_cumulative(df: DataFrame, value: str, order: Sequence[str], kind: str = "sum", name: str = "cumulative") -> DataFrame:
    """A running sum, min or max over all rows in an order; null where the value is null.

    As in with_positions, partitions are ranges of the order, and what precedes a
    partition is one row for each partition.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}[kind]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    inside = ranged.withColumn("__upto", fold(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    totals = ranged.groupBy("__part").agg(fold(value).alias("__total"))
    before = totals.select("__part", fold("__total").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    out = inside.join(F.broadcast(before), "__part")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), join(F.col("__before"), F.col("__upto")))).drop("__part", "__upto", "__before")


def global_cumulative_product(df: DataFrame, value: str, order: Sequence[str], checked: bool = False, name: str = "cumulative") -> DataFrame:
    """A running product of all rows in an order, in 64 bits: it wraps, or raises if ``checked``.

    Nulls stay null and are skipped. Each range partition is multiplied up in one
    pass; what precedes a partition is one number for each partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn(name, F.col(value).cast("long"))
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, size = np.int64(1), 1.0
        for batch in batches:
            column = batch.column(names.index(name))
            v = column.fill_null(1).to_numpy(zero_copy_only=False)
            if checked and len(v) and np.abs(size * np.cumprod(v.astype(np.float64))).max() >= 2.0**63:
                raise OverflowError("overflow")
            with np.errstate(over="ignore"):
                product = np.multiply.accumulate(np.concatenate([[carry], v]))[1:]
            if len(v):
                carry, size = product[-1], size * float(np.prod(v.astype(np.float64)))
            columns = [pa.array(product, mask=column.is_null().to_numpy(zero_copy_only=False)) if k == name else c for k, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    inside = materialized(ranged.mapInArrow(run, ranged.schema))
    last = inside.where(F.col(name).isNotNull()).groupBy("__part").agg(F.max_by(name, F.struct(*order)).alias("t"))
    before, product, rows = {}, 1, sorted((r["__part"], r["t"]) for r in last.collect())  # one row for each partition
    for part, total in rows:
        before[part] = product
        product *= total
        if checked and abs(product) >= 2**63:
            raise OverflowError("overflow")
        product = (product + 2**63) % 2**64 - 2**63
    found = df.sparkSession.createDataFrame(list(before.items()) or [(-1, 1)], "__part int, __before long")
    return inside.join(F.broadcast(found), "__part", "left").withColumn(name, multiply(F.col(name), F.col("__before"))).drop("__part", "__before")
