"""Streams: mergeable operators over data that need not fit in memory.

A Stream is a DataFrame seen as batches: partitions are the batches, partial and
final aggregation merge them, and Spark spills. Every operator also has a
Structured Streaming face in ``available_now``, which runs a finite source in
micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.expressions import aggregate
from colonnade.operators.joining import small
from colonnade.operators.ordering import top_k
from colonnade.sources.files import read_ipc, write_ipc, write_parquet

KINDS = ("sum", "count", "min", "max", "mean", "variance", "stddev")


def _aggregates(df: DataFrame, items: dict[str, tuple[str, str | None]]) -> list[Column]:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    if bad := [k for k, _ in items.values() if k not in KINDS]:
        raise ValueError(f"not mergeable: {', '.join(bad)}")
    return [aggregate(kind, column, column in floats).alias(name) for name, (kind, column) in items.items()]


class Stream:
    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, condition: Column | str) -> Stream:
        return Stream(self.df.where(condition))

    def select(self, *items: Column | str) -> Stream:
        return Stream(self.df.select(*items))

    def project(self, **items: Column) -> Stream:
        return Stream(self.df.select(*[c.alias(n) for n, c in items.items()]))

    def agg(self, **items: tuple[str, str | None]) -> DataFrame:
        return self.df.agg(*_aggregates(self.df, items))

    def group_by(self, *keys: str, **items: tuple[str, str | None]) -> DataFrame:
        """Groups in ascending order of their keys."""
        return self.df.groupBy(*keys).agg(*_aggregates(self.df, items)).orderBy(*keys)

    def count_distinct_approx(self, column: str, p: int = 14) -> DataFrame:
        """A HyperLogLog sketch of 2^p registers: its error is about 1.04 / sqrt(2^p)."""
        sketch = F.hll_sketch_agg(column, F.lit(p))
        return self.df.agg(F.hll_sketch_estimate(sketch).alias("count_distinct"))

    def quantile(self, column: str, q: float | Sequence[float], compression: int = 10_000) -> DataFrame:
        """Quantiles with a rank error of at most 1 / compression."""
        return self.df.agg(F.percentile_approx(column, q, compression).alias("quantile"))

    def top_k(self, column: str, k: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
        return top_k(self.df, column, k, largest, ties)

    def sort(self, *by: str | Column, limit: int | None = None) -> DataFrame:
        """An external sort: ranges of the keys are exchanged and sorted with spilling."""
        out = self.df.orderBy(*by)
        return out.limit(limit) if limit is not None else out

    def sort_to_ipc(self, uri: str, *by: str) -> DataFrame:
        return write_ipc(self.df.orderBy(*by), uri)

    def join(self, other: DataFrame, on: str | Sequence[str], how: str = "inner") -> Stream:
        """other is broadcast if the optimizer bounds it by 64 MB; else both sides are partitioned by key."""
        return Stream(self.df.join(small(other), on, how))

    def join_partitioned(self, other: DataFrame, on: str | Sequence[str], how: str = "inner") -> Stream:
        """Both sides are hash-partitioned by key, and each partition joined by itself."""
        return Stream(self.df.join(other.hint("SHUFFLE_HASH"), on, how))

    def join_agg(self, other: DataFrame, on: str | Sequence[str], keys: Sequence[str] = (), how: str = "inner", **items: tuple[str, str | None]) -> DataFrame:
        joined = self.join(other, on, how)
        return joined.group_by(*keys, **items) if keys else joined.agg(**items)

    def observed(self, name: str = "progress") -> tuple[Stream, object]:
        """The stream, and an Observation that gets its rows once it has run."""
        from pyspark.sql import Observation

        seen = Observation(name)
        return Stream(self.df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen

    def batches(self) -> Iterator:
        """Rows one partition at a time on the driver, whose memory holds one partition."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def for_each_batch(self, f: Callable[[pa.RecordBatch], None]) -> None:
        """Calls f with each Arrow batch, where the batch is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for b in batches:
                f(b)
                n += b.num_rows
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        self.df.mapInArrow(run, "n long").agg(F.sum("n")).collect()

    def sink_ipc(self, uri: str) -> DataFrame:
        return write_ipc(self.df, uri)

    def sink_partitioned(self, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
        write_parquet(self.df, path, partition_by=by, mode=mode)

    def collect(self) -> pa.Table:
        return self.df.toArrow()


def scan_ipc(spark: SparkSession, path: str) -> Stream:
    return Stream(read_ipc(spark, path))


def scan_parquet(spark: SparkSession, path: str) -> Stream:
    return Stream(spark.read.parquet(path))


def scan_table(spark: SparkSession, table: pa.Table) -> Stream:
    return Stream(spark.createDataFrame(table))


def available_now(source: DataFrame, run: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming plan over all that its source holds now, in micro-batches, and returns the result.

    source is a streaming DataFrame; its checkpoint folder has to be shared by all machines.
    """
    q = run(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return source.sparkSession.table(name)
