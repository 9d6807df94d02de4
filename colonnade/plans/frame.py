"""The lazy frame: a thin, checked layer of relational operators over a DataFrame.

Nothing runs before ``collect``, ``to_arrow`` or a write; Catalyst plans all of
it. Rows have no order of their own: operators that depend on one take ``order``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from colonnade.functions import expressions as E
from colonnade.operators.asof import join_asof
from colonnade.operators.joining import join
from colonnade.operators.ordering import keep_first, sort_keys

Expr = Column | str
FLOATS = ("double", "float")
WINDOWS = ("row_number", "rank", "dense_rank", "lag", "lead", "cum_sum", "rolling_sum", "rolling_mean", "rolling_min", "rolling_max", "sum", "min", "max", "mean", "count")


def _column(e: Expr) -> Column:
    return F.col(f"`{e}`") if isinstance(e, str) else e


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _is_float(self, name: str) -> bool:
        return dict(self.df.dtypes).get(name) in FLOATS

    def filter(self, condition: Expr) -> Frame:
        return Frame(self.df.where(condition))

    def select(self, *items: Expr | tuple[str, Expr]) -> Frame:
        return Frame(self.df.select(*[_column(i[1]).alias(i[0]) if isinstance(i, tuple) else _column(i) for i in items]))

    def with_columns(self, **items: Expr) -> Frame:
        return Frame(self.df.withColumns({k: _column(v) for k, v in items.items()}))

    def drop(self, *names: str) -> Frame:
        self._known(names)
        return Frame(self.df.drop(*names))

    def rename(self, names: Mapping[str, str]) -> Frame:
        self._known(names)
        return Frame(self.df.withColumnsRenamed(dict(names)))

    def _known(self, names) -> None:
        if missing := set(names) - set(self.columns):
            raise KeyError(f"unknown columns: {', '.join(sorted(missing))}")

    def _aggregates(self, items: Mapping[str, tuple[str, str | None]]) -> list[Column]:
        return [E.aggregate(kind, value, isinstance(value, str) and self._is_float(value)).alias(name) for name, (kind, value) in items.items()]

    def agg(self, **items: tuple[str, str | None]) -> Frame:
        """name=(kind, column); one row, on empty input too."""
        return Frame(self.df.agg(*self._aggregates(items)))

    def group_by(self, *keys: Expr | tuple[str, Expr]) -> Groups:
        return Groups(self, [_column(k[1]).alias(k[0]) if isinstance(k, tuple) else _column(k) for k in keys])

    def sort(self, *by: str, descending: bool | Sequence[bool] = False, nulls: str | Sequence[str] = "last", float_order: str = "ieee", ties: Sequence[str] = ()) -> Frame:
        self._known(by)
        each = lambda v: [v] * len(by) if isinstance(v, (bool, str)) else list(v)
        keys = [k for c, d, n in zip(by, each(descending), each(nulls)) for k in sort_keys(c, d, n, float_order, self._is_float(c))]
        return Frame(self.df.orderBy(*keys, *ties))

    def limit(self, n: int, offset: int = 0) -> Frame:
        return Frame(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    def slice(self, offset: int, length: int, order: Sequence[str]) -> Frame:
        return Frame(self.df.orderBy(*order).offset(offset).limit(length))

    def unique(self, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> Frame:
        return Frame(keep_first(self.df, subset, order))

    def join(self, other: Frame, on: Sequence[str] | str, how: str = "inner", right_on: Sequence[str] | str | None = None, suffix: str = "_right") -> Frame:
        return Frame(join(self.df, other.df, on, how, right_on, suffix))

    def join_asof(self, other: Frame, on: str, by: Sequence[str] = (), strategy: str = "backward", tolerance: object = None) -> Frame:
        return Frame(join_asof(self.df, other.df, on, by, strategy, tolerance))

    def window(self, partition_by: Sequence[str], order_by: Sequence[str], **items: tuple) -> Frame:
        """name=(function, column, n): see WINDOWS. Nulls sort last; frames are trailing rows or the whole partition."""
        keys = [k for c in order_by for k in sort_keys(c, is_float=self._is_float(c))]
        whole = W.partitionBy(*partition_by)
        ordered = whole.orderBy(*keys) if keys else whole
        return Frame(self.df.withColumns({name: self._window(whole, ordered, *spec) for name, spec in items.items()}))

    def _window(self, whole: W, ordered: W, kind: str, column: str | None = None, n: int = 1) -> Column:
        if kind not in WINDOWS:
            raise ValueError(f"a window function is one of {', '.join(WINDOWS)}")
        if kind in ("row_number", "rank", "dense_rank"):
            return getattr(F, kind)().over(ordered).cast("long")
        if kind in ("lag", "lead"):
            return getattr(F, kind)(column, n).over(ordered)
        if kind == "cum_sum":
            return F.when(_column(column).isNotNull(), F.sum(column).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        if kind.startswith("rolling_"):
            frame = ordered.rowsBetween(-(n - 1), 0)
            value = E.aggregate(kind[8:], column, self._is_float(column))
            return F.when(F.count(column).over(frame) >= n, value.over(frame))
        if column is not None and self._is_float(column) and kind in ("min", "max"):
            return (F.min if kind == "min" else F.max)(F.when(~F.isnan(column), _column(column))).over(whole)
        return E.aggregate(kind, column).over(whole)

    def explode(self, column: str) -> Frame:
        """A null or empty list gives one row of null."""
        self._known([column])
        return Frame(self.df.withColumn(column, F.explode_outer(_column(column))))

    def collect(self) -> list:
        return self.df.collect()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class Groups:
    """Groups of a frame: null is a group, all NaN are one, and -0.0 is 0.0."""

    def __init__(self, frame: Frame, keys: list[Column]):
        self.frame, self.keys = frame, keys

    def agg(self, **items: tuple[str, str | None]) -> Frame:
        return Frame(self.frame.df.groupBy(*self.keys).agg(*self.frame._aggregates(items)))

    def count(self) -> Frame:
        return Frame(self.frame.df.groupBy(*self.keys).count())


def concat(frames: Sequence[Frame]) -> Frame:
    """Rows of all frames; their names must agree, in order."""
    first = frames[0]
    out = first.df
    for f in frames[1:]:
        if f.columns != first.columns:
            raise ValueError("frames to concat have the same columns, in the same order")
        out = out.union(f.df)
    return Frame(out)


def scan(spark: SparkSession, source: DataFrame | pa.Table | dict | str, columns: Sequence[str] | None = None) -> Frame:
    """A frame of a DataFrame, an Arrow table, a dict of columns, a Parquet path or a view's name."""
    if isinstance(source, pa.Table):
        df = spark.createDataFrame(source)
    elif isinstance(source, dict):
        df = spark.createDataFrame(pa.table(source))
    elif isinstance(source, str):
        df = spark.read.parquet(source) if "/" in source else spark.table(source)
    else:
        df = source
    return Frame(df.select(*columns) if columns else df)


def query(df: DataFrame, where: Expr | None = None, dense_key: str | None = None, k: int = 0, **aggregates: tuple[str, str | None]) -> DataFrame:
    """One fused filter and aggregation. With a dense key, keys outside 0..k-1 are skipped and k rows come out."""
    f = Frame(df if where is None else df.where(where))
    if dense_key is None:
        return f.agg(**aggregates).df
    inside = Frame(f.df.where(F.col(dense_key).between(0, k - 1)))
    got = inside.group_by(dense_key).agg(**aggregates).df
    keys = df.sparkSession.range(k).select(F.col("id").cast(df.schema[dense_key].dataType).alias(dense_key))
    out = keys.join(got, dense_key, "left")
    counts = [name for name, (kind, _) in aggregates.items() if kind == "count"]
    return out.fillna(0, counts) if counts else out
