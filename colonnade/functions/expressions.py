"""Scalar building blocks on Columns, with the semantics of the fused expression grammar.

Plain ``&`` and ``|`` of Columns are three-valued (Kleene); ``and_`` and ``or_``
here give null if either side is null. Comparisons are IEEE: NaN equals nothing.
Integer division by zero is zero, float division follows IEEE, integers wrap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def wrap64(value: Column) -> Column:
    """A decimal brought into 64 bits as two's complement does."""
    half, whole = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(value.cast("decimal(38,0)") + half, whole) - half).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), wrap64(_wide(a) + _wide(b)))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a.cast("long"), b.cast("long")), wrap64(_wide(a) - _wide(b)))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a.cast("long"), b.cast("long")), wrap64(_wide(a) * _wide(b)))


def divide_int(a: Column, b: Column) -> Column:
    """Truncated division; by zero it gives 0."""
    wide, by = a.cast("decimal(19,0)"), F.nullif(b, F.lit(0)).cast("decimal(19,0)")
    exact = (wide - F.try_mod(wide, by)) / by
    return F.when(a.isNotNull() & (b == 0), F.lit(0).cast("long")).otherwise(wrap64(exact))


def divide(a: Column, b: Column) -> Column:
    """Float division by IEEE rules: x/0 is an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.when(b.cast("string") == "-0.0", F.lit(-1.0)).otherwise(F.lit(1.0))
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * INF * sign)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((b != 0) | F.isnan(b), F.try_divide(a, b)).otherwise(zero)


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def ne(a: Column, b: Column) -> Column:
    return (a != b) | (F.isnan(a) & F.isnan(b))


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(b)


def le(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(b)


def gt(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a)


def ge(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a)


def _strict(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def and_(a: Column, b: Column) -> Column:
    return _strict(a, b, a & b)


def or_(a: Column, b: Column) -> Column:
    return _strict(a, b, a | b)


def if_else(condition: Column, a: Column, b: Column) -> Column:
    """Null where the condition is null."""
    return F.when(condition.isNotNull(), F.when(condition, a).otherwise(b))


def is_in(a: Column, *values) -> Column:
    """Never null: a null is in no list."""
    return F.coalesce(a.isin(*values), F.lit(False))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n) if 0 <= n < 64 else F.when(a.isNotNull(), F.lit(0).cast("long"))


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a, n) if 0 <= n < 64 else F.when(a < 0, F.lit(-1).cast("long")).when(a >= 0, F.lit(0).cast("long"))


def signbit(a: Column) -> Column:
    return (a < 0) | (a.cast("string") == "-0.0")


def sqrt(a: Column) -> Column:
    return F.when(a < 0, F.lit(NAN)).otherwise(F.sqrt(a))


def ln(a: Column) -> Column:
    a = a.cast("double")
    return F.when(a > 0, F.ln(a)).when(a == 0, F.lit(-INF)).when(a.isNull(), F.lit(None).cast("double")).otherwise(F.lit(NAN))


def round_half_away(a: Column) -> Column:
    return F.when(F.abs(a) < 4.5e15, F.round(a)).otherwise(a)


def min_(a: Column) -> Column:
    return F.min(F.when(~F.isnan(a), a))


def max_(a: Column) -> Column:
    return F.max(F.when(~F.isnan(a), a))


#: Aggregates of the lazy engine: nulls are skipped; none left gives null; minima and maxima skip NaN.
AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_pop, "stddev": F.stddev_pop, "first": F.first, "last": F.last}


def aggregate(kind: str, value: str | Column | None, double: bool = False) -> Column:
    if value is None:
        return F.count(F.lit(1))
    column = F.col(value) if isinstance(value, str) else value
    if double and kind in ("min", "max"):
        return min_(column) if kind == "min" else max_(column)
    return AGGREGATES[kind](column)
