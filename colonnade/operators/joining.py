"""The six equi-joins, with names and keys as the lazy engine gives them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: A side is broadcast only where its size is known to stay under this.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's bound of a plan's output, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if the optimizer bounds its size by ``limit``; else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", right_on: Sequence[str] | str | None = None, suffix: str = "_right") -> DataFrame:
    """Null keys never match. Right keys are dropped; other clashing names get the suffix, then _right2 and so on.

    Right and full joins coalesce the keys.
    """
    if how not in KINDS:
        raise ValueError(f"how is one of {', '.join(KINDS)}")
    keys = [on] if isinstance(on, str) else list(on)
    others = keys if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    inner = right.select(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(others)], *[F.col(f"`{c}`").alias(f"__r{n}") for n, c in enumerate(right.columns)])
    condition = [F.col(f"`{k}`") == F.col(f"__k{n}") for n, k in enumerate(keys)]
    out = left.join(inner, condition, KINDS[how])
    if how in ("semi", "anti"):
        return out
    taken, columns = set(left.columns), []
    for c in left.columns:
        n = keys.index(c) if c in keys else None
        columns.append(F.coalesce(F.col(f"`{c}`"), F.col(f"__k{n}")).alias(c) if n is not None and how in ("right", "full") else F.col(f"`{c}`"))
    for n, c in enumerate(right.columns):
        if c in others:
            continue
        name, turn = c, 1
        while name in taken:
            name, turn = c + suffix + (str(turn) if turn > 1 else ""), turn + 1
        taken.add(name)
        columns.append(F.col(f"__r{n}").alias(name))
    return out.select(*columns)
