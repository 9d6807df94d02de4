"""Calls of catalogue functions by name, as Columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions.catalog import FUNCTIONS, Function
from colonnade.functions.options import with_options

ARGUMENTS = ("i", "j", "x", "y", "b", "c", "s", "p", "n", "ts", "ts2", "arr", "sarr", "m", "st", "q", "r", "pos")
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![.\w])[A-Za-z_]\w*(?!\s*\()")


def arguments(f: Function) -> list[str]:
    """The argument names of a function, in the order of the catalogue's list."""
    used = {t for t in _TOKEN.findall(f.spark) if t in ARGUMENTS}
    return [a for a in ARGUMENTS if a in used]


def expression(name: str, *args: str, by: str | None = None, options: dict[str, Any] | None = None, **named: str) -> str:
    """The Spark SQL of a call; args are SQL texts, in the order of ``arguments`` or by name; options as in ``OPTIONS``.

    ``by`` partitions a window function; without it all rows are one partition,
    which one task has to hold.
    """
    if name not in FUNCTIONS:
        raise KeyError(f"no function is named {name!r}")
    f = FUNCTIONS[name]
    wanted = arguments(f)
    if len(args) > len(wanted) or set(named) - set(wanted):
        raise TypeError(f"{name} takes {', '.join(wanted) or 'no arguments'}")
    to = dict(zip(wanted, args)) | named
    put = lambda m: f"({to[m[0]]})" if m[0] in to and not re.fullmatch(r"\w+", to[m[0]]) else to.get(m[0], m[0])
    text = _TOKEN.sub(put, with_options(name, f.spark, "spark", options or {}))
    if by:
        text = text.replace("OVER (ORDER", f"OVER (PARTITION BY {by} ORDER").replace("OVER ()", f"OVER (PARTITION BY {by})")
    return text


def call(name: str, *args: str, by: str | None = None, options: dict[str, Any] | None = None, **named: str) -> Column:
    return F.expr(expression(name, *args, by=by, options=options, **named))


def names(section: str | None = None) -> list[str]:
    return [k for k, f in FUNCTIONS.items() if section in (None, f.section)]
