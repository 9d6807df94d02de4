"""Options of the catalogue's functions.

An option names the pieces of a function's expression that hold its default. A
call with another value puts that value there, in Spark's text or in that of
DuckDB, which the tests compare with. Values are Python's: texts, numbers, lists
of numbers, or one of the named choices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from colonnade.functions.catalog import FUNCTIONS

Render = Callable[[Any], str]


@dataclass(frozen=True)
class Option:
    default: Any
    #: pieces of the Spark and the DuckDB text, as functions of the value
    spark: tuple[Render, ...]
    duckdb: tuple[Render, ...]
    #: another value, which tests use
    other: Any

    def put(self, text: str, value: Any, dialect: str) -> str:
        for piece in self.spark if dialect == "spark" else self.duckdb:
            old, new = piece(self.default), piece(value)
            if old not in text:
                raise ValueError(f"{old!r} isn't part of {text!r}")
            text = text.replace(old, new)
        return text


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def duck_quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text(default: str, other: str) -> Option:
    return Option(default, (quoted,), (duck_quoted,), other)


def number(default: Any, other: Any, spark: str = "{}", duckdb: str | None = None) -> Option:
    return Option(default, (lambda v: spark.format(v),), (lambda v: (duckdb or spark).format(v),), other)


def choice(default: str, other: str, named: dict[str, tuple[str, str]]) -> Option:
    return Option(default, (lambda v: named[v][0],), (lambda v: named[v][1],), other)


def _listed(values: list, suffix: str) -> str:
    return ", ".join(f"{v}{suffix}" for v in values)


_QUOTE = lambda v: f"'\\\\Q{v}\\\\E'"
_PLAIN = Option("l", (_QUOTE,), (duck_quoted,), "o")
_DDOF = lambda f: {"ddof": choice("0", "1", {"0": (f"{f}_pop(i)", f"{f}_pop(i)"), "1": (f"{f}_samp(i)", f"{f}_samp(i)")})}
_FORMATS = {"seconds": ("'yyyy-MM-dd HH:mm:ss'", "'%Y-%m-%d %H:%M:%S'"), "days": ("'yyyy-MM-dd'", "'%Y-%m-%d'"), "hours": ("'yyyy/MM/dd HH'", "'%Y/%m/%d %H'")}
_UNITS = {u: (f"'{u.upper()}'", f"'{u}'") for u in ("second", "minute", "hour", "day", "month", "quarter", "year")}
_TYPES = {"string": ("AS STRING", "AS VARCHAR"), "double": ("AS DOUBLE", "AS DOUBLE"), "int": ("AS INT", "AS INTEGER")}
_MULTIPLE = number(900_000_000, 7_200_000_000, "{}")
_ROLLING = {"window": Option(5, (lambda v: f"{v - 1} PRECEDING",), (lambda v: f"{v - 1} PRECEDING",), 3), "min_periods": number(3, 1, ">= {} THEN")}
_PAD = {"width": number(8, 12), "padding": text("*", "#")}
_ZONE = Option("Asia/Tokyo", (quoted,), (), "Europe/Berlin")

OPTIONS: dict[str, dict[str, Option]] = {
    "quantile": {"q": number(0.25, 0.9, "(i, {})")},
    "hash_quantile": {"q": number(0.9, 0.5, "(i, {})")},
    "tdigest": {"q": number(0.5, 0.9, "(i, {},")},
    "hash_tdigest": {"q": number(0.5, 0.9, "(i, {},")},
    "stddev": _DDOF("stddev"), "hash_stddev": _DDOF("stddev"), "variance": _DDOF("var"), "hash_variance": _DDOF("var"),
    "index": {"value": number(3, 11, "i = {} ")},
    "starts_with": {"pattern": text("H", "hel")}, "ends_with": {"pattern": text("d", "o")}, "match_substring": {"pattern": text("l", "an")},
    "match_like": {"pattern": text("H%_d", "%l_o%")}, "count_substring": {"pattern": _PLAIN}, "find_substring": {"pattern": text("l", "o")},
    "match_substring_regex": {"pattern": text("l+", "[0-9]")}, "count_substring_regex": {"pattern": text("l+", "[aeo]")}, "find_substring_regex": {"pattern": text("l+", "[aeo]")},
    "is_in": {"value_set": Option([1, 2, 3], (lambda v: f"IN ({_listed(v, '')})",), (lambda v: f"IN ({_listed(v, '')})",), [7, -50])},
    "index_in": {"value_set": Option([1, 2, 3], (lambda v: f"array({_listed(v, 'L')})",), (lambda v: f"[{_listed(v, '')}]",), [7, 5])},
    "split_pattern": {"pattern": _PLAIN}, "split_pattern_regex": {"pattern": text("l+", "[aeo]+")},
    "replace_substring": {"pattern": text("a", "l"), "replacement": text("b", "--")}, "replace_substring_regex": {"pattern": text("l+", "[aeo]"), "replacement": text("b", "__")},
    "binary_repeat": {"repeats": number(3, 2, "s, {}")},
    **{k: _PAD for k in ("ascii_lpad", "ascii_rpad", "utf8_lpad", "utf8_rpad", "ascii_center", "utf8_center")},
    **{f"{k}_{d}trim": {"characters": text("Hd ", "ol")} for k in ("ascii", "utf8") for d in ("", "l", "r")},
    "binary_join": {"separator": text("-", "+")}, "binary_join_element_wise": {"separator": text("-", "+")}, "str_concat": {"separator": text("-", "+")},
    "utf8_slice_codeunits": {"start": number(2, 3, "(s, {},"), "length": number(3, 1, " {})")},
    "list_element": {"index": Option(0, (lambda v: f"get(arr, {v})",), (lambda v: f"arr[{v + 1}]",), 2)},
    "struct_field": {"field": choice("a", "b", {"a": ("st.a", "st.a"), "b": ("st.b", "st.b")})}, "map_lookup": {"key": text("k", "z")},
    "round_to_multiple": {"multiple": number(0.25, 0.5, "{}D", "{}")},
    "strftime": {"format": choice("seconds", "days", _FORMATS)},
    "floor_temporal": {"unit": choice("hour", "month", _UNITS)}, "cast_unit": {"unit": choice("second", "minute", _UNITS)},
    "ceil_temporal": {"microseconds": _MULTIPLE}, "round_temporal": {"microseconds": _MULTIPLE},
    "assume_timezone": {"timezone": _ZONE}, "local_timestamp": {"timezone": _ZONE}, "utc_offset": {"timezone": _ZONE},
    "partition_nth_indices": {"pivot": number(5, 9, "<= {}")}, "shift": {"by": number(2, 4, "i, {},"), "fill": number(0, -1, ", {})")},
    **{f"rolling_{k}": _ROLLING for k in ("sum", "mean", "min", "max")},
    "pairwise_diff": {"period": number(1, 3, "i, {})")}, "pairwise_diff_checked": {"period": number(1, 3, "i, {})")},
    "cast": {"to_type": choice("string", "double", _TYPES)}, "fill_null": {"value": Option(0, (lambda v: f"x, {v}D)",), (lambda v: f"x, {v})",), 7)},
}


def with_options(name: str, sql: str, dialect: str, options: dict[str, Any]) -> str:
    """A function's text with other values of its options."""
    known = OPTIONS.get(name, {})
    for k, value in options.items():
        if k not in known:
            raise TypeError(f"{name} has no option {k!r}; it has {', '.join(known) or 'none'}")
        sql = known[k].put(sql, value, dialect)
    return sql


def others(name: str) -> dict[str, Any]:
    """Other values of all of a function's options."""
    return {k: o.other for k, o in OPTIONS.get(name, {}).items()}


assert set(OPTIONS) <= set(FUNCTIONS)
