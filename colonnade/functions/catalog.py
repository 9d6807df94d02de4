"""The catalogue of named column functions.

Each entry holds a Spark SQL expression over the argument names

    i j  bigint    x y  double    b c  boolean    s p  string    n  int
    ts ts2  timestamp    arr  array<bigint>    sarr  array<string>
    m  map<string,bigint>    st  struct<a,b>    pos  the row's position

and, for the tests, the same value in DuckDB SQL over the same names. A call
puts its own columns in the place of the names that the expression uses.
Semantics are Arrow's: unchecked integers wrap, checked ones raise, float
comparisons are IEEE, aggregates skip nulls, minima and maxima skip NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

NAN, INF = "double('NaN')", "double('Infinity')"
D_NAN, D_INF = "'NaN'::DOUBLE", "'Infinity'::DOUBLE"
WS = r"\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x85"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Function:
    name: str
    section: str
    spark: str
    duckdb: str | None
    kind: str = "scalar"  # or "agg", "window"
    double: bool = False  # tests compare to nine places


FUNCTIONS: dict[str, Function] = {}


def _add(section: str, kind: str, *rows: tuple) -> None:
    for name, spark, duckdb, *rest in rows:
        FUNCTIONS[name] = Function(name, section, spark, spark if duckdb == "=" else duckdb, kind, bool(rest and rest[0] == "d"))


def _both(a: str, b: str, then: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {then} END"


def _wrap(value: str) -> str:
    """A decimal brought back into 64 bits, as two's complement does."""
    return f"CAST(pmod({value} + 9223372036854775808BD, 18446744073709551616BD) - 9223372036854775808BD AS BIGINT)"


def _unchecked(fn: str, op: str) -> str:
    wide = f"(CAST(i AS DECIMAL(19,0)) {op} CAST(j AS DECIMAL(19,0)))"
    return f"coalesce({fn}(i, j), {_wrap(wide)})"


def _raise(kind: str, message: str) -> str:
    return f"CAST(raise_error('{message}') AS {kind})"


def _checked(fn: str) -> str:
    return _both("i", "j", f"coalesce({fn}(i, j), {_raise('BIGINT', 'overflow')})")


_FLOAT_DIV = f"CASE WHEN y <> 0 OR isnan(y) THEN x / y WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) OR x = 0 THEN {NAN} ELSE signum(x) * {INF} * CASE WHEN CAST(y AS STRING) = '-0.0' THEN -1 ELSE 1 END END"
_FLOORED = "CASE WHEN j = 0 THEN NULL ELSE ((i % j) + j) % j END"
_MIN, _MAX = "min(CASE WHEN NOT isnan(x) THEN x END)", "max(CASE WHEN NOT isnan(x) THEN x END)"
_FIRST, _LAST = "min_by(x, pos) FILTER (WHERE x IS NOT NULL)", "max_by(x, pos) FILTER (WHERE x IS NOT NULL)"
_D_FIRST, _D_LAST = "arg_min(x, pos) FILTER (WHERE x IS NOT NULL)", "arg_max(x, pos) FILTER (WHERE x IS NOT NULL)"

_AGGREGATES = [
    ("all", "bool_and(b)", "="),
    ("any", "bool_or(b)", "="),
    ("approximate_median", "percentile(x, 0.5)", "quantile_cont(x, 0.5)", "d"),
    ("count", "count(x)", "="),
    ("count_all", "count(*)", "="),
    ("count_distinct", "count(DISTINCT i)", "="),
    ("first", _FIRST, _D_FIRST, "d"),
    ("last", _LAST, _D_LAST, "d"),
    ("kurtosis", "kurtosis(i)", "kurtosis_pop(i)", "d"),
    ("max", _MAX, "max(x) FILTER (WHERE NOT isnan(x))", "d"),
    ("mean", "avg(i)", "avg(i)", "d"),
    ("min", _MIN, "min(x) FILTER (WHERE NOT isnan(x))", "d"),
    ("product", f"reduce(collect_list(n), 1L, (a, v) -> {_wrap('(CAST(a AS DECIMAL(19,0)) * CAST(v AS DECIMAL(19,0)))')})", None),
    ("quantile", "percentile(i, 0.25)", "quantile_cont(i, 0.25)", "d"),
    ("skew", "skewness(i)", "CASE WHEN var_pop(i) > 0 THEN (sum(i*i*i)/count(i) - 3*avg(i)*sum(i*i)/count(i) + 2*avg(i)^3) / var_pop(i)^1.5 END", "d"),
    ("stddev", "stddev_pop(i)", "=", "d"),
    ("sum", "sum(i)", "CAST(sum(i) AS BIGINT)"),
    ("tdigest", "percentile_approx(i, 0.5, 10000)", None),
    ("variance", "var_pop(i)", "=", "d"),
]
_add("aggregations", "agg", *_AGGREGATES)
_add(
    "aggregations", "agg",
    ("first_last", f"named_struct('first', {_FIRST}, 'last', {_LAST})", None),
    ("index", "coalesce(min(CASE WHEN i = 3 THEN pos END), -1)", "="),
    ("min_max", f"named_struct('min', {_MIN}, 'max', {_MAX})", None),
    ("mode", "mode(i, true)", None),
    ("pivot_wider", "named_struct('a', min(CASE WHEN s = 'a' THEN i END), 'b', min(CASE WHEN s = 'b' THEN i END))", None),
)
_add("grouped", "agg", *((f"hash_{n}", *rest) for n, *rest in _AGGREGATES if n not in ("quantile",)))
_add(
    "grouped", "agg",
    ("hash_min_max", FUNCTIONS["min_max"].spark, None), ("hash_first_last", FUNCTIONS["first_last"].spark, None),
    ("hash_distinct", "array_sort(collect_set(n))", "list_sort(list(DISTINCT n) FILTER (WHERE n IS NOT NULL))"),
    ("hash_list", "transform(array_sort(collect_list(struct(pos, i))), e -> e.i)", "list(i ORDER BY pos)"),
    ("hash_one", "min_by(i, pos)", "arg_min_null(i, pos)"),
    ("hash_pivot_wider", FUNCTIONS["pivot_wider"].spark, None),
    ("hash_quantile", "percentile(i, 0.9)", "quantile_cont(i, 0.9)", "d"),
)

_add(
    "arithmetic", "scalar",
    ("abs", "CASE WHEN i = -9223372036854775807L - 1 THEN i ELSE abs(i) END", "abs(i)"),
    ("add", _unchecked("try_add", "+"), "i + j"),
    ("subtract", _unchecked("try_subtract", "-"), "i - j"),
    ("multiply", _unchecked("try_multiply", "*"), "i * j"),
    ("divide", "CASE WHEN i IS NULL THEN NULL WHEN j = 0 THEN 0L WHEN j = -1 THEN " + _wrap("(-CAST(i AS DECIMAL(19,0)))") + " ELSE i div j END", "CASE WHEN j = 0 AND i IS NOT NULL THEN 0 ELSE i // j END"),
    ("divide_float", _FLOAT_DIV, f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y <> 0 THEN x / y WHEN isnan(x) OR x = 0 THEN {D_NAN} ELSE sign(x) * {D_INF} END", "d"),
    ("exp", "exp(y)", "=", "d"),
    ("negate", _wrap("(-CAST(i AS DECIMAL(19,0)))"), "-i"),
    ("power", "power(x, y)", f"CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE pow(x, y) END", "d"),
    ("sign", "signum(x)", f"CASE WHEN isnan(x) THEN {D_NAN} ELSE sign(x) END", "d"),
    ("sqrt", "sqrt(x)", f"CASE WHEN x < 0 THEN {D_NAN} ELSE sqrt(x) END", "d"),
    ("abs_checked", f"CASE WHEN i = -9223372036854775807L - 1 THEN {_raise('BIGINT', 'overflow')} ELSE abs(i) END", "abs(i)"),
    ("add_checked", _checked("try_add"), "i + j"),
    ("subtract_checked", _checked("try_subtract"), "i - j"),
    ("multiply_checked", _checked("try_multiply"), "i * j"),
    ("divide_checked", f"CASE WHEN j = 0 THEN {_raise('BIGINT', 'divide by zero')} ELSE i div j END", "i // nullif(j, 0)"),
    ("remainder", "CASE WHEN i IS NOT NULL THEN CASE WHEN j = 0 THEN 0L ELSE i % j END END", "CASE WHEN j = 0 AND i IS NOT NULL THEN 0 ELSE i % j END"),
    ("remainder_checked", f"CASE WHEN j = 0 THEN {_raise('BIGINT', 'divide by zero')} ELSE i % j END", "i % nullif(j, 0)"),
    ("modulo", _FLOORED, "((i % nullif(j, 0)) + j) % nullif(j, 0)"),
    ("modulo_checked", f"CASE WHEN j = 0 THEN {_raise('BIGINT', 'divide by zero')} ELSE ((i % j) + j) % j END", "((i % nullif(j, 0)) + j) % nullif(j, 0)"),
    ("negate_checked", f"CASE WHEN i = -9223372036854775807L - 1 THEN {_raise('BIGINT', 'overflow')} ELSE -i END", "-i"),
    ("power_checked", f"CASE WHEN i IS NULL OR n IS NULL THEN NULL WHEN n < 0 THEN {_raise('BIGINT', 'integers to negative integer powers are not allowed')} WHEN i IN (0, 1) THEN if(n = 0, 1L, i) WHEN i = -1 THEN if(n % 2 = 0, 1L, -1L) WHEN n > 63 THEN {_raise('BIGINT', 'overflow')} ELSE reduce(array_repeat(i, n), 1L, (a, v) -> coalesce(try_multiply(a, v), {_raise('BIGINT', 'overflow')})) END", None),
    ("sqrt_checked", f"CASE WHEN x < 0 THEN {_raise('DOUBLE', 'square root of negative number')} ELSE sqrt(x) END", "sqrt(x)", "d"),
    ("expm1", "expm1(y)", "exp(y) - 1", "d"),
    ("hypot", "hypot(x, y)", f"CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE sqrt(x * x + y * y) END", "d"),
    ("bit_wise_and", "i & j", "="),
    ("bit_wise_not", "~i", "="),
    ("bit_wise_or", "i | j", "="),
    ("bit_wise_xor", "i ^ j", "xor(i, j)"),
    ("shift_left", "CASE WHEN n BETWEEN 0 AND 63 THEN shiftleft(i, n) WHEN n IS NOT NULL AND i IS NOT NULL THEN 0L END", None),
    ("shift_right", "CASE WHEN n BETWEEN 0 AND 63 THEN shiftright(i, n) WHEN n IS NULL OR i IS NULL THEN NULL WHEN i < 0 THEN -1L ELSE 0L END", "CASE WHEN n BETWEEN 0 AND 63 THEN CAST(floor(i / pow(2::DOUBLE, n)) AS BIGINT) WHEN n IS NULL OR i IS NULL THEN NULL WHEN i < 0 THEN -1 ELSE 0 END"),
    ("shift_left_checked", f"CASE WHEN n BETWEEN 0 AND 62 THEN shiftleft(i, n) WHEN n IS NOT NULL THEN {_raise('BIGINT', 'shift amount must be >= 0 and less than precision of type')} END", None),
    ("shift_right_checked", f"CASE WHEN n BETWEEN 0 AND 62 THEN shiftright(i, n) WHEN n IS NOT NULL THEN {_raise('BIGINT', 'shift amount must be >= 0 and less than precision of type')} END", None),
)

_big = "CASE WHEN abs(x) < 4.5e15D THEN CAST({} AS DOUBLE) ELSE x END"
_add(
    "rounding", "scalar",
    ("ceil", _big.format("ceil(x)"), "ceil(x)", "d"),
    ("floor", _big.format("floor(x)"), "floor(x)", "d"),
    ("trunc", _big.format("CASE WHEN x < 0 THEN ceil(x) ELSE floor(x) END"), "trunc(x)", "d"),
    ("round", _big.format("bround(x, 0)"), "round_even(x, 0)", "d"),
    ("round_binary", "bround(x * power(10D, n % 3)) / power(10D, n % 3)", "round_even(x * pow(10::DOUBLE, n % 3), 0) / pow(10::DOUBLE, n % 3)", "d"),
    ("round_to_multiple", "bround(x / 0.25D) * 0.25D", "round_even(x / 0.25, 0) * 0.25", "d"),
)

_ln = "CASE WHEN x > 0 THEN {f}(x) WHEN x = 0 THEN -{inf} WHEN x IS NULL THEN NULL ELSE {nan} END"
_lnc = "CASE WHEN x = 0 THEN {z} WHEN x < 0 THEN {m} ELSE {f}(x) END"
_zero, _neg = _raise("DOUBLE", "logarithm of zero"), _raise("DOUBLE", "logarithm of negative number")
_add(
    "logarithms", "scalar",
    *((f, _ln.format(f=f, inf=INF, nan=NAN), _ln.format(f=f if f != "log10" else "log10", inf=D_INF, nan=D_NAN).replace("x > 0", "x > 0 AND NOT isnan(x)"), "d") for f in ("ln", "log10", "log2")),
    *((f + "_checked", _lnc.format(f=f, z=_zero, m=_neg), f"{f}(x)", "d") for f in ("ln", "log10", "log2")),
    ("log1p", f"CASE WHEN x > -1 THEN log1p(x) WHEN x = -1 THEN -{INF} WHEN x IS NULL THEN NULL ELSE {NAN} END", f"CASE WHEN x > -1 AND NOT isnan(x) THEN ln(1 + x) WHEN x = -1 THEN -{D_INF} WHEN x IS NULL THEN NULL ELSE {D_NAN} END", "d"),
    ("log1p_checked", f"CASE WHEN x = -1 THEN {_zero} WHEN x < -1 THEN {_neg} ELSE log1p(x) END", "ln(1 + x)", "d"),
    ("logb", f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x > 0 AND y > 0 AND y <> 1 THEN ln(x) / ln(y) WHEN x = 0 AND y > 0 AND y <> 1 THEN -signum(ln(y)) * {INF} WHEN y = 1 AND x > 0 AND x <> 1 THEN signum(x - 1) * {INF} WHEN y = 0 AND x > 0 AND x < {INF} THEN 0D * signum(1 - x) ELSE {NAN} END",
     f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) OR isnan(y) THEN {D_NAN} WHEN x > 0 AND y > 0 AND y <> 1 THEN ln(x) / ln(y) WHEN x = 0 AND y > 0 AND y <> 1 THEN -sign(ln(y)) * {D_INF} WHEN y = 1 AND x > 0 AND x <> 1 THEN sign(x - 1) * {D_INF} WHEN y = 0 AND x > 0 AND x < {D_INF} THEN 0 * sign(1 - x) ELSE {D_NAN} END", "d"),
    ("logb_checked", f"CASE WHEN x = 0 OR y = 0 THEN {_zero} WHEN x < 0 OR y < 0 THEN {_neg} ELSE ln(x) / ln(y) END", "ln(x) / ln(y)", "d"),
)

_domain = _raise("DOUBLE", "domain error")
_outside = {"acos": "abs(x) > 1", "asin": "abs(x) > 1", "acosh": "x < 1", "atanh": "abs(x) >= 1", "cos": f"abs(x) = {INF}", "sin": f"abs(x) = {INF}", "tan": f"abs(x) = {INF}"}
_duck_trig = {"acos": f"CASE WHEN abs(x) > 1 THEN {D_NAN} ELSE acos(x) END", "asin": f"CASE WHEN abs(x) > 1 THEN {D_NAN} ELSE asin(x) END", "acosh": f"CASE WHEN x < 1 THEN {D_NAN} ELSE acosh(x) END", "atanh": f"CASE WHEN abs(x) > 1 THEN {D_NAN} WHEN abs(x) = 1 THEN sign(x) * {D_INF} ELSE atanh(x) END"}
_add(
    "trigonometry", "scalar",
    *((f, f"{f}(x)", _duck_trig.get(f, f"{f}(x)"), "d") for f in ("acos", "acosh", "asin", "asinh", "atan", "atanh", "cos", "cosh", "sin", "sinh", "tan", "tanh")),
    *((f + "_checked", f"CASE WHEN {d} AND NOT isnan(x) THEN {_domain} ELSE {f}(x) END", f"{f}(x)", "d") for f, d in _outside.items()),
    ("atan2", "atan2(x, y)", "=", "d"),
)

_add(
    "comparisons", "scalar",
    ("equal", "x = y AND NOT isnan(x)", "x = y AND NOT isnan(x)"),
    ("greater", "x > y AND NOT isnan(x)", "x > y AND NOT isnan(x)"),
    ("greater_equal", "x >= y AND NOT isnan(x)", "x >= y AND NOT isnan(x)"),
    ("less", "x < y AND NOT isnan(y)", "x < y AND NOT isnan(y)"),
    ("less_equal", "x <= y AND NOT isnan(y)", "x <= y AND NOT isnan(y)"),
    ("not_equal", "x <> y OR (isnan(x) AND isnan(y))", "x <> y OR (isnan(x) AND isnan(y))"),
    ("max_element_wise", "greatest(nanvl(x, NULL), nanvl(y, NULL))", "greatest(CASE WHEN NOT isnan(x) THEN x END, CASE WHEN NOT isnan(y) THEN y END)", "d"),
    ("min_element_wise", "least(nanvl(x, NULL), nanvl(y, NULL))", "least(CASE WHEN NOT isnan(x) THEN x END, CASE WHEN NOT isnan(y) THEN y END)", "d"),
    ("str_equals", "s = p", "="),
)
_strict = "CASE WHEN b IS NULL OR c IS NULL THEN NULL ELSE {} END"
_add(
    "logical", "scalar",
    ("and_", _strict.format("b AND c"), "="), ("or_", _strict.format("b OR c"), "="), ("invert", "NOT b", "="), ("and_kleene", "b AND c", "="), ("or_kleene", "b OR c", "="),
    ("and_not", _strict.format("b AND NOT c"), "="), ("and_not_kleene", "b AND NOT c", "="), ("xor", "b <> c", "="),
)

_is = {
    "ascii_is_alnum": r"^[A-Za-z0-9]+$", "ascii_is_alpha": r"^[A-Za-z]+$", "ascii_is_decimal": r"^[0-9]+$", "ascii_is_space": r"^[ \t-\r]+$", "ascii_is_printable": r"^[ -~]*$",
    "utf8_is_alnum": r"^[\p{L}\p{N}]+$", "utf8_is_alpha": r"^\p{L}+$", "utf8_is_decimal": r"^\p{Nd}+$", "utf8_is_digit": r"^[\p{Nd}\p{No}]+$", "utf8_is_numeric": r"^\p{N}+$",
    "utf8_is_printable": r"^(?: |[^\p{C}\p{Z}])*$", "utf8_is_space": r"^[\p{Z}\x09-\x0D\x1C-\x1F]+$",
}
_rx = lambda r: r.replace("\\", "\\\\").replace("^", "\\\\A", 1) if r.startswith("^") else r.replace("\\", "\\\\")
_whole = lambda r: _rx(r)[:-1] + "\\\\z" if r.endswith("$") else _rx(r)
_rl = lambda r: f"rlike(s, '{_whole(r)}')"
_rm = lambda r: f"regexp_matches(s, '{r}')"
_cased = {"ascii_is_lower": (r"[a-z]", r"[A-Z]"), "ascii_is_upper": (r"[A-Z]", r"[a-z]"), "utf8_is_lower": (r"\p{Ll}", r"[\p{Lu}\p{Lt}]"), "utf8_is_upper": (r"\p{Lu}", r"[\p{Ll}\p{Lt}]")}
_title = {"ascii_is_title": (r"[A-Za-z]", r"^[^A-Za-z]*(?:[A-Z][a-z]*(?:[^A-Za-z]+|$))*$"), "utf8_is_title": (r"\p{L}", r"^\P{L}*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:\P{L}+|$))*$")}
_add(
    "string predicates", "scalar",
    *((k, _rl(r), _rm(r)) for k, r in _is.items()),
    *((k, f"{_rl(a)} AND NOT {_rl(z)}", f"{_rm(a)} AND NOT {_rm(z)}") for k, (a, z) in _cased.items()),
    *((k, f"{_rl(a)} AND {_rl(z)}", f"{_rm(a)} AND {_rm(z)}") for k, (a, z) in _title.items()),
    ("string_is_ascii", "octet_length(s) = char_length(s)", "strlen(s) = length(s)"),
)
_add(
    "string transforms", "scalar",
    ("ascii_capitalize", f"concat(translate(left(s, 1), '{LOW}', '{UP}'), translate(substr(s, 2), '{UP}', '{LOW}'))", f"translate(left(s, 1), '{LOW}', '{UP}') || translate(substr(s, 2), '{UP}', '{LOW}')"),
    ("ascii_lower", f"translate(s, '{UP}', '{LOW}')", "="), ("ascii_upper", f"translate(s, '{LOW}', '{UP}')", "="),
    ("ascii_swapcase", f"translate(s, '{UP}{LOW}', '{LOW}{UP}')", "="),
    ("ascii_reverse", f"CASE WHEN octet_length(s) <> char_length(s) THEN {_raise('STRING', 'non-ASCII sequence in input')} ELSE reverse(s) END", "reverse(s)"),
    ("utf8_reverse", "reverse(s)", None),
    ("binary_reverse", "unhex(array_join(reverse(regexp_extract_all(hex(s), '(..)', 1)), ''))", None),
    ("binary_length", "octet_length(s)", "CAST(strlen(s) AS INTEGER)"), ("utf8_length", "char_length(s)", "CAST(length(s) AS INTEGER)"),
    ("binary_repeat", "repeat(s, 3)", "="), ("replace_substring", "replace(s, 'a', 'b')", "="),
    ("replace_substring_regex", "regexp_replace(s, 'l+', 'b')", "regexp_replace(s, 'l+', 'b', 'g')"),
    ("utf8_lower", "lower(s)", "="), ("utf8_upper", "upper(s)", None),
    ("utf8_swapcase", "array_join(transform(split(s, ''), ch -> CASE WHEN ch = upper(ch) THEN lower(ch) ELSE upper(ch) END), '')", None),
    ("ascii_title", r"array_join(transform(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+', 0), w -> CASE WHEN rlike(w, '\\A[A-Za-z]') THEN concat(upper(left(w, 1)), lower(substr(w, 2))) ELSE w END), '')", r"coalesce(array_to_string(list_transform(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+'), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), ''), CASE WHEN s IS NOT NULL THEN '' END)"),
    ("utf8_capitalize", "concat(upper(left(s, 1)), lower(substr(s, 2)))", "upper(left(s, 1)) || lower(substr(s, 2))"),
    ("utf8_title", r"array_join(transform(regexp_extract_all(s, '\\p{L}+|\\P{L}+', 0), w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), '')", r"coalesce(array_to_string(list_transform(regexp_extract_all(s, '\p{L}+|\P{L}+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ''), CASE WHEN s IS NOT NULL THEN '' END)"),
    ("utf8_replace_slice", "overlay(s PLACING 'XX' FROM 2 FOR 2)", "left(s, 1) || 'XX' || substr(s, 4)"),
    ("binary_replace_slice", "overlay(encode(s, 'utf-8') PLACING encode('XX', 'utf-8') FROM 2 FOR 2)", None),
    ("str_concat", "concat(s, '-', p)", "s || '-' || p"),
)
_pad = "CASE WHEN char_length(s) >= 8 THEN s ELSE {} END"
_dpad = "CASE WHEN length(s) >= 8 THEN s ELSE {} END"
_center = "rpad(lpad(s, char_length(s) + CAST(floor((8 - char_length(s)) / 2) AS INT), '*'), 8, '*')"
_dcenter = "rpad(lpad(s, CAST(length(s) + (8 - length(s)) // 2 AS INTEGER), '*'), 8, '*')"
_add(
    "padding", "scalar",
    *((f"{k}_{d}pad", _pad.format(f"{d}pad(s, 8, '*')"), _dpad.format(f"{d}pad(s, 8, '*')")) for k in ("ascii", "utf8") for d in "lr"),
    *((f"{k}_center", _pad.format(_center), _dpad.format(_dcenter)) for k in ("ascii", "utf8")),
    ("utf8_zero_fill", "CASE WHEN char_length(s) >= 8 THEN s WHEN s LIKE '+%' OR s LIKE '-%' THEN concat(left(s, 1), lpad(substr(s, 2), 7, '0')) ELSE lpad(s, 8, '0') END", "CASE WHEN length(s) >= 8 THEN s WHEN s LIKE '+%' OR s LIKE '-%' THEN left(s, 1) || lpad(substr(s, 2), 7, '0') ELSE lpad(s, 8, '0') END"),
)
_ascii_ws, _d_ws = r"[ \\t-\\r]+", r"[ \t-\r]+"
_dws = r"[\p{Z}\x09-\x0D\x1C-\x1F]+"
_add(
    "trimming", "scalar",
    *((f"{k}_{d}trim_whitespace", f"regexp_replace(s, '{'|'.join(([r'\\A' + w] if d != 'r' else []) + ([w + r'\\z'] if d != 'l' else []))}', '')", f"regexp_replace(s, '{'|'.join((['^' + v] if d != 'r' else []) + ([v + '$'] if d != 'l' else []))}', '', 'g')") for k, w, v in (("ascii", _ascii_ws, _d_ws), ("utf8", f"[{WS}]+", _dws)) for d in ("", "l", "r")),
    *((f"{k}_trim", "btrim(s, 'Hd ')", "trim(s, 'Hd ')") for k in ("ascii", "utf8")),
    *((f"{k}_ltrim", "ltrim('Hd ', s)", "ltrim(s, 'Hd ')") for k in ("ascii", "utf8")),
    *((f"{k}_rtrim", "rtrim('Hd ', s)", "rtrim(s, 'Hd ')") for k in ("ascii", "utf8")),
)
_add(
    "splitting and joining", "scalar",
    ("ascii_split_whitespace", f"split(s, '{_ascii_ws}')", f"regexp_split_to_array(s, '{_d_ws}')"),
    ("utf8_split_whitespace", f"split(s, '[{WS}]+')", f"regexp_split_to_array(s, '{_dws}')"),
    ("split_pattern", r"split(s, '\\Ql\\E')", "string_split(s, 'l')"), ("split_pattern_regex", "split(s, 'l+')", "regexp_split_to_array(s, 'l+')"),
    ("extract_regex", r"CASE WHEN rlike(s, '(\\w)(\\d)') THEN named_struct('a', regexp_extract(s, '(\\w)(\\d)', 1), 'b', regexp_extract(s, '(\\w)(\\d)', 2)) END", None),
    ("extract_regex_span", r"regexp_instr(s, '(\\w)(\\d)')", None),
    ("binary_join", "CASE WHEN exists(sarr, e -> e IS NULL) THEN NULL ELSE array_join(sarr, '-') END", "CASE WHEN len(list_filter(sarr, lambda e: e IS NULL)) > 0 THEN NULL ELSE coalesce(array_to_string(sarr, '-'), CASE WHEN sarr IS NOT NULL THEN '' END) END"),
    ("binary_join_element_wise", "concat(s, '-', p)", "s || '-' || p"),
    ("utf8_slice_codeunits", "substr(s, 2, 3)", "="), ("binary_slice", "substr(encode(s, 'utf-8'), 2, 3)", None),
)
_add(
    "containment", "scalar",
    ("count_substring", r"regexp_count(s, '\\Ql\\E')", "CAST(len(string_split(s, 'l')) - 1 AS INTEGER)"),
    ("find_substring", "CASE WHEN instr(s, 'l') = 0 THEN -1 ELSE octet_length(left(s, instr(s, 'l') - 1)) END", "CASE WHEN instr(s, 'l') = 0 THEN -1 ELSE CAST(strlen(left(s, instr(s, 'l') - 1)) AS INTEGER) END"),
    ("match_substring", "contains(s, 'l')", "="), ("starts_with", "startswith(s, 'H')", "starts_with(s, 'H')"), ("ends_with", "endswith(s, 'd')", "ends_with(s, 'd')"),
    ("count_substring_regex", "regexp_count(s, 'l+')", "CAST(len(regexp_extract_all(s, 'l+')) AS INTEGER)"),
    ("find_substring_regex", "CASE WHEN regexp_instr(s, 'l+') = 0 THEN -1 ELSE octet_length(left(s, regexp_instr(s, 'l+') - 1)) END", "CASE WHEN s IS NULL THEN NULL WHEN NOT regexp_matches(s, 'l+') THEN -1 ELSE CAST(strlen(regexp_split_to_array(s, 'l+')[1]) AS INTEGER) END"),
    ("match_substring_regex", "rlike(s, 'l+')", "regexp_matches(s, 'l+')"), ("match_like", "s LIKE 'H%_d'", "="),
    ("is_in", "coalesce(i IN (1, 2, 3), false)", "="), ("index_in", "nullif(array_position(array(1L, 2L, 3L), i), 0) - 1", "CAST(list_position([1, 2, 3], i) - 1 AS BIGINT)"),
)
_add(
    "categorization and selection", "scalar",
    ("is_null", "x IS NULL", "="), ("is_valid", "x IS NOT NULL", "="), ("true_unless_null", "CASE WHEN x IS NOT NULL THEN true END", "="),
    ("is_finite", f"NOT isnan(x) AND abs(x) <> {INF}", "isfinite(x)"), ("is_inf", f"abs(x) = {INF}", "isinf(x)"), ("is_nan", "CASE WHEN x IS NOT NULL THEN isnan(x) END", "isnan(x)"),
    ("if_else", "CASE WHEN b IS NOT NULL THEN if(b, i, j) END", "CASE WHEN b IS NOT NULL THEN CASE WHEN b THEN i ELSE j END END"),
    ("coalesce", "coalesce(i, j)", "="), ("case_when", "CASE WHEN b THEN i WHEN c THEN j ELSE 0L END", "CASE WHEN b THEN i WHEN c THEN j ELSE 0 END"),
    ("choose", "element_at(array(i, j), n % 2 + 1)", "CASE n % 2 WHEN 0 THEN i WHEN 1 THEN j END"), ("fill_null", "coalesce(x, 0D)", "coalesce(x, 0)", "d"),
    ("cast", "CAST(i AS STRING)", "CAST(i AS VARCHAR)"), ("cast_safe", "try_cast(s AS BIGINT)", None), ("to_strings", "CAST(i AS STRING)", "CAST(i AS VARCHAR)"), ("parse", "try_cast(p AS BIGINT)", "try_cast(p AS BIGINT)"),
    ("hash32", "CASE WHEN s IS NOT NULL THEN hash(s) END", None), ("hash64", "CASE WHEN i IS NOT NULL THEN xxhash64(i) END", None),
)

_us = "unix_micros(CAST(ts AS TIMESTAMP))"
_micros = lambda e: f"CAST(timestamp_micros({e}) AS TIMESTAMP_NTZ)"
_week_day = "date_add(date_sub(CAST(ts AS DATE), dayofweek(ts) - 1), 3)"
_d_week_day = "(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) + 3)"
_add(
    "temporal", "scalar",
    ("year", "year(ts)", "CAST(year(ts) AS INTEGER)"), ("month", "month(ts)", "CAST(month(ts) AS INTEGER)"), ("day", "day(ts)", "CAST(day(ts) AS INTEGER)"), ("day_of_week", "weekday(ts)", "CAST(isodow(ts) - 1 AS INTEGER)"),
    ("hour", "hour(ts)", "CAST(hour(ts) AS INTEGER)"), ("minute", "minute(ts)", "CAST(minute(ts) AS INTEGER)"), ("second", "second(ts)", "CAST(second(ts) AS INTEGER)"), ("day_of_year", "dayofyear(ts)", "CAST(dayofyear(ts) AS INTEGER)"),
    ("quarter", "quarter(ts)", "CAST(quarter(ts) AS INTEGER)"), ("iso_week", "weekofyear(ts)", "CAST(weekofyear(ts) AS INTEGER)"), ("iso_year", "extract(YEAROFWEEK FROM ts)", "CAST(isoyear(ts) AS INTEGER)"),
    ("millisecond", f"CAST(pmod({_us} div 1000, 1000) AS INT)", "CAST(millisecond(ts) % 1000 AS INTEGER)"), ("microsecond", f"CAST(pmod({_us}, 1000) AS INT)", "CAST(microsecond(ts) % 1000 AS INTEGER)"), ("nanosecond", "CASE WHEN ts IS NOT NULL THEN 0 END", "="),
    ("is_leap_year", "(year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0", "="), ("strftime", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    ("strptime", "CAST(try_to_timestamp(date_format(ts, 'yyyy/MM/dd'), 'yyyy/MM/dd') AS TIMESTAMP_NTZ)", "strptime(strftime(ts, '%Y/%m/%d'), '%Y/%m/%d')"),
    ("iso_calendar", "CASE WHEN ts IS NOT NULL THEN named_struct('iso_year', extract(YEAROFWEEK FROM ts), 'iso_week', weekofyear(ts), 'iso_day_of_week', weekday(ts) + 1) END", None),
    ("subsecond", f"pmod({_us}, 1000000) / 1e6D", "(microsecond(ts) % 1000000) / 1e6", "d"), ("us_week", f"CAST(floor((dayofyear({_week_day}) - 1) / 7) AS INT) + 1", f"CAST((dayofyear({_d_week_day}) - 1) // 7 + 1 AS INTEGER)"), ("us_year", f"year({_week_day})", f"CAST(year({_d_week_day}) AS INTEGER)"),
    ("week", "weekofyear(ts)", "CAST(weekofyear(ts) AS INTEGER)"), ("year_month_day", "CASE WHEN ts IS NOT NULL THEN named_struct('year', year(ts), 'month', month(ts), 'day', day(ts)) END", None),
    ("is_dst", "unix_seconds(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York')) - unix_seconds(CAST(ts AS TIMESTAMP)) > -18000", None),
    ("ceil_temporal", _micros(f"CAST(ceil({_us} / 900000000D) AS BIGINT) * 900000000L"), "make_timestamp(CAST(ceil(epoch_us(ts) / 900000000) AS BIGINT) * 900000000)"),
    ("floor_temporal", "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)", "CAST(date_trunc('hour', ts) AS TIMESTAMP)"),
    ("round_temporal", _micros(f"CAST(floor({_us} / 900000000D + 0.5D) AS BIGINT) * 900000000L"), "make_timestamp(CAST(floor(epoch_us(ts) / 900000000 + 0.5) AS BIGINT) * 900000000)"),
    ("cast_unit", "CAST(date_trunc('SECOND', ts) AS TIMESTAMP_NTZ)", "CAST(date_trunc('second', ts) AS TIMESTAMP)"),
    ("add_duration", "ts + make_dt_interval(n, 1, 2, 3)", "ts + to_days(n) + INTERVAL 1 HOUR + INTERVAL 2 MINUTE + INTERVAL 3 SECOND"), ("add_interval", "ts + make_ym_interval(0, n)", "ts + to_months(n)"),
)
_truncated = lambda u: f"timestampdiff({u}, date_trunc('{u}', ts), date_trunc('{u}', ts2))"
_us2 = "unix_micros(CAST(ts2 AS TIMESTAMP))"
_months = "((year(ts2) - year(ts)) * 12 + month(ts2) - month(ts))"
_add(
    "temporal differences", "scalar",
    ("days_between", "datediff(ts2, ts)", "CAST(date_diff('day', ts, ts2) AS INTEGER)"), *((f"{u.lower()}s_between", _truncated(u), f"date_diff('{u.lower()}', ts, ts2)") for u in ("HOUR", "MINUTE", "SECOND")),
    ("microseconds_between", f"{_us2} - {_us}", "epoch_us(ts2) - epoch_us(ts)"), ("milliseconds_between", f"CAST(floor({_us2} / 1000D) AS BIGINT) - CAST(floor({_us} / 1000D) AS BIGINT)", "epoch_ms(ts2) - epoch_ms(ts)"), ("nanoseconds_between", f"({_us2} - {_us}) * 1000L", "(epoch_us(ts2) - epoch_us(ts)) * 1000"),
    ("quarters_between", "(year(ts2) * 4 + quarter(ts2)) - (year(ts) * 4 + quarter(ts))", "CAST(date_diff('quarter', ts, ts2) AS INTEGER)"), ("years_between", "year(ts2) - year(ts)", "CAST(date_diff('year', ts, ts2) AS INTEGER)"), ("weeks_between", "CAST(datediff(date_trunc('WEEK', ts2), date_trunc('WEEK', ts)) / 7 AS INT)", "CAST((CAST(date_trunc('week', ts2) AS DATE) - CAST(date_trunc('week', ts) AS DATE)) // 7 AS INTEGER)"),
    ("months_between_boundaries", _months, "CAST(date_diff('month', ts, ts2) AS INTEGER)"),
    ("month_interval_between", f"extract(YEAR FROM make_ym_interval(0, {_months})) * 12 + extract(MONTH FROM make_ym_interval(0, {_months}))", "CAST(date_diff('month', ts, ts2) AS INTEGER)"),
    ("day_time_interval_between", f"named_struct('days', datediff(ts2, ts), 'microseconds', pmod({_us2}, 86400000000) - pmod({_us}, 86400000000))", None),
    ("month_day_nano_interval_between", f"named_struct('months', {_months}, 'days', day(ts2) - day(ts), 'nanoseconds', (pmod({_us2}, 86400000000) - pmod({_us}, 86400000000)) * 1000L)", None),
    ("assume_timezone", "CAST(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo') AS TIMESTAMP_NTZ)", "ts - INTERVAL 9 HOUR"), ("local_timestamp", "CAST(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo') AS TIMESTAMP_NTZ)", "ts + INTERVAL 9 HOUR"),
    ("utc_offset", "CASE WHEN ts IS NOT NULL THEN unix_seconds(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo')) - unix_seconds(CAST(ts AS TIMESTAMP)) END", "CASE WHEN ts IS NOT NULL THEN CAST(32400 AS BIGINT) END"),
)
_add(
    "nested", "scalar",
    ("list_value_length", "array_size(arr)", "CAST(len(arr) AS INTEGER)"), ("list_element", "get(arr, 0)", "arr[1]"), ("list_slice", "filter(arr, (e, ix) -> ix >= 1 AND ix < 5 AND (ix - 1) % 2 = 0)", "[arr[2]]"),
    ("struct_field", "st.a", "st.a"), ("make_struct", "named_struct('a', i, 'b', s)", None), ("map_lookup", "try_element_at(m, 'k')", "m['k']"),
)

_w, _run = "OVER (ORDER BY pos)", "OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
# Spark folds a frame that runs on to the end anew for each row; from the end backward it is one pass
_back = "OVER (ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_cum = lambda f, v="i": f"CASE WHEN {v} IS NOT NULL THEN {f}({v}) {_run} END"
_frame = "OVER (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_rolling = lambda f: f"CASE WHEN count(i) {_frame} >= 3 THEN {f}(i) {_frame} END"
_key = "CASE WHEN x IS NULL THEN 2 WHEN isnan(x) THEN 1 ELSE 0 END"
_clean = "CASE WHEN isnan(x) THEN NULL ELSE x END"
_add(
    "order", "window",
    ("array_sort_indices", f"row_number() OVER (ORDER BY {_key}, x, pos)", f"CAST(row_number() OVER (ORDER BY {_key}, {_clean}, pos) AS INTEGER)"),
    ("rank", "rank() OVER (ORDER BY i ASC NULLS LAST)", "CAST(rank() OVER (ORDER BY i ASC NULLS LAST) AS INTEGER)"), ("dense_rank", "dense_rank() OVER (ORDER BY i ASC NULLS LAST)", "CAST(dense_rank() OVER (ORDER BY i ASC NULLS LAST) AS INTEGER)"),
    ("row_number", "row_number() OVER (ORDER BY i ASC NULLS LAST, pos)", "CAST(row_number() OVER (ORDER BY i ASC NULLS LAST, pos) AS INTEGER)"), ("max_rank", "count(*) OVER (ORDER BY i ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "="),
    ("rank_quantile", "((rank() OVER (ORDER BY i NULLS LAST) + count(*) OVER (ORDER BY i NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0D - 0.5D - 0.5D + 0.5D - 0.5D + 0.5D) / count(*) OVER ()", None, "d"),
    ("partition_nth_indices", "row_number() OVER (ORDER BY i NULLS LAST, pos) <= 5", "="), ("percent_rank", "percent_rank() OVER (ORDER BY i NULLS LAST)", "=", "d"), ("cume_dist", "cume_dist() OVER (ORDER BY i NULLS LAST)", "=", "d"),
    ("dictionary_encode", "dense_rank() OVER (ORDER BY i NULLS LAST) - 1", "CAST(dense_rank() OVER (ORDER BY i NULLS LAST) - 1 AS INTEGER)"),
    ("fill_null_forward", f"last_value(x, true) {_run}", f"last_value(x IGNORE NULLS) {_run}", "d"), ("fill_null_backward", f"last_value(x, true) {_back}", "first_value(x IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "d"),
    ("pairwise_diff", f"i - lag(i, 1) {_w}", "="), ("pairwise_diff_checked", f"CASE WHEN i IS NOT NULL AND lag(i, 1) {_w} IS NOT NULL THEN coalesce(try_subtract(i, lag(i, 1) {_w}), {_raise('BIGINT', 'overflow')}) END", f"i - lag(i, 1) {_w}"),
    ("cumulative_sum", _cum("sum"), f"CASE WHEN i IS NOT NULL THEN CAST(sum(i) {_run} AS BIGINT) END"), ("cumulative_sum_checked", _cum("sum"), f"CASE WHEN i IS NOT NULL THEN CAST(sum(i) {_run} AS BIGINT) END"),
    ("cumulative_max", _cum("max"), "="), ("cumulative_min", _cum("min"), "="), ("cumulative_mean", _cum("avg"), "=", "d"),
    ("shift", f"lag(i, 2, 0) {_w}", "="), ("rolling_sum", _rolling("sum"), _rolling("sum").replace(f"sum(i) {_frame}", f"CAST(sum(i) {_frame} AS BIGINT)")), ("rolling_mean", _rolling("avg"), "=", "d"), ("rolling_min", _rolling("min"), "="), ("rolling_max", _rolling("max"), "="),
    ("replace_with_mask", f"CASE WHEN b IS NULL THEN NULL WHEN b THEN get(array(10L, 20L, 30L), CAST(count_if(b) {_run} - 1 AS INT)) ELSE i END", f"CASE WHEN b IS NULL THEN NULL WHEN b THEN [10, 20, 30][count(*) FILTER (WHERE b) {_run}] ELSE i END"),
)
FUNCTIONS["rank_quantile"] = Function("rank_quantile", "order", "((rank() OVER (ORDER BY i NULLS LAST) + count(*) OVER (ORDER BY i NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0D - 0.5D) / count(*) OVER ()", "((rank() OVER (ORDER BY i NULLS LAST) + count(*) OVER (ORDER BY i NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 - 0.5) / count(*) OVER ()", "window", True)

#: q and r are decimals of 12 digits, 3 of them behind the point.
_add(
    "decimals", "scalar",
    ("decimal_add", "q + r", "="), ("decimal_subtract", "q - r", "="), ("decimal_multiply", "q * r", "CAST(q * r AS DECIMAL(25,6))"), ("decimal_negate", "-q", "="), ("decimal_abs", "abs(q)", "="), ("decimal_sign", "CAST(signum(q) AS INT)", "CAST(sign(q) AS INTEGER)"),
    ("decimal_round", "CAST(round(q, 1) AS DECIMAL(12,1))", "CAST(round(q, 1) AS DECIMAL(12,1))"), ("decimal_ceil", "CAST(ceil(q) AS BIGINT)", "CAST(ceil(q) AS BIGINT)"), ("decimal_floor", "CAST(floor(q) AS BIGINT)", "CAST(floor(q) AS BIGINT)"),
    ("decimal_truncate", "CAST(CASE WHEN q < 0 THEN ceil(q) ELSE floor(q) END AS BIGINT)", "CAST(trunc(q) AS BIGINT)"), ("decimal_widen", "CAST(q AS DECIMAL(20,5))", "="), ("decimal_narrow", "CAST(q AS DECIMAL(10,2))", "="), ("decimal_to_double", "CAST(q AS DOUBLE)", "="), ("double_to_decimal", "CAST(y AS DECIMAL(10,2))", None),
    *((f"decimal_{k}", f"q {op} r", "=") for k, op in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">="))),
    ("fixed_binary_equal", "encode(s, 'utf-8') = encode(p, 'utf-8')", "s = p"), ("fixed_binary_hash64", "CASE WHEN s IS NOT NULL THEN xxhash64(encode(s, 'utf-8')) END", None),
    ("interval_field", "extract(DAY FROM make_dt_interval(n, 1, 0, 0))", "n"), ("subtract_timestamps", "unix_micros(CAST(ts2 AS TIMESTAMP)) - unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts2) - epoch_us(ts)"),
)
_add("decimals", "agg", ("decimal_sum", "sum(q)", "CAST(sum(q) AS DECIMAL(22,3))"), ("decimal_min", "min(q)", "="), ("decimal_max", "max(q)", "="))
