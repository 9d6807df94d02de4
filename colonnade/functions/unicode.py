"""The few functions that no Spark expression gives, as Arrow-batched UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_normalize(column: str | Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError("form is NFC, NFD, NFKC or NFKD")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return run(column)


def normal_ppf(column: str | Column) -> Column:
    """The normal distribution's quantile at a probability; ``rank_normal`` is this of ``rank_quantile``."""

    @F.pandas_udf("double")
    def run(q: pd.Series) -> pd.Series:
        from statistics import NormalDist

        inverse = NormalDist().inv_cdf
        return q.map(lambda p: inverse(p) if p is not None and 0 < p < 1 else None, na_action="ignore")

    return run(column)


def regex_spans(column: str | Column, pattern: str) -> Column:
    """start and length, in code points, of each group of the first match; null without a match."""

    @F.pandas_udf("array<struct<start:int,length:int>>")
    def run(s: pd.Series) -> pd.Series:
        import re

        find = re.compile(pattern).search
        spans = lambda t: [{"start": a, "length": b - a} for a, b in (m.span(g) for g in range(1, m.re.groups + 1))] if t is not None and (m := find(t)) else None
        return s.map(spans, na_action="ignore")

    return run(column)


def cumulative_product(column: str = "value") -> Column:
    """For use over a window that ends at the current row: a wrapping product of the frame."""
    wide = "(CAST(a AS DECIMAL(19,0)) * CAST(v AS DECIMAL(19,0)))"
    return F.expr(f"reduce(collect_list({column}), 1L, (a, v) -> CAST(pmod({wide} + 9223372036854775808BD, 18446744073709551616BD) - 9223372036854775808BD AS BIGINT))")
