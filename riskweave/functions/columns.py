"""Column expressions for flags, ratios, scores and dates.

Everything here stays inside Catalyst: each helper returns a ``Column``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Lower bounds of the risk levels, and the guard terms of the ratios.
RISK_LEVELS = ((0.15, "high"), (0.07, "moderate"))
LOWEST_RISK_LEVEL = "low"
RATIO_GUARD = 0.001
LOGIT_GUARD = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it fails or is null."""
    return F.when(condition, 1).otherwise(0)


def both(a: Column | str, b: Column | str) -> Column:
    """1 where both 0/1 columns are set."""
    return flag((_col(a) == 1) & (_col(b) == 1))


def any_flag(*cols: Column | str) -> Column:
    """The largest of several 0/1 columns; nulls are skipped."""
    return F.greatest(*[_col(c) for c in cols])


def guarded_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / (whole + a small constant), so that no visits gives 0 and not an error."""
    return _col(part) / (_col(whole) + F.lit(RATIO_GUARD).cast("double"))


def log1p(c: Column | str) -> Column:
    return F.log1p(_col(c))


def month_start(yyyymm: Column | str) -> Column:
    """First day of a month given as an integer or string ``yyyyMM``."""
    return F.to_date(_col(yyyymm).cast("string"), "yyyyMM")


def logit(p: Column | str) -> Column:
    p = _col(p)
    return F.log(p / (1 - p + LOGIT_GUARD) + LOGIT_GUARD)


def binarise(score: Column | str, threshold: float) -> Column:
    return (_col(score) >= F.lit(float(threshold))).cast("int")


def risk_level(score: Column | str, levels: Iterable[tuple[float, str]] = RISK_LEVELS, lowest: str = LOWEST_RISK_LEVEL) -> Column:
    """Name of the first level whose lower bound the score reaches."""
    s = _col(score)
    out = None
    for bound, name in levels:
        out = F.when(s >= bound, name) if out is None else out.when(s >= bound, name)
    return out.otherwise(lowest)


def first_match(pairs: Iterable[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds."""
    out = None
    for cond, label in pairs:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, and 0 where the whole is 0."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0))
