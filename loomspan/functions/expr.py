"""Column helpers shared by all operators. Each returns a plain Spark expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = "Ticker"
TIME = "Date"


def by_series(*extra: str, order: str = TIME) -> WindowSpec:
    """Rows of one series in time order.

    A panel key (Date, Ticker) is unique after cleaning and Date is a civil day, so a group of this
    window never holds more rows than the calendar has days, whatever the size of the panel.
    """
    return Window.partitionBy(SERIES, *extra).orderBy(order)


def trailing(w: int, spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_series()).rowsBetween(-(w - 1), 0)


def full(agg: Callable[[Column], Column], x: Column, w: int, min_periods: int | None = None,
         spec: WindowSpec | None = None) -> Column:
    """Trailing aggregate that stays NULL until the window holds enough non-null values."""
    frame = trailing(w, spec)
    return F.when(F.count(x).over(frame) >= (w if min_periods is None else min_periods), agg(x).over(frame))


def div(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero denominator (ANSI mode would raise)."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound x; greatest/least skip NULLs in Spark, so NULL is passed through explicitly."""
    y = x
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    return F.when(x.isNotNull(), y)


def root(x: Column) -> Column:
    """sqrt with NULL for a negative argument."""
    return F.when(x >= 0, F.sqrt(x))


def finite(x: Column) -> Column:
    """NaN and +-inf become NULL, the only missing marker used in this package."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values, NULL for a constant side (the built-in raises in ANSI mode)."""
    sx = F.stddev_pop(F.when(y.isNotNull(), x))
    sy = F.stddev_pop(F.when(x.isNotNull(), y))
    return div(F.covar_pop(x, y), sx * sy)


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = div(x - mean, sd)
    return F.exp(-0.5 * z * z) / (sd * 2.5066282746310002)


# Coefficients of the Abramowitz-Stegun 7.1.26 approximation of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / 1.4142135623730951
    t = 1.0 / (1.0 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.signum(z) * erf)


# Coefficients of Acklam's rational approximation of the inverse normal distribution.
INV_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2,
         -3.066479806614716e1, 2.506628277459239)
INV_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1,
         -1.328068155288572e1)
INV_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734,
         4.374664141464968, 2.938163982698783)
INV_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)


def _horner(coefs: tuple[float, ...], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution for 0 < p < 1 (relative error below 1.2e-9)."""
    q = p - 0.5
    r = q * q
    mid = _horner(INV_A, r) * q / (_horner(INV_B, r) * r + 1.0)
    lo = F.sqrt(-2.0 * F.ln(p))
    hi = F.sqrt(-2.0 * F.ln(1.0 - p))
    tail_lo = _horner(INV_C, lo) / (_horner(INV_D, lo) * lo + 1.0)
    tail_hi = -_horner(INV_C, hi) / (_horner(INV_D, hi) * hi + 1.0)
    return F.when(p < 0.02425, tail_lo).when(p > 1 - 0.02425, tail_hi).otherwise(mid)


def drawn(*parts: Column | str | int) -> Column:
    """A whole number below 2^32, spread evenly, from the MD5 of the parts joined by colons; SQL can repeat it."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# Offset of the output grid: cell edges away from short decimal fractions, so that two engines that
# differ in the last bit of a double still land in the same cell.
GRID_OFFSET = 0.3717264


def grid(x: Column, digits: int = 6) -> Column:
    """Value on a 10^-digits grid, for published tables that another engine must reproduce."""
    scale = float(10 ** digits)
    return F.floor(x * scale + GRID_OFFSET) / scale
