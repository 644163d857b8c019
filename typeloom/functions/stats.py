"""Statistics as Column builders. NULL stands for "not computable"; NaN inputs become NULL first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def known(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def variation(x: Column) -> Column:
    """Sample standard deviation over mean; NULL below two values or at mean 0."""
    return F.try_divide(F.stddev_samp(x), F.avg(x))


def percentile_ratio(x: Column, high: float, low: float) -> Column:
    """Linearly interpolated percentiles; NULL below two values or at a lower percentile of 0."""
    return F.when(F.count(x) >= 2, F.try_divide(F.percentile(x, F.lit(high)), F.percentile(x, F.lit(low))))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; NULL if they sum to 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    terms = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - terms / total)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin over low..high, NULL for NULL; bin 0 throughout if both are equal."""
    return F.when(high == low, F.lit(0)).when(x.isNotNull(), F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
