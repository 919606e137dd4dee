"""Null-aware arithmetic and dates. Missing is null; nothing here raises or returns NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, cap: float = 50.0) -> Column:
    """num / den; null where den is null or nearly zero, and where the ratio exceeds the cap either way."""
    v = F.when(F.abs(den) >= 1e-6, num / den)
    return F.when(F.abs(v) <= cap, v)


def abs_ratio(num: Column, den: Column) -> Column:
    """num / |den|, uncapped; null where either is null or den is zero."""
    return F.try_divide(num, F.abs(den))


def signed_log(v: Column) -> Column:
    return F.signum(v) * F.log10(1 + F.abs(v))


def signed_exp(v: Column) -> Column:
    """The inverse of signed_log."""
    return F.signum(v) * (F.pow(F.lit(10.0), F.abs(v)) - 1)


def zero(v: Column) -> Column:
    """A missing line item is a zero balance."""
    return F.coalesce(v, F.lit(0.0))


def clip(v: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def logistic(lin: Column) -> Column:
    """1 / (1 + e^-x) with the tails held at 0 and 1 beyond 700."""
    return F.when(lin <= -700, 0.0).when(lin >= 700, 1.0).otherwise(1 / (1 + F.exp(-lin)))


def both(a: Column, b: Column) -> Column:
    """Three-valued and of 0/1 flags: null if either is."""
    return a * b


def rel_diff(a: Column, b: Column, rel: float, floor: float) -> Column:
    """Whether a and b differ by more than rel of |b| and by more than floor."""
    return (F.abs(a - b) > rel * F.abs(b)) & (F.abs(a - b) > floor)


def year_shift(day8: Column, years: int) -> Column:
    """yyyymmdd text some years off, keeping month and day as written (29 February stays)."""
    return F.concat((F.substring(day8, 1, 4).cast("int") + years).cast("string"), F.substring(day8, 5, 4))


def fiscal_year(d: Column, last_month: int = 5) -> Column:
    """A year that ends in the first months belongs to the year before."""
    return F.year(d) - F.when(F.month(d) <= last_month, 1).otherwise(0)


def day_of_fiscal_year(d: Column, last_month: int = 5) -> Column:
    """Day of the year, the first months counting on from the year before."""
    return F.dayofyear(d) + F.when(F.month(d) <= last_month, 365).otherwise(0)


def parse_date(s: Column) -> Column:
    """The one of four formats that fits; otherwise null. Only that which a text's signs allow is tried, as a failure costs an exception."""
    known = F.when(s.rlike("^[A-Za-z]"), F.try_to_date(s, "MMMM d yyyy")).when(s.rlike("[A-Za-z]"), F.try_to_date(s, "dd-MMM-yyyy"))
    return known.when(s.rlike(".-"), F.try_to_date(s, "yyyy-MM-dd")).otherwise(F.try_to_date(s, "yyyyMMdd"))


def in_range_or_kept(s: Column, low: int, high: int) -> Column:
    """Whether a text is a whole number from low to high; other texts and null are not."""
    return F.coalesce(F.expr("true") & s.try_cast("int").between(low, high), F.lit(False))
