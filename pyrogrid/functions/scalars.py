"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

MS_PER_DAY = 86_400_000
# Numbers below this are not epoch milliseconds.
MIN_EPOCH_MS = 10_000_000_000

# Burn-severity classes by upper edge.
SEVERITY_CLASSES = ((0.1, "low"), (0.27, "moderate"), (0.66, "high"))
TOP_SEVERITY = "extreme"


def clip_low(c: Column, low: float = 0.0) -> Column:
    """Lower clip that keeps NULL, unlike ``greatest``."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def as_event_date(df: DataFrame, name: str) -> Column:
    """Date of a column holding timestamps, dates, ISO strings or epoch milliseconds."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("date")
    if isinstance(kind, StringType):
        return F.try_to_timestamp(c).cast("date")
    if isinstance(kind, NumericType):
        return F.when(
            c >= MIN_EPOCH_MS, F.date_from_unix_date(F.floor(c / MS_PER_DAY).cast("int"))
        )
    return F.lit(None).cast("date")


def doy_to_date(reference: Column, doy: Column, lookback_days: int) -> Column:
    """Date of a day of year seen from ``reference``: this year's if not later, else last year's.

    The day is rounded half to even; nothing older than the lookback is returned.
    """
    day = F.bround(doy).cast("int")

    def in_year(year: Column) -> Column:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)

    this_year = in_year(F.year(reference))
    found = F.when(this_year <= reference, this_year).otherwise(in_year(F.year(reference) - 1))
    age = F.datediff(reference, found)
    return F.when((day > 0) & (age >= 0) & (age <= lookback_days), found)


def severity_class(dnbr: Column, zero_is_low: bool = True) -> Column:
    """Severity class by upper edge; with ``zero_is_low=False`` a dnbr of 0 has no class."""
    out = F.when(dnbr.isNull(), F.lit(None).cast("string"))
    if not zero_is_low:
        out = out.when(dnbr <= 0, F.lit(None).cast("string"))
    for edge, label in SEVERITY_CLASSES:
        out = out.when(dnbr <= edge, label)
    return out.otherwise(TOP_SEVERITY)
