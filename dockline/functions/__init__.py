"""Column functions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_start(epoch: Column, step: int) -> Column:
    """Start of the ``step``-second bin of an epoch, by integer arithmetic (also right before 1970)."""
    return epoch - F.pmod(epoch, F.lit(step))


def epoch_ntz(epoch: Column) -> Column:
    """Epoch seconds as a timestamp without zone, in the session's zone (UTC here)."""
    return F.timestamp_seconds(epoch).cast("timestamp_ntz")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0 or NULL."""
    return F.try_divide(part, whole)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x bounded to [low, high]; NULL if any is NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.greatest(low, F.least(x, high)))


def map_fill(bikes: Column, capacity: Column) -> Column:
    """bikes / capacity capped at 1 from above only; 0 where the capacity is NULL or 0."""
    share = F.coalesce(bikes, F.lit(0)).cast("double") / capacity.cast("double")
    return F.when(capacity > 0, F.least(share, F.lit(1.0))).otherwise(0.0)


def fill_colour(fill: Column) -> Column:
    """[red, green, blue] from the unrounded fill: red when empty, green when full."""
    return F.array((255 * (1 - fill)).cast("int"), ((180 * fill).cast("int") + 40), F.lit(60))


def monday_zero(ts: Column) -> Column:
    return F.weekday(ts)


def gain(base: Column, model: Column) -> Column:
    """Per cent by which ``model`` is below ``base``."""
    return F.try_divide(100 * (base - model), base)
