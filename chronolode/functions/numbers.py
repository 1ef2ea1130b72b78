"""Numbers, money and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prices of cached input tokens relative to fresh ones.
CACHE_WRITE, CACHE_READ = "1.25", "0.1"


def floor12(x: Column) -> Column:
    """Down to 12 decimals, so that sums of the same terms compare equal in any order."""
    return F.floor(x * F.lit(1e12)) / F.lit(1e12)


def price(fresh: Column, cache_write: Column, cache_read: Column, output: Column, input_rate: Column, output_rate: Column) -> Column:
    """Decimal cost of four token counts at rates a million tokens, half-even to six places."""
    d = lambda c: c.cast("decimal(18,2)")
    n = lambda c: c.cast("decimal(12,0)")
    units = n(fresh) * d(input_rate) + n(cache_write) * d(input_rate) * F.lit(CACHE_WRITE).cast("decimal(3,2)") + n(cache_read) * d(input_rate) * F.lit(CACHE_READ).cast("decimal(2,1)") + n(output) * d(output_rate)
    # Rounded as whole millionths, before the division can lose digits.
    return (F.bround(units, 0).cast("decimal(24,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(18,6)")



def clamped_date(raw: Column, since: dt.date, today: dt.date) -> Column:
    """An ISO date within [since, today]; blank or unreadable: null."""
    d = F.try_to_date(F.trim(raw), "yyyy-MM-dd")
    return F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}$") & d.isNotNull(), F.least(F.greatest(d, F.lit(since)), F.lit(today)))


def in_force_label(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(" → "), F.coalesce(end.cast("string"), F.lit("present")))


def backoff(attempt: Column, base: float, cap: float, u: Column | None = None) -> Column:
    """Full-jitter delay: uniform below base doubled with each attempt, at most cap. u: the uniform number to use."""
    return (F.rand() if u is None else u) * F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(32))))


def required_overfetch(selectivity: Column, cap: int = 512) -> Column:
    """How many times k to fetch before filtering: 1/selectivity half-even, within 1 and cap."""
    return F.when(selectivity <= 0, F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(1 / selectivity)))).cast("int")
