"""Column expressions shared by the operators.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_even(x, digits: int = 0) -> Column:
    """Round half to even at ``digits`` places, the way numpy does it:
    ``rint(x * 10**d) / 10**d``. Spark's ``round``/``bround`` work on the
    decimal expansion instead and disagree on binary ties."""
    scale = float(10 ** digits)
    return F.rint(c(x) * F.lit(scale)) / F.lit(scale)


def to_cents(x) -> Column:
    """Money as whole cents (exact long), for order-independent sums."""
    return F.rint(c(x) * F.lit(100.0)).cast("long")


def money_sum(x) -> Column:
    """Exact sum of a 2-decimal money column, returned as double.

    Sums whole cents as a long (codegen'd, no BigDecimal buffer) and divides
    once, so the total does not depend on partitioning or row order."""
    return F.sum(to_cents(x)) / F.lit(100.0)


def safe_div(num, den, default=0.0) -> Column:
    """num / den with 0 (or null) denominators mapped to ``default``."""
    return F.coalesce(F.try_divide(c(num), c(den)), F.lit(default))


def strip(x) -> Column:
    """Remove leading and trailing whitespace of any kind (not only blanks,
    which is all ``trim`` removes)."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")


def whole_days(start, end) -> Column:
    """Elapsed whole 24-hour days from ``start`` to ``end`` (truncated)."""
    return F.timestamp_diff("DAY", c(start), c(end))


def month_start(ts) -> Column:
    return F.trunc(F.to_date(c(ts)), "month")


def month_label(ts) -> Column:
    return F.date_format(F.to_date(c(ts)), "yyyy-MM")


def months_apart(a, b) -> Column:
    """Calendar-month difference b - a (year*12 + month)."""
    return (F.year(c(b)) * 12 + F.month(c(b))) - (F.year(c(a)) * 12 + F.month(c(a)))


def ceil_div(a, b) -> Column:
    """Integer ceil(a / b) for a >= 0, b > 0.

    (a - pmod(a, b)) is a multiple of b, so the division is exact."""
    a, b = c(a).cast("long"), c(b).cast("long")
    q = ((a - F.pmod(a, b)) / b).cast("long")
    return q + F.when(F.pmod(a, b) > 0, F.lit(1)).otherwise(F.lit(0))


def with_scalars(df, scalars):
    """Attach the columns of a one-row frame (a global aggregate: quantile
    bounds, a snapshot or cutoff date, a count) to every row of ``df``.

    The one-row side is broadcast (its size is fixed at one row whatever the
    data volume), so the join is a map-side BroadcastNestedLoopJoin with no
    condition that emits exactly one output row per input row. Kept in the
    same plan as ``df`` (rather than a scalar subquery) so AQE can reuse the
    exchanges both sides share."""
    from pyspark.sql import functions as F

    return df.crossJoin(F.broadcast(scalars))
