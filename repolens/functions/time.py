"""Date, week and span functions on Columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "since_literal", "since", "day", "iso_week", "iso_year", "week_start",
    "display_date", "display_mdy", "days_ago", "DAY_WEEK_SWITCH_DAYS",
]

# Fixed value: spans longer than this many days are charted by week.
DAY_WEEK_SWITCH_DAYS = 90


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def since_literal(date_mdy: str) -> Column:
    """``mm/dd/yyyy`` -> midnight as a timestamp_ntz literal."""
    d = datetime.strptime(date_mdy, "%m/%d/%Y")
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def since(df, date_mdy: str | None, col: str = "committed_at"):
    """Rows at or after local midnight of ``date_mdy`` (P7, P8 with
    ``col='closed_at'``).  A plain comparison with a literal: it is pushed to
    the parquet scan when ``col`` comes from one."""
    if not date_mdy:
        return df
    if dict(df.dtypes).get(col) == "double":  # epoch seconds
        epoch = datetime.strptime(date_mdy, "%m/%d/%Y").replace(tzinfo=timezone.utc).timestamp()
        return df.filter(F.col(col) >= F.lit(epoch))
    return df.filter(F.col(col) >= since_literal(date_mdy))


def day(c) -> Column:
    """Calendar day of a wall time."""
    return F.to_date(_c(c))


def iso_year(c) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(c))


def iso_week(c) -> Column:
    """ISO ``YYYY-WW`` label (T2): 2024-12-30 -> 2025-01."""
    c = _c(c)
    return F.when(c.isNotNull(), F.format_string(
        "%d-%02d", F.extract(F.lit("YEAROFWEEK"), c), F.extract(F.lit("WEEK"), c)))


def week_start(c) -> Column:
    """ISO Monday of the week containing ``c``."""
    return F.to_date(F.date_trunc("week", _c(c)))


def display_date(c) -> Column:
    """``YYYY/MM/DD``."""
    return F.date_format(_c(c), "yyyy/MM/dd")


def display_mdy(c) -> Column:
    """``MM/dd/yyyy``."""
    return F.date_format(_c(c), "MM/dd/yyyy")


def days_ago(c, as_of: str) -> Column:
    """Days between the day of ``c`` and ``as_of`` (``yyyy-MM-dd``) (P20)."""
    return F.datediff(F.to_date(F.lit(as_of)), F.to_date(_c(c)))
