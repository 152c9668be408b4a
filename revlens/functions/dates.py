"""Date and time expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text date layouts accepted by parse_date, tried in this order after the
# ISO form (which also accepts a trailing time part).
DEFAULT_DATE_FORMATS = ("MM/dd/yyyy",)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: str | Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Convert a date, timestamp or text column to DATE.

    Text is tried as ISO ``yyyy-MM-dd[ time]`` first, then each layout in
    ``formats``; a value none of them fits becomes NULL (count those with
    ``quality.rejects``) instead of failing the job.
    """
    col = _c(c)
    tries = [F.try_to_date(col.cast("string"), f) for f in formats]
    return F.coalesce(col.try_cast("date"), *tries)


def month_start(c: str | Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(_c(c), "MM")


def as_timestamp_ntz(c: str | Column) -> Column:
    """DATE or timestamp to a zone-less timestamp (a DATE becomes midnight)."""
    return _c(c).cast("timestamp_ntz")


def day_ceiling(c: str | Column) -> Column:
    """Smallest date D with ``c <= D at midnight``.

    ``ts <= booked_at`` (a DATE compared as midnight) holds exactly when
    ``day_ceiling(ts) <= booked_at``: a touch at 08:00 on the booking day
    counts for the next day, a touch at midnight for the same day.
    """
    ts = as_timestamp_ntz(c)
    d = ts.cast("date")
    return F.when(ts == d.cast("timestamp_ntz"), d).otherwise(F.date_add(d, 1))
