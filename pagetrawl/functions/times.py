"""Epoch, display and schedule times. Epochs are seconds as doubles; texts are in UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrawl.functions.text import col

DAY = 24 * 3600

# Days covered by each date preset.
PRESET_DAYS = {"24h": 1, "7d": 7, "30d": 30, "365d": 365}


def epoch_now() -> Column:
    """Current time as epoch seconds."""
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)


def _timestamp(epoch) -> Column:
    """Wall-clock time in UTC, whatever the zone of the session."""
    return F.convert_timezone(None, F.lit("UTC"), F.timestamp_seconds(F.floor(col(epoch))))


def asctime(epoch) -> Column:
    """Epoch as ``Tue Jun 16 01:48:00 2026``; a one-digit day is padded with a space."""
    ts = _timestamp(epoch)
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat(
        F.date_format(ts, "EEE MMM "), day, F.date_format(ts, " HH:mm:ss yyyy"))


def calendar_text(epoch) -> Column:
    """Epoch as ``2026-06-16 01:48:00``."""
    return F.date_format(_timestamp(epoch), "yyyy-MM-dd HH:mm:ss")


def parse_time(text) -> Column:
    """Epoch seconds of a display time; null if the text is not one."""
    text = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    without_weekday = F.regexp_replace(text, r"^[A-Za-z]{3} ", "")
    shapes = [(without_weekday, "MMM d HH:mm:ss yyyy"), (text, "yyyy-MM-dd HH:mm:ss"), (text, "yyyy-MM-dd")]
    parsed = F.coalesce(*(
        F.try_to_timestamp(F.concat(t, F.lit(" +00:00")), F.lit(f"{shape} XXX")) for t, shape in shapes))
    return F.unix_seconds(parsed).cast("double")


def preset_bounds(preset: str, now, start=None, end=None) -> tuple[Column | None, Column | None]:
    """Lower and upper epoch bound of a date preset; None where there is no bound.

    ``custom`` takes both bounds from display times. A custom bound that is
    missing does not restrict.
    """
    now = F.lit(now) if isinstance(now, (int, float)) else now
    if preset in PRESET_DAYS:
        return (F.floor(now) - PRESET_DAYS[preset] * DAY).cast("double"), None
    if preset == "custom":
        return (
            parse_time(F.lit(start)) if start else None,
            parse_time(F.lit(end)) if end else None,
        )
    return None, None


def next_run(enabled, interval, now) -> Column:
    """Display time of the next scheduled run, ``N/A`` if the schedule is off."""
    days = F.when(col(interval) == "daily", F.lit(1)).otherwise(F.lit(7))
    return F.when(col(enabled), calendar_text(col(now) + days * DAY)).otherwise(F.lit("N/A"))


def to_number(text, kind: str = "double") -> Column:
    """Cast that gives null instead of failing."""
    return col(text).try_cast(kind)
