"""Local days, typed times and report windows; ``now`` is always an argument."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def local_time(instant: Column, zone: str = EASTERN) -> Column:
    return F.from_utc_timestamp(instant, zone)


def day_label(instant: Column, zone: str = EASTERN) -> Column:
    """``Monday, Jan 01`` of the local day."""
    return F.date_format(local_time(instant, zone), "EEEE, MMM dd")


def parse_local(text: Column, zone: str = EASTERN) -> Column:
    """The instant of a typed local time, date only or to the minute; null if it isn't one."""
    shapes = ["yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
    return F.to_utc_timestamp(F.coalesce(*(F.try_to_timestamp(text, F.lit(s)) for s in shapes)), zone)


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat((text or "").strip())
    except ValueError:
        return None


def window_bounds(days: int, now: datetime, since: str | None = None, until: str | None = None) -> tuple[datetime, datetime]:
    """Half-open UTC window: whole days from ``since`` to ``until`` (swapped if reversed), else the last ``days``."""
    first, last = _day(since), _day(until)
    if first is None and last is None:
        return now - timedelta(days=max(1, days)), now
    first, last = first or last, last or now.date()
    first, last = min(first, last), max(first, last)
    start = datetime(first.year, first.month, first.day, tzinfo=timezone.utc)
    end = datetime(last.year, last.month, last.day, tzinfo=timezone.utc) + timedelta(days=1)
    return start, end


def next_tick(origin: int, now: int, seconds: int) -> tuple[int, int]:
    """(start, end) in epoch seconds of the last full window counted from ``origin``; the first one while none is full."""
    slot = max(60, seconds)
    end = origin + max(1, (now - origin) // slot) * slot
    return max(origin, end - slot), end


def _typed(text: str | None, zone: str) -> datetime | None:
    """A typed local time as a UTC instant; one with an offset keeps it; null if it isn't a time."""
    try:
        value = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return (value if value.tzinfo else value.replace(tzinfo=ZoneInfo(zone))).astimezone(timezone.utc)


def clearing_window(
    now: datetime, oldest: datetime | None = None, scope: str = "range", start: str = "", end: str = "", hours: int = 0, zone: str = EASTERN
) -> tuple[datetime, datetime]:
    """Half-open UTC window of rows to clear, from local times as typed.

    Scope ``old`` starts at the oldest stored row, else the typed start, else the
    local day's.  ``hours`` after the start count before a typed end, which
    includes its minute, and that before now.  Reversed bounds of a range are swapped; no window is empty.
    """
    minute, typed_end = timedelta(minutes=1), _typed(end, zone)
    if scope.strip().lower() == "old":
        first = oldest or now
    else:
        midnight = now.astimezone(ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0)
        first = _typed(start, zone) or midnight.astimezone(timezone.utc)
    last = first + timedelta(hours=hours) if hours > 0 else typed_end + minute if typed_end else now
    if last < first and scope.strip().lower() != "old":
        first, last = last, first
    return first, last if last > first else first + minute


def ago(instant: Column, now: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago``; ``never`` for null."""
    seconds = F.unix_seconds(now) - F.unix_seconds(instant)
    count = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))
    return (
        F.when(instant.isNull(), "never").when(seconds < 90, "just now").when(seconds < 3600, count(60, "m"))
        .when(seconds < 86400, count(3600, "h")).otherwise(count(86400, "d"))
    )


def clock_label(instant: Column, zone: str = EASTERN) -> Column:
    """``Jan 01, 09:30 AM ET`` of an instant's local time; '' for null."""
    return F.coalesce(F.date_format(local_time(instant, zone), "MMM dd, hh:mm a 'ET'"), F.lit(""))
