"""Query parameters: durations, range bounds and aggregate names.

Parameters are a handful of strings per query, so they are read on the driver
and become literals, which lets range predicates reach the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from .channels import IDENTIFIER

# Seconds per duration unit.
UNIT_SECONDS = {
    "ms": 0.001,
    "s": 1,
    "m": 60,
    "h": 3600,
    "d": 86400,
    "w": 604800,
    "mo": 2592000,
    "y": 31536000,
}
CALENDAR_MONTHS = {"mo": 1, "y": 12}

# The aggregates a downsampling query may ask for.
AGGREGATES = ("mean", "max", "min", "last", "first", "sum", "count")

# The accepted form of a duration.
_DURATION = re.compile(r"(?P<sign>-?)(?P<count>[0-9]+)(?P<unit>ms|mo|s|m|h|d|w|y)")


@dataclass(frozen=True)
class Duration:
    count: int
    unit: str

    @property
    def seconds(self) -> int:
        """Length in whole seconds; the sign is dropped, milliseconds truncate."""
        return abs(self.micros) // 1_000_000

    @property
    def months(self) -> int:
        """Calendar months, 0 for units of fixed length."""
        return self.count * CALENDAR_MONTHS.get(self.unit, 0)

    @property
    def micros(self) -> int:
        return round(self.count * UNIT_SECONDS[self.unit] * 1_000_000)


def parse_duration(text: str | None, name: str = "duration") -> Duration:
    found = _DURATION.fullmatch(text or "")
    if not found:
        raise ValueError(f"{name}: {text!r} is not a duration such as -24h")
    count = int(found["count"])
    return Duration(-count if found["sign"] else count, found["unit"])


def duration_seconds(text: str) -> int:
    return parse_duration(text).seconds


def parse_window(text: str) -> Duration:
    every = parse_duration(text, "window")
    if every.count <= 0:
        raise ValueError(f"window: {text!r} must be longer than zero")
    return every


def parse_aggregate(name: str) -> str:
    if name not in AGGREGATES:
        raise ValueError(f"agg: {name!r} is none of {', '.join(AGGREGATES)}")
    return name


def parse_identifier(text: str | None, name: str) -> str:
    if not re.fullmatch(IDENTIFIER.strip("^$"), text or ""):
        raise ValueError(f"{name}: {text!r} is not a plain name")
    return text


def _shift_months(moment: datetime, months: int) -> datetime:
    index = moment.year * 12 + moment.month - 1 + months
    year, month0 = divmod(index, 12)
    first_of_next = datetime(year + (month0 == 11), (month0 + 1) % 12 + 1, 1)
    last_day = (first_of_next - timedelta(days=1)).day
    return moment.replace(year=year, month=month0 + 1, day=min(moment.day, last_day))


def _numbers(text: str, sign: str, *widths: int) -> list[int] | None:
    """Numbers of fixed widths between signs, such as 2024-05-06; None for anything else."""
    parts = text.split(sign) if sign else [text]
    if [len(part) for part in parts] != list(widths):
        return None
    return [int(part) for part in parts] if all(p.isascii() and p.isdigit() for p in parts) else None


def _offset(text: str) -> timedelta | None:
    """The distance of `+02:00` or `-0330` from UTC."""
    found = _numbers(text[1:], ":", 2, 2) or _numbers(text[1:3], "", 2) and _numbers(text[3:], "", 2) and [int(text[1:3]), int(text[3:])]
    if not found or found[0] > 23 or found[1] > 59:
        return None
    length = timedelta(hours=found[0], minutes=found[1])
    return -length if text[0] == "-" else length


def _clock(text: str) -> timedelta | None:
    """Time since midnight UTC of `HH:MM[:SS[.fraction]][Z or offset]`; a fraction is dropped."""
    shift = timedelta(0)
    if text.endswith("Z"):
        text = text[:-1]
    else:
        at = max(text.find("+"), text.find("-"))
        if at >= 0:
            found = _offset(text[at:])
            if found is None:
                return None
            text, shift = text[:at], found
    whole, dot, fraction = text.partition(".")
    parts = _numbers(whole, ":", 2, 2, 2) or (None if dot else _numbers(whole, ":", 2, 2))
    if not parts or (dot and not (fraction.isascii() and fraction.isdigit())):
        return None
    hour, minute, second = (*parts, 0)[:3]
    if hour > 23 or minute > 59 or second > 59:
        return None
    return timedelta(hours=hour, minutes=minute, seconds=second) - shift


def _moment(text: str) -> datetime | None:
    """A date, or a date and a clock time after `T` or a space, in UTC."""
    date = _numbers(text[:10], "-", 4, 2, 2)
    clock = _clock(text[11:]) if len(text) > 10 and text[10] in "T " else timedelta(0) if len(text) == 10 else None
    if date is None or clock is None:
        return None
    try:
        return datetime(*date, tzinfo=timezone.utc) + clock
    except (ValueError, OverflowError):
        return None


def resolve_bound(text: str | None, as_of: datetime, name: str = "bound") -> datetime:
    """Turn a relative duration, `now()`, a date or a datetime into UTC.

    `as_of` stands for now, so a rerun over the same data gives the same rows.
    A bare date is midnight, a datetime without an offset is UTC, fractions of
    a second are cut off absolute bounds.
    """
    wanted = (text or "").strip()
    absolute = _moment(wanted)
    if absolute is not None:
        return absolute
    now = as_of.astimezone(timezone.utc) if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    if wanted == "now()":
        return now
    try:
        length = parse_duration(wanted)
    except ValueError:
        raise ValueError(f"{name}: {wanted!r} is neither a relative duration, now(), a date nor a datetime") from None
    return _shift_months(now, length.months) if length.months else now + timedelta(microseconds=length.micros)
