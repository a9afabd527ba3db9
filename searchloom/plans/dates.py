"""Date expressions of requests, resolved when the plan is made: date math, rounding, formats and intervals. All in UTC."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone

_MATH = re.compile(r"([+-])(\d+)([yMwdhHms])|/([yMwdhHms])")
#: Milliseconds of each fixed unit.
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "H": 3_600_000, "d": 86_400_000, "w": 604_800_000}
#: Calendar units by their names.
CALENDAR = {"second": "s", "1s": "s", "minute": "m", "1m": "m", "hour": "h", "1h": "h", "day": "d", "1d": "d", "week": "w", "1w": "w", "month": "M", "1M": "M", "quarter": "q", "1q": "q", "year": "y", "1y": "y"}
_FORMATS = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H", "%Y-%m-%d", "%Y/%m/%d", "%Y-%m", "%Y")
_SPAN = dict(zip(_FORMATS, ("", "", "", "", "m", "h", "d", "d", "M", "y")))
#: Formats named in requests, as patterns of this module.
_JAVA = (("yyyy", "%Y"), ("uuuu", "%Y"), ("yy", "%y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"), ("SSS", "%f"), ("'T'", "T"), ("'Z'", "Z"))


class DateError(ValueError):
    """A date, format or interval that isn't understood."""


def strptime_format(java: str) -> str:
    for a, b in _JAVA:
        java = java.replace(a, b)
    return java


def add(t: datetime, n: int, unit: str) -> datetime:
    """``t`` and ``n`` calendar units; a day that the month lacks becomes its last."""
    if unit in "yMq":
        months = t.year * 12 + t.month - 1 + n * {"y": 12, "M": 1, "q": 3}[unit]
        year, month = divmod(months, 12)
        return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))
    return t + timedelta(milliseconds=n * UNIT_MS[unit])


def floor(t: datetime, unit: str) -> datetime:
    """The beginning of the unit; weeks begin on Monday."""
    if unit == "w":
        t -= timedelta(days=t.weekday())
    if unit == "q":
        t = t.replace(month=(t.month - 1) // 3 * 3 + 1, day=1)
    cut = {"y": 1, "M": 2, "q": 2, "w": 3, "d": 3, "h": 4, "H": 4, "m": 5, "s": 6}[unit]
    parts = list(t.timetuple()[:6])
    return datetime(*[p if i < cut else (1 if i in (1, 2) else 0) for i, p in enumerate(parts)])


def _plain(text: str, formats: list[str]) -> tuple[datetime, str]:
    """A date without math and the unit that it names."""
    for f in formats:
        if f in ("epoch_millis", "epoch_second"):
            if re.fullmatch(r"-?\d+", text) and (len(text) > 4 or len(formats) == 1):
                return datetime(1970, 1, 1) + timedelta(**{"milliseconds" if f == "epoch_millis" else "seconds": int(text)}), ""
            continue
        zone = re.search(r"(Z|[+-]\d\d:?\d\d)$", text) if "T" in text else None
        body = text[: zone.start()] if zone else text
        for p in _FORMATS if f in ("strict_date_optional_time", "date_optional_time", "date", "strict_date") else (strptime_format(f),):
            try:
                t = datetime.strptime(body if p in _FORMATS else text, p)
            except ValueError:
                continue
            if zone and zone[0] != "Z":
                sign = -1 if zone[0][0] == "+" else 1
                d = zone[0][1:].replace(":", "")
                t += sign * timedelta(hours=int(d[:2]), minutes=int(d[2:]))
            return t.replace(tzinfo=None), _SPAN.get(p, "")
    raise DateError(f"not a date: {text!r}")


def resolve(value: str | int | float, round_up: bool = False, now: datetime | None = None, fmt: str | None = None) -> datetime:
    """The time that a bound names: a number is epoch milliseconds; ``now`` or a date, then ``||`` and date math.

    With ``round_up``, a rounded bound or a date that names a whole unit gives the unit's last millisecond.
    """
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not fmt:
        return datetime(1970, 1, 1) + timedelta(milliseconds=value)
    text = str(value).strip()
    if text.startswith("now"):
        t, unit, math = now or datetime.now(timezone.utc).replace(tzinfo=None), "", text[3:]
    else:
        date, _, math = text.partition("||")
        t, unit = _plain(date, (fmt or "strict_date_optional_time||epoch_millis").split("||"))
    at = 0
    while at < len(math):
        m = _MATH.match(math, at)
        if not m:
            raise DateError(f"not date math: {math!r}")
        if m[4]:
            t, unit = floor(t, m[4]), ""
            if round_up:
                t = add(t, 1, m[4]) - timedelta(milliseconds=1)
        else:
            t, unit = add(t, int(m[1] + m[2]), m[3]), ""
        at = m.end()
    if round_up and unit and not math:
        t = add(t, 1, unit) - timedelta(milliseconds=1)
    return t


def interval_ms(text: str) -> int:
    """Milliseconds of a fixed interval such as ``90m``."""
    m = re.fullmatch(r"(\d+)(ms|[smhdw])", text.strip())
    if not m:
        raise DateError(f"not a fixed interval: {text!r}")
    return int(m[1]) * UNIT_MS[m[2]]


#: Rounding intervals of an automatic histogram: unit and the multiples it may take, from fine to coarse.
LADDER = (("s", (1, 5, 10, 30)), ("m", (1, 5, 10, 30)), ("h", (1, 3, 12)), ("d", (1, 7)), ("M", (1, 3)), ("y", (1, 5, 10, 20, 50, 100)))


def auto_interval(lowest: datetime, highest: datetime, buckets: int) -> tuple[str, int]:
    """The finest unit and multiple with at most ``buckets`` buckets between two times."""
    for unit, multiples in LADDER:
        a, b = floor(lowest, unit), floor(highest, unit)
        if unit in "yM":
            per = 12 if unit == "y" else 1
            n = ((b.year - a.year) * 12 + b.month - a.month) // per
        else:
            n = int((b - a).total_seconds() * 1000) // UNIT_MS[unit]
        for k in multiples:
            if n // k + 1 <= buckets:
                return unit, k
    return "y", 100
