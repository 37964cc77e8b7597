"""Points in time, as microseconds since 1970 in UTC. Parsed on the driver, so no session zone matters."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

_NUMBER = re.compile(r"([+-]?\d+)(?:\.(\d+))?$")
_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[Tt](.+))?$")
_CLOCK = re.compile(r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?([Zz]|[+-]\d\d:\d\d)?$")
_EPOCH = date(1970, 1, 1)


def micros(fraction: str | None) -> int:
    return int((fraction or "0")[:6].ljust(6, "0"))


def parse(text: str, today: date | None = None) -> int:
    """Seconds[.fraction], YYYY-MM-DD, YYYY-MM-DDThh:mm[:ss[.fraction]][zone], or hh:mm[:ss[.fraction]][zone] of today."""
    if m := _NUMBER.match(text):
        seconds = int(m[1])
        if not -(1 << 63) <= seconds < 1 << 63:
            raise ValueError(f"time out of range: {text!r}")
        return seconds * 1_000_000 + micros(m[2])
    day, clock = today or datetime.now(UTC).date(), text
    if m := _DATE.match(text):
        try:
            day, clock = date(int(m[1]), int(m[2]), int(m[3])), m[4]
        except ValueError:
            raise ValueError(f"no such day: {text!r}") from None
    total = (day - _EPOCH) // timedelta(days=1) * 86_400_000_000
    if clock is None:
        return total
    m = _CLOCK.match(clock)
    if not m:
        raise ValueError(f"bad time: {text!r}")
    hour, minute, second, part = int(m[1]), int(m[2]), int(m[3] or 0), micros(m[4])
    if hour > 23 and (hour, minute, second, part) != (24, 0, 0, 0) or minute > 59 or second > 59:
        raise ValueError(f"bad time: {text!r}")
    total += ((hour * 60 + minute) * 60 + second) * 1_000_000 + part
    if m[5] and m[5] not in "Zz":
        total -= (1 if m[5][0] == "+" else -1) * (int(m[5][1:3]) * 60 + int(m[5][4:6])) * 60_000_000
    return total
