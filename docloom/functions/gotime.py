"""Time layouts written by example ("2006-01-02 15:04:05") and duration texts ("1h2m3s")."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

# The elements of a layout, longest first, with their strftime and Spark forms.
ELEMENTS = (
    ("January", "%B", "MMMM"),
    ("Monday", "%A", "EEEE"),
    ("-07:00", "%:z", "xxx"),
    ("Z07:00", "%:z", "XXX"),
    ("-0700", "%z", "xx"),
    ("2006", "%Y", "yyyy"),
    (".000000", ".%f", ".SSSSSS"),
    (".000", "%3f", ".SSS"),
    ("Jan", "%b", "MMM"),
    ("Mon", "%a", "EEE"),
    ("MST", "%Z", "zzz"),
    ("01", "%m", "MM"),
    ("02", "%d", "dd"),
    ("15", "%H", "HH"),
    ("03", "%I", "hh"),
    ("04", "%M", "mm"),
    ("05", "%S", "ss"),
    ("06", "%y", "yy"),
    ("PM", "%p", "a"),
)
_SPLIT = re.compile("|".join(re.escape(e) for e, _, _ in ELEMENTS))
# Seconds of the duration units.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def _translate(layout: str, which: int) -> str:
    known = {e[0]: e[which] for e in ELEMENTS}
    out, at = [], 0
    for m in _SPLIT.finditer(layout):
        out += [_literal(layout[at : m.start()], which), known[m.group()]]
        at = m.end()
    return "".join([*out, _literal(layout[at:], which)])


def _literal(text: str, which: int) -> str:
    if which == 1:
        return text.replace("%", "%%")
    return re.sub(r"[A-Za-z']+", lambda m: "'" + m.group().replace("'", "''") + "'", text)


def spark_pattern(layout: str) -> str:
    """The layout as a Spark datetime pattern."""
    return _translate(layout, 2)


def format_time(value: Any, layout: str) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = dt.datetime.fromtimestamp(value, dt.timezone.utc)
    if not isinstance(value, dt.datetime):
        return ""
    pattern = _translate(layout, 1).replace("%3f", f".{value.microsecond // 1000:03d}")
    zone = value.strftime("%z") or "+0000"
    return value.strftime(pattern.replace("%:z", f"{zone[:3]}:{zone[3:5]}"))


def parse_time(layout: str, text: str) -> dt.datetime | None:
    pattern = _translate(layout, 1).replace("%3f", ".%f").replace("%:z", "%z")
    try:
        found = dt.datetime.strptime(text, pattern)
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=dt.timezone.utc)


def parse_duration(text: str) -> dt.timedelta | None:
    sign = -1 if text.startswith("-") else 1
    rest = text.lstrip("+-")
    if rest == "0":
        return dt.timedelta(0)
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        return None
    return dt.timedelta(seconds=sign * sum(float(a) * UNITS[b] for a, b in parts))
