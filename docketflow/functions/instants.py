"""One typed date or time to one instant, in plain Python for use inside Arrow batches.

A text that denotes no real instant (31 February, a local time skipped by a
clock change) or more than one (a local time that occurred twice) has none.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "HST": -600, "AKST": -540, "AKDT": -480, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240,
}
#: Abbreviations of several zones; the feed's zone decides, if it has them.
AMBIGUOUS = {"IST", "BST", "AST", "AMT", "GST", "SST", "WST", "ADT", "ECT"}
#: English month names; three letters decide.
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
WEEKDAYS = {d: k for k, d in enumerate("mon tue wed thu fri sat sun".split())}

_MONTH = r"(?P<mon>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?P<wd>mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?\s?m\b\.?)?"
_ZONE = r"(?:\s*(?:\(?(?:UTC|GMT)(?P<usign>[+\-−])(?P<uh>\d{1,2})(?::?(?P<um>\d{2}))?\)?|(?P<sign>[+\-−])(?P<zh>\d{2})(?::?(?P<zm>\d{2}))?|\(?(?P<abbr>[A-Za-z]{1,5})\)?))?(?:\s*\((?P<note>[A-Za-z]{1,5})\))?"

_SHAPES = [
    re.compile(p + r"$", re.I)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<mo>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:T|\s+){_CLOCK}{_ZONE})?",
        rf"(?P<y>\d{{4}})/(?P<mo>\d{{1,2}})/(?P<d>\d{{1,2}})(?:(?:T|\s+){_CLOCK}{_ZONE})?",
        rf"(?:{_WEEKDAY})?(?P<d>\d{{1,2}})(?:\s+|-){_MONTH}(?:,?\s+|-)(?P<y>\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?{_CLOCK}{_ZONE})?",
        rf"(?:{_WEEKDAY})?{_MONTH}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_ZONE})?",
        rf"(?:{_WEEKDAY})?{_MONTH}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}(?:\s+(?P<abbr>[A-Za-z]{{1,5}})|\s+(?P<sign>[+\-])(?P<zh>\d{{2}}):?(?P<zm>\d{{2}}))?\s+(?P<y>\d{{4}})",
        rf"(?P<n1>\d{{1,2}})/(?P<n2>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_ZONE})?",
    )
]
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(?:(\d{2}))?(Z|[+\-]\d{2}:?\d{2})?)?$")
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_ZERO = datetime(1970, 1, 1)


def _micros(delta: timedelta) -> int:
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def local_micros(local: datetime, zone_name: str | None, whole_day: bool) -> int | None:
    """Instant of a wall-clock time; for a whole day, its first moment."""
    zone = _zone(zone_name) if zone_name else None
    if zone is None:
        return None
    first, second = (local.replace(tzinfo=zone, fold=k).utcoffset() for k in (0, 1))
    if first != second and not whole_day:
        return None  # skipped or repeated
    return _micros(local - _ZERO - first)


def _named_micros(local: datetime, zone_name: str | None, abbreviation: str) -> int | None:
    """Instant of a wall-clock time of which the feed's zone itself says by this abbreviation which one it is; null if it doesn't have it then."""
    zone = _zone(zone_name) if zone_name else None
    fits = {at.utcoffset() for k in (0, 1) if zone and (at := local.replace(tzinfo=zone, fold=k)).tzname() == abbreviation}
    return _micros(local - _ZERO - fits.pop()) if len(fits) == 1 else None


def parse_instant(text: str | None, zone_name: str | None, day_first: bool | None) -> int | None:
    """Microseconds since 1970-01-01T00:00:00Z of the one instant that ``text`` denotes, or null."""
    if text is None:
        return None
    text = text.strip()
    try:
        if text.isdecimal() and text.isascii() and len(text) in _EPOCH:
            return int(text) * _EPOCH[len(text)]
        if m := _COMPACT.match(text):
            y, mo, d, h, mi, s, z = m.groups()
            local = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0))
            if z is None:
                return local_micros(local, zone_name, h is None)
            offset = 0 if z in "zZ" else (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[-2:]))
            return _micros(local - _ZERO) - offset * 60_000_000
        for shape in _SHAPES:
            if m := shape.match(text):
                return _from_parts(m.groupdict(), zone_name, day_first)
    except (ValueError, OverflowError):
        pass
    return None


def _from_parts(g: dict, zone_name: str | None, day_first: bool | None) -> int | None:
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 2000
    if g.get("n1"):
        if day_first is None:
            return None
        day, month = (int(g["n1"]), int(g["n2"])) if day_first else (int(g["n2"]), int(g["n1"]))
    else:
        day, month = int(g["d"]), MONTHS[g["mon"][:3].lower()] if g.get("mon") else int(g["mo"])
    if g.get("wd") and date(year, month, day).weekday() != WEEKDAYS[g["wd"].lower()]:
        return None
    if g["h"] is None:
        return local_micros(datetime(year, month, day), zone_name, True)
    hour = int(g["h"])
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
    local = datetime(year, month, day, hour, int(g["mi"]), int(g["s"] or 0), int(((g["f"] or "") + "000000")[:6]))
    if g.get("usign"):
        offset = (1 if g["usign"] == "+" else -1) * (int(g["uh"]) * 60 + int(g["um"] or 0))
    elif g.get("sign"):
        offset = (1 if g["sign"] == "+" else -1) * (int(g["zh"]) * 60 + int(g["zm"] or 0))
    elif g.get("abbr"):
        name = g["abbr"].upper()
        if name in AMBIGUOUS:
            return _named_micros(local, zone_name, name)
        offset = ABBREVIATIONS.get(name)
        if offset is None:
            return None
    else:
        return local_micros(local, zone_name, False)
    if abs(offset) > 15 * 60:
        return None
    return _micros(local - _ZERO) - offset * 60_000_000
