"""Readings of a written timestamp: every format that fits gives one instant."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Capital's zone of each country (fixed values).
COUNTRY_ZONE = {
    "bulgaria": "Europe/Sofia",
    "france": "Europe/Paris",
    "hungary": "Europe/Budapest",
    "italy": "Europe/Rome",
    "netherlands": "Europe/Amsterdam",
    "serbia": "Europe/Belgrade",
    "sweden": "Europe/Stockholm",
    "ukraine": "Europe/Kyiv",
    "united_kingdom": "Europe/London",
}

#: Hours east of Greenwich of zone abbreviations (fixed values).
ABBREVIATION = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "bst": 1, "ist": 1, "cet": 1, "cest": 2, "mez": 1, "mesz": 2,
    "eet": 2, "eest": 3, "msk": 3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}
_MONTH = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}

_TIME = r"(?P<H>\d{1,2})[:.](?P<M>\d\d)(?:[:.](?P<S>\d\d)(?:[.,]\d+)?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?P<z>[Zz]|(?:UTC|GMT)?[+\-−]\d\d(?::?\d\d)?(?::?\d\d)?|[A-Za-z]{2,5})?\s*(?:\[(?P<region>[A-Za-z_]+(?:/[A-Za-z_\-]+)*)\]|\((?P<note>[A-Za-z ]+)\))?"
_SEP = r"(?:[T,]?\s*|\s+(?:kl\.?|at|um|à|alle|u|om)\s*)"


def _format(pattern: str, time: bool = True) -> re.Pattern:
    return re.compile(rf"(?:[^\W\d]{{2,10}}\.?,?\s+)?{pattern}(?:{_SEP}{_TIME}{_ZONE})?$" if time else pattern + "$")


#: name -> pattern. An all-numeric date that ends in the year has two readings.
FORMATS = {
    "ymd": _format(r"(?P<y>\d{4})[\-/.](?P<m>\d{1,2})[\-/.](?P<d>\d{1,2})\.?"),
    "ymd_spaced": _format(r"(?P<y>\d{4})\.\s+(?P<m>\d{1,2})\.\s+(?P<d>\d{1,2})\.?"),
    "dmy": _format(r"(?P<d>\d{1,2})[\-/.]\s?(?P<m>\d{1,2})[\-/.]\s?(?P<y>\d{4})\.?"),
    "mdy": _format(r"(?P<m>\d{1,2})[\-/.]\s?(?P<d>\d{1,2})[\-/.]\s?(?P<y>\d{4})\.?"),
    "d_name_y": _format(r"(?P<d>\d{1,2})(?:st|nd|rd|th|\.)?[\s\-]+(?P<b>[A-Za-z]{3,9})\.?,?[\s\-]+(?P<y>\d{4})"),
    "name_d_y": _format(r"(?P<b>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})"),
    "compact": re.compile(rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?:[T ]?(?P<H>\d\d):?(?P<M>\d\d)(?::?(?P<S>\d\d)(?:[.,]\d+)?)?{_ZONE})?$"),
    "ctime": re.compile(rf"[A-Za-z]{{3}}\s+(?P<b>[A-Za-z]{{3}})\s+(?P<d>\d{{1,2}})\s+{_TIME}\s*(?P<z>[A-Za-z]{{2,5}})?\s+(?P<y>\d{{4}})(?P<region>)?$"),
    "epoch": re.compile(r"(?P<epoch>-?\d{9,10}(?:\.\d+)?|\d{12,13}|\d{15,16}|\d{18,19})$"),
}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(maxsize=1000)
def zone_of(country: str | None) -> ZoneInfo | None:
    """The zone of a country's capital, or None for an unknown country."""
    key = re.sub(r"[\s\-]+", "_", country.strip().casefold()) if country else ""
    name = COUNTRY_ZONE.get({"uk": "united_kingdom", "great_britain": "united_kingdom", "the_netherlands": "netherlands"}.get(key, key))
    return ZoneInfo(name) if name else None


@lru_cache(maxsize=1000)
def _region(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=10_000)
def _zone(text: str | None, region: str | None):
    """An explicit zone; None if there is none; False if it is not one."""
    if text:
        t = text.strip().replace("−", "-")
        if t.lower() in ABBREVIATION:
            return timezone(timedelta(hours=ABBREVIATION[t.lower()]))
        if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d):?(\d\d)?(?::?(\d\d))?", t):
            shift = timedelta(hours=int(m[2]), minutes=int(m[3] or 0), seconds=int(m[4] or 0))
            return timezone(shift if m[1] == "+" else -shift) if shift < timedelta(hours=24) else False
        return False
    if region:
        return _region(region) or False
    return None


def readings(value: str | None, country: str | None) -> list[tuple[str, int, bool]]:
    """(format, seconds since 1970, zone was explicit) of every reading of a value.

    Fractions of a second are cut off. Without an explicit offset or zone it is wall time in the
    country's capital: the first of two if it occurs twice, moved forward by the hour skipped if it does
    not occur; in an unknown country it is UTC. Equal instants under two formats are one reading.
    """
    s = value.strip() if value else ""
    if not s or not any(c.isdigit() for c in s):
        return []
    out = []
    for name, pattern in FORMATS.items():
        if not (m := pattern.match(s)):
            continue
        g = m.groupdict()
        if e := g.get("epoch"):
            whole = e.split(".")[0]
            digits = len(whole.lstrip("-"))
            out.append((name, int(whole) // {9: 1, 10: 1, 12: 1000, 13: 1000, 15: 10**6, 16: 10**6, 18: 10**9, 19: 10**9}[digits], True))
            continue
        month = _MONTH.get(g["b"][:3].lower()) if g.get("b") else int(g["m"])
        hour = int(g["H"] or 0)
        if ap := g.get("ap"):
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + 12 * (ap[0] in "pP")
        zone = _zone(g.get("z"), g.get("region"))
        if month is None or zone is False:
            continue
        try:
            extra = timedelta(days=1) if hour == 24 and not int(g["M"] or 0) and not int(g["S"] or 0) else timedelta(0)
            wall = datetime(int(g["y"]), month, int(g["d"]), 0 if extra else hour, int(g["M"] or 0), min(59, int(g["S"] or 0)) if g["S"] == "60" else int(g["S"] or 0)) + extra
            t = wall.replace(tzinfo=zone if zone is not None else zone_of(country) or UTC)
            out.append((name, int((t - _EPOCH) // timedelta(seconds=1)), zone is not None))
        except (ValueError, OverflowError):
            continue
    return out
