"""Web hosts and identifiers as written by hand."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "no value".
NO_OUTLET = frozenset({"", "unknown", "nan", "none", "null", "nil", "<na>", "na", "n/a", "nat", "undefined", "-", "--", "?"})
_SCHEME = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?//+")
_OPAQUE = re.compile(r"^(?:https?|feed|ftp|mailto):")


@lru_cache(maxsize=200_000)
def outlet(value: str | None) -> str | None:
    """The web host that an address names, in one spelling; None if it names none.

    Scheme, user, port, path, query, a leading www., outer dots and case are dropped; punycode labels and
    percent escapes are decoded and the result is in Unicode form C.
    """
    if value is None:
        return None
    s = unicodedata.normalize("NFKC", value).strip().strip("\"'<>").strip().casefold()
    if value.strip().casefold() in NO_OUTLET or s in NO_OUTLET:
        return None
    s = _OPAQUE.sub("", _SCHEME.sub("", s)) if "//" in s[:12] or _OPAQUE.match(s) else s
    s = s.lstrip("/")
    s = re.split(r"[/?#\\]", s, maxsplit=1)[0].rpartition("@")[2]
    s = re.sub(r":\d*$", "", s)
    if "%" in s:
        s = unquote(s)
    s = s.strip().strip(".")
    if "xn--" in s:
        s = ".".join(map(_label, s.split(".")))
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold())
    s = s.removeprefix("www.").strip(".")
    return None if s in NO_OUTLET else s


def _label(x: str) -> str:
    if not x.startswith("xn--"):
        return x
    try:
        return x[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError):
        return x


def _outlets(s: pd.Series) -> pd.Series:
    return s.map(lambda x: outlet(x) if isinstance(x, str) else None)


def outlet_of(c: Column | str) -> Column:
    """`outlet` as a column expression; Arrow batches, one dictionary lookup per repeated value."""
    return F.pandas_udf(_outlets, "string")(F.col(c) if isinstance(c, str) else c)


#: A uri that is one of these, in any case, is none.
NO_IDENTIFIER = ["", "nan", "none", "<na>"]


def identifier(c: Column | str) -> Column:
    """A uri without outer white space and in lower case; NULL if it is blank or a placeholder for none."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s\u001c-\u001f\u0085\p{Z}]+|[\s\u001c-\u001f\u0085\p{Z}]+$", ""))
    return F.when(~x.isin(NO_IDENTIFIER), x)
