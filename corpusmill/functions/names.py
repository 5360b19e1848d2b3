"""Countries, outlets and labels in one spelling, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import MISSING, collapse
from corpusmill.functions.web import outlet_of

#: Spellings of the countries (fixed values).
COUNTRIES = {
    "bulgaria": "Bulgaria",
    "france": "France",
    "hungary": "Hungary",
    "italy": "Italy",
    "netherlands": "Netherlands",
    "the_netherlands": "Netherlands",
    "serbia": "Serbia",
    "sweden": "Sweden",
    "ukraine": "Ukraine",
    "uk": "United_Kingdom",
    "u_k": "United_Kingdom",
    "united_kingdom": "United_Kingdom",
    "great_britain": "United_Kingdom",
}
#: Order of the countries in reports.
COUNTRY_ORDER = sorted(set(COUNTRIES.values()))
#: Human and model labels and their class (fixed values).
LABELS = {"political corruption": 1, "no political corruption": 0, "mentioned but not central": 0}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def country(c: Column | str) -> Column:
    """A country in one spelling; an unknown one as its key."""
    x = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    key = F.regexp_replace(F.trim(F.replace(x, F.lit("-"), F.lit(" "))), r"\s+", "_")
    return F.coalesce(F.try_element_at(_map(COUNTRIES), key), key)


#: Names of countries that count tables write in another way (fixed values).
PLACES = {
    "UK": "United Kingdom",
    "United Kingdom of Great Britain and Northern Ireland": "United Kingdom",
    "United States of America": "United States",
    "Czech Republic": "Czechia",
    "Korea, South": "South Korea",
    "Türkiye": "Turkey",
}
_NOTE = r"\([^)]*\)|\[[^\]]*\]|[0-9]+|[*†]"


def place(c: Column | str) -> Column:
    """The country that a cell of a count table names: white space collapsed, without the notes, numbers and signs that follow it, in its usual name; NULL as ''."""
    x = F.replace(collapse(c), F.lit("_"), F.lit(" "))
    x = F.regexp_replace(F.regexp_replace(x, rf"(?:\s*(?:{_NOTE}))+\s*$", ""), r"^[\s*†:–—-]+|[\s*†:–—-]+$", "")
    return F.coalesce(F.try_element_at(_map(PLACES), x), x)


def is_place(c: Column | str, wanted: list[str] | None = None) -> Column:
    """Whether a cell can be the name of a country: at least three characters with a Latin letter, no address and no number to call; with `wanted`, only those names."""
    x = place(c)
    ok = (F.length(x) >= 3) & ~x.rlike("(?i)[:@<>]|www[.]|http|fax|phone")
    return ok & (x.isin(wanted) if wanted is not None else x.rlike("[A-Za-z]"))


def source(c: Column | str, decode: bool = False) -> Column:
    """The host that an address names, or 'unknown'; what names no host stays as it is without a last slash.

    With `decode`, punycode and escapes are undone as well (by Arrow batches).
    """
    x = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    if decode:
        return F.when(text.isin(MISSING), "unknown").otherwise(F.coalesce(outlet_of(x), F.regexp_replace(text, "/+$", "")))
    rest = F.regexp_replace(F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("//"), text)), "^[^/]*//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "[/?#].*$", ""), "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")
    return F.when(text.isin(MISSING), "unknown").when(host != "", host).otherwise(F.regexp_replace(text, "/+$", ""))


def label_class(c: Column | str) -> Column:
    """1, 0 or NULL for a label."""
    return F.try_element_at(_map(LABELS), F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")))


def country_rank(c: Column | str) -> Column:
    """Place of a country in the order of reports; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, COUNTRY_ORDER)), F.col(c) if isinstance(c, str) else c), F.lit(0)), F.lit(len(COUNTRY_ORDER) + 1))
