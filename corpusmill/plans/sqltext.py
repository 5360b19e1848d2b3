"""Pieces of SQL for the comparison queries, the counterparts of `functions.text` and `functions.names`."""

from __future__ import annotations

from corpusmill.functions.names import COUNTRIES, LABELS
from corpusmill.functions.text import CONTROLS, MARKERS, MISSING, PRINTED

WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}]"
_MISSING = ", ".join(f"'{x}'" for x in MISSING)


def collapse(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^{WS}+|{WS}+$', '', 'g')"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def plain(c: str) -> str:
    word = r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}]"
    return rf"trim(regexp_replace(regexp_replace({fold(collapse(c))}, '{word}', ' ', 'g'), '{WS}+', ' ', 'g'))"


def word_count(c: str) -> str:
    return f"len(list_filter(string_split({collapse(c)}, ' '), lambda x: x <> ''))"


def markers(c: str) -> str:
    return f"(length({c}) - length(translate({c}, '{''.join(MARKERS)}', '')))"


def read_again(c: str) -> str:
    possible = rf"regexp_matches({c}, '^[\x{{00}}-\x{{ff}}{PRINTED}]*$') AND NOT (regexp_matches({c}, '[{PRINTED}]') AND regexp_matches({c}, '[\x{{80}}-\x{{9f}}]'))"
    controls = "".join(f"' || chr({ord(x)}) || '" for x in CONTROLS)
    bits = f"array_to_string(list_transform(string_split(translate({c}, '{PRINTED}', '{controls}'), ''), lambda z: printf('%02x', unicode(z))), '')"
    return f"CASE WHEN {markers(c)} > 0 AND {possible} THEN try(decode(unhex({bits}))) END"


def identifier(c: str) -> str:
    return f"CASE WHEN lower({strip(c)}) IN ({_MISSING}) THEN '' ELSE {strip(c)} END"


def country(c: str) -> str:
    key = rf"regexp_replace(trim(replace(lower(trim(coalesce({c}, ''))), '-', ' ')), '\s+', '_', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items())
    return f"CASE {key} {cases} ELSE {key} END"


def source(c: str) -> str:
    t = rf"lower(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'))"
    rest = f"regexp_replace(CASE WHEN contains({t}, '://') THEN {t} ELSE '//' || {t} END, '^[^/]*//', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace({rest}, '[/?#].*$', ''), '^.*@', ''), ':[0-9]*$', '')"
    host = rf"regexp_replace(regexp_replace({host}, '^\.+|\.+$', '', 'g'), '^www\.', '')"
    return f"CASE WHEN {t} IN ({_MISSING}) THEN 'unknown' WHEN {host} <> '' THEN {host} ELSE regexp_replace({t}, '/+$', '') END"


def label_class(c: str) -> str:
    t = rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABELS.items()) + " END"
