"""Text normal forms, hashes and small text functions as column expressions.

The classes below are spelled out so that the JVM, Python and SQL engines agree on what white space and
word characters are; Java's own \\s and \\w differ from those of the others.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\u001c-\u001f\u0085\p{Z}"
#: Spellings of a missing identifier, in lower case.
MISSING = ["", "nan", "none", "<na>"]
#: Characters whose number decides between two readings of a text (fixed values).
MARKERS = ["Ð", "Ñ", "Ã", "Â", "Ä", "Å", "�"]
#: The printable characters of cp1252 that Latin-1 lacks, and the Latin-1 characters of the same bytes.
PRINTED = bytes(range(0x80, 0xA0)).decode("cp1252", "ignore")
CONTROLS = "".join(map(chr, PRINTED.encode("cp1252")))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), f"[{SPACE}]+", " "))


def fold(c: Column | str) -> Column:
    """Case folding: lower case, and the sharp s as ss. Use `casefold` for the full Unicode rules."""
    return F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss"))


def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x.casefold() if isinstance(x, str) else None)


def casefold(c: Column | str) -> Column:
    """Full Unicode case folding, by Arrow batches."""
    return F.pandas_udf(_casefold, "string")(_c(c))


def read_again(c: Column | str) -> Column:
    """The UTF-8 text whose bytes were shown as Latin-1 or cp1252 characters; NULL if a text can't be that.

    A byte from 0x80 to 0x9F is either a control character (Latin-1) or a printable one (cp1252), the same way all
    through a text; all other bytes look alike in both.
    """
    x = _c(c)
    possible = x.rlike(f"^[\\x{{00}}-\\x{{FF}}{PRINTED}]*$") & ~(x.rlike(f"[{PRINTED}]") & x.rlike(r"[\x{80}-\x{9F}]"))
    shown = F.encode(F.translate(F.when(possible, x), PRINTED, CONTROLS), "ISO-8859-1")
    return F.try_validate_utf8(shown.cast("string"))


def markers(c: Column | str) -> Column:
    """Number of MARKERS in a text."""
    return F.length(_c(c)) - F.length(F.translate(_c(c), "".join(MARKERS), ""))


def repair_marked(c: Column | str) -> Column:
    """Texts that are UTF-8 read as Latin-1 or cp1252 as a whole, read again where that leaves fewer MARKERS; all others as they are."""
    x = _c(c)
    again = read_again(F.when(x.rlike(f"[{''.join(MARKERS)}]"), x))
    return F.when(markers(again) < markers(x), again).otherwise(x)


def plain(c: Column | str) -> Column:
    """Folded text with everything but word characters taken as white space, in one pass; NULL becomes ''."""
    return F.trim(F.regexp_replace(fold(F.coalesce(_c(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column | str) -> Column:
    """Parts between white space; none for a blank text."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    """Number of parts between white space: blanks of the collapsed text and one."""
    x = collapse(c)
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1)


def text_hash(c: Column | str) -> Column:
    return F.sha2(plain(c), 256)


def prefix_hash(c: Column | str, n: int) -> Column:
    """Hash of the first n tokens of the plain text; '' if n is 0."""
    return F.sha2(F.array_join(F.slice(F.split(plain(c), " "), 1, n), " "), 256) if n else F.lit("")


def identifier(c: Column | str) -> Column:
    """Trimmed identifier; '' for NULL and the spellings of a missing one."""
    x = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(F.lower(x).isin(MISSING), "").otherwise(x)


def overlap_hash(c: Column | str) -> Column:
    """Hash of the plain text; '' for a blank one, so that blanks never match."""
    x = plain(identifier(c))
    return F.when(x == "", "").otherwise(F.sha2(x, 256))


def content_hash(c: Column | str) -> Column:
    """Hash of the collapsed text, case kept."""
    return F.sha2(collapse(c), 256)


def stripped_hash(c: Column | str) -> Column:
    """Hash of the text without outer white space."""
    return F.sha2(F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", ""), 256)


def _compatible(s: pd.Series) -> pd.Series:
    def clean(x: str) -> str:
        x = unicodedata.normalize("NFKC", x)
        return " ".join("".join(c for c in x if c in "\n\t" or unicodedata.category(c)[0] != "C").split())

    return s.map(lambda x: clean(x) if isinstance(x, str) else "")


def compatible(c: Column | str) -> Column:
    """Compatibility form (NFKC) without control characters, white space collapsed."""
    return F.pandas_udf(_compatible, "string")(_c(c))


def combined(title: Column | str, body: Column | str) -> Column:
    """Title, line end, body; both trimmed, NULL as ''."""
    t = lambda c: F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.concat(t(title), F.lit("\n"), t(body))


def title_body(c: Column | str, longest: int = 300) -> tuple[Column, Column]:
    """First nonblank line (at most `longest` characters) and the rest; the body falls back to the text."""
    x = F.coalesce(_c(c), F.lit(""))
    lines = F.filter(F.transform(F.split(x, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, longest), F.when(rest != "", rest).otherwise(F.trim(x))


def excerpt(c: Column | str, n: int) -> Column:
    """Collapsed text cut to n characters, with an ellipsis if something is cut."""
    x = collapse(c)
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def first_words(c: Column | str, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def slug(c: Column | str, keep: str = "A-Za-z0-9_.-") -> Column:
    """Every run of other characters as two underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(c), f"[^{keep}]+", "__"), "^_+|_+$", "")


def strip_fence(c: Column | str) -> Column:
    """The inside of a fenced code block, if the text is one."""
    return F.trim(F.regexp_replace(F.trim(_c(c)), r"^```[A-Za-z]*\s*|\s*```$", ""))


def first_number(c: Column | str) -> Column:
    """First number of a text; NULL if there is none."""
    return F.regexp_extract(_c(c), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def quoted(c: Column | str) -> Column:
    """Evidence without outer quotation marks and blanks."""
    return F.regexp_replace(collapse(c), "^[\"'“”„«»‘’\\s]+|[\"'“”„«»‘’\\s]+$", "")


def verbatim(text: Column | str, evidence: Column | str) -> Column:
    """Whether a quotation stands in a text, whatever its case; blank and missing quotations do not."""
    q = fold(quoted(evidence))
    return F.when(q.isin([*MISSING, "n/a", "null", "no", "-"]), False).otherwise(F.contains(fold(collapse(text)), q))


def passages_verbatim(versions: list[Column | str], evidence: Column | str) -> Column:
    """Whether every line of the evidence (bullets and quotation marks aside) stands in one of the versions of a text."""
    lines = F.transform(F.split(F.coalesce(_c(evidence), F.lit("")), "\n"), lambda l: fold(F.regexp_replace(collapse(l), "^[-*•\\s\"'“”„«»]+|[\"'“”„«»\\s]+$", "")))
    lines = F.filter(lines, lambda l: l != "")
    found = lambda l: reduce(lambda a, b: a | b, [F.contains(fold(collapse(v)), l) for v in versions])
    return (F.size(lines) > 0) & F.forall(lines, found)


def yes_no(c: Column | str) -> Column:
    """yes, no or unclear."""
    x = F.lower(F.trim(F.coalesce(_c(c).cast("string"), F.lit(""))))
    return F.when(x.isin("yes", "y", "true", "1"), "yes").when(x.isin("no", "n", "false", "0"), "no").otherwise("unclear")


def confidence(c: Column | str) -> Column:
    """A confidence on the scale 0 to 1: values above 1 are percentages, the result is clipped; NULL stays NULL."""
    x = _c(c).cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))


#: Characters with a meaning in LaTeX and what stands for them (fixed values).
LATEX = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_",
    "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}


def latex(x: object) -> str:
    """A driver-side value as LaTeX text."""
    return "".join(LATEX.get(c, c) for c in ("" if x is None else str(x)))
