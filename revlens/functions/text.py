"""Column expressions for file / text values.

All of these are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen.  Each takes and returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.functions import constants as K

# Line breaks recognised by Python's str.splitlines(); "\r\n" counts once.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_loc(text) -> Column:
    """LOC of a file: number of newlines + 1, and 0 for empty text."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.lit(0).cast("bigint")).otherwise(
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("bigint"))


def part_loc(text) -> Column:
    """LOC of a split part: ``len(text.splitlines()) or 1``."""
    t = _c(text)
    breaks = F.regexp_count(t, F.lit(LINE_BREAK))
    tail = F.when(t.rlike("(" + LINE_BREAK + r")\z") | (F.length(t) == 0), 0).otherwise(1)
    return F.greatest(F.lit(1), breaks + tail).cast("bigint")


def token_estimate(text) -> Column:
    """Character-rule token estimate: max(1, round(chars / 3.5)).

    chars / 3.5 never ends on .5 for an integer number of chars, so HALF_UP
    rounding equals Python's half-even rounding here.
    """
    return F.greatest(F.lit(1), F.round(F.length(_c(text)) / F.lit(K.CHARS_PER_TOKEN)).cast("bigint"))


def byte_size(text) -> Column:
    return F.octet_length(_c(text)).cast("bigint")


def human_size(nbytes) -> Column:
    """B / KB / MB / GB / TB with two decimals (ties to even, as Python does
    on these exact binary fractions)."""
    n = _c(nbytes).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = None
    for i, unit in enumerate(units):
        scaled = n / F.lit(float(1024 ** i))
        text = F.format_string("%.2f %s", F.bround(scaled, 2), F.lit(unit))
        if i == len(units) - 1:
            expr = expr.otherwise(text)
        else:
            cond = scaled < 1024
            expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr


def safe_name(value) -> Column:
    """Runs outside [A-Za-z0-9._-] become '_', outer '_' trimmed, '' -> 'project'."""
    v = F.regexp_replace(_c(value), r"[^A-Za-z0-9._-]+", "_")
    v = F.regexp_replace(v, r"^_+|_+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("project"))


def file_name(relative) -> Column:
    return F.regexp_extract(_c(relative), r"([^/]*)$", 1)


def suffix(name) -> Column:
    """Path suffix as pathlib gives it: last '.x' of the name, none for
    leading-dot-only names or a trailing dot."""
    return F.regexp_extract(_c(name), r"^.+(\.[^.]+)$", 1)


# The blanks of Python's str.strip() (Java's \\s is ASCII only).
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_fences(raw) -> Column:
    """Trim blanks, then drop one leading ```json / ``` fence and one
    trailing fence (case-insensitive)."""
    blanks, rest = F.lit(BLANKS), (1 << 31) - 1
    t = F.btrim(_c(raw), blanks)
    t = (F.when(F.lower(F.substring(t, 1, 7)) == "```json", F.ltrim(F.substring(t, 8, rest), blanks))
         .when(t.startswith("```"), F.ltrim(F.substring(t, 4, rest), blanks)).otherwise(t))
    return F.when(t.endswith("```"), F.rtrim(F.substring(t, F.lit(1), F.length(t) - 3), blanks)).otherwise(t)


def html_escape(value) -> Column:
    v = _c(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def severity_rank(severity) -> Column:
    s = _c(severity)
    expr = F.when(s == K.SEVERITIES[0], 0)
    for i, name in enumerate(K.SEVERITIES[1:], 1):
        expr = expr.when(s == name, i)
    return expr.otherwise(K.UNKNOWN_SEVERITY_RANK)
