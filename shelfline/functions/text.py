"""Text matching, escaping and display formats, as built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search ignores case and accents; keys also ignore trailing blanks.
SEARCH_COLLATION = "UNICODE_CI_AI"
KEY_COLLATION = "UNICODE_CI_AI_RTRIM"

# The five characters replaced in stored text, ampersand first.
HTML_ENTITIES = (
    ("&", "&amp;"),
    ('"', "&quot;"),
    ("'", "&#039;"),
    ("<", "&lt;"),
    (">", "&gt;"),
)

# Characters cut from both ends of submitted text.
TRIMMED = " \t\n\r\0\x0b"

# Month labels of the sales chart.
MONTH_LABELS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def key(column: str | Column) -> Column:
    """A natural key as it is compared: no case, accents or trailing blanks."""
    return F.collate(column, KEY_COLLATION)


def contains_lower(column: str | Column, term: str) -> Column:
    """Substring match ignoring case."""
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def matches(column: str | Column, term: str, mode: str = "literal") -> Column:
    """Substring match ignoring case and accents.

    ``mode="like"`` treats ``%`` and ``_`` in the term as wildcards.
    """
    if mode == "literal":
        return F.contains(F.collate(column, SEARCH_COLLATION), F.lit(term))
    if mode == "like":
        return _like(F.collate(column, SEARCH_COLLATION), term)
    raise ValueError(f"unknown search mode {mode!r}")


def _like(text: Column, term: str) -> Column:
    """Whether the parts of the term between ``%`` come one after another, as the collation compares.

    The first place where a part fits is enough for the parts after it. In a part
    ``_`` stands for one character, so its letters are compared place by place.
    """
    start, found = F.lit(1), text.isNotNull()
    for part in filter(None, term.split("%")):
        if "_" in part:
            last = F.length(text) - len(part) + 1
            places = F.when(last >= start, F.sequence(start, last))
            place = F.coalesce(F.try_element_at(F.filter(places, _fitting(text, part)), F.lit(1)), F.lit(0))
        else:
            place = F.call_function("locate", F.lit(part), text, start)
        found, start = found & (place > 0), place + len(part)
    return found


def _fitting(text: Column, part: str) -> Callable[[Column], Column]:
    """Whether the letters of the part stand at a place of the text, its ``_`` skipped."""
    runs = [(m.start(), m.group()) for m in re.finditer("[^_]+", part)]
    return lambda place: reduce(
        Column.__and__, [F.substring(text, place + o, F.lit(len(r))) == F.lit(r) for o, r in runs], F.lit(True)
    )


def escape_html(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    for char, entity in HTML_ENTITIES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def trimmed(column: str | Column) -> Column:
    return F.btrim(column, F.lit(TRIMMED))


def clean_input(column: str | Column) -> Column:
    """Submitted text as it is stored: trimmed, then escaped."""
    return escape_html(trimmed(column))


def digits_only(column: str | Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def phone_input(column: str | Column, digits: int = 15) -> Column:
    """What a phone field takes of a text: its digits, the first 15 of them."""
    return F.left(digits_only(column), F.lit(digits))


def is_digits(column: str | Column) -> Column:
    return F.rlike(column, F.lit(r"\A[0-9]+\z"))


def or_default(column: str | Column, default: str) -> Column:
    """The text, or ``default`` where it is NULL or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def thousands(column: str | Column) -> Column:
    """``1,234.50``; halves round away from zero."""
    return F.format_number(F.round(column, 2), 2)


def two_decimals(column: str | Column) -> Column:
    """``1234.50``; halves round away from zero."""
    return F.round(column, 2).cast("decimal(38,2)").cast("string")


def padded(column: str | Column, width: int) -> Column:
    """Zero-padded number; a longer number keeps all its digits."""
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def month_label(month: str) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in MONTH_LABELS]), F.col(month))
