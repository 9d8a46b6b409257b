"""Date and coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import _c

UNKNOWN_DATE = "9999-12-31"
LAST_ORDINAL = 2**31 - 1


def date_prefix(value: Column | str) -> Column:
    """ISO date at the start of a date or date-time string, NULL if not a real date."""
    part = F.regexp_extract(_c(value), r"^\s*(\d{4}-\d{2}-\d{2})(?:[Tt ].*)?\s*$", 1)
    return F.when(F.try_to_date(part, "yyyy-MM-dd").isNotNull(), part)


def explicit_date(question: Column | str) -> Column:
    """First ISO date of this century written in the question, else NULL."""
    found = F.regexp_extract(_c(question), r"(?U)\b(20\d{2}-\d{2}-\d{2})\b", 1)
    return F.when(found != "", found)


def session_number(session: Column | str) -> Column:
    """Number of an ``S<n>`` session id; others sort last."""
    return F.coalesce(F.regexp_extract(_c(session), r"^S(\d+)$", 1).try_cast("int"), F.lit(10**9))


def coordinates(ref: Column | str) -> Column:
    """Session and ordinal read from the three id grammars."""
    ref = _c(ref)
    grammars = [r"(?i)(?:^|:)(session\d+):(\d+)$", r"(?i)(?:^|:)(D\d+):(\d+)$", r"(?i)(?:^|:)(S\d+)_T(\d+)$"]
    session = F.coalesce(*[F.nullif(F.regexp_extract(ref, g, 1), F.lit("")) for g in grammars], F.lit(""))
    ordinal = F.coalesce(*[F.regexp_extract(ref, g, 2).try_cast("int") for g in grammars])
    return F.struct(session.alias("session"), ordinal.alias("ordinal"))


def unified_turn_id(session: Column | str, turn_idx: Column | str) -> Column:
    """``<session>_T<one-based, three digits>``."""
    return F.format_string("%s_T%03d", _c(session), (_c(turn_idx) + 1).cast("int"))
