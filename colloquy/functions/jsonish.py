"""JSON objects in free model text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import _c


def object_text(raw: Column | str, probe: str = "MAP<STRING, STRING>") -> Column:
    """First of: the whole text, a fenced block, outermost braces, that parses as an object.

    NULL when none of them does.
    """
    text = F.trim(F.coalesce(_c(raw), F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def parsed(candidate: Column) -> Column:
        ok = candidate.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(candidate).isNotNull()
        return F.when(ok, candidate)

    return F.coalesce(parsed(text), parsed(fenced), parsed(braces))


def truthy(value: Column | str) -> Column:
    """Model booleans: true, or the word true."""
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))) == "true", F.lit(False))
