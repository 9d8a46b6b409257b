"""Content ids: the byte layout of the canonical JSON is part of the contract."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import _c


def json_string(value: Column | str) -> Column:
    """One JSON string literal, non-ASCII kept."""
    encoded = F.to_json(F.array(F.coalesce(_c(value), F.lit(""))))
    return F.substring(encoded, F.lit(2), F.length(encoded) - 2)


def json_list(values: Column | str) -> Column:
    """JSON list of strings with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(values), json_string), ", "), F.lit("]"))


def fact_id(speaker: Column | str, key: Column | str, refs: Column | str, speaker_field: str = "speaker") -> Column:
    """``fact:`` and sixteen hex digits over speaker, text key and references."""
    fields = {"refer_ids": json_list(refs), speaker_field: json_string(speaker), "text": json_string(key)}
    parts: list[Column] = [F.lit("{")]
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(f'{", " if i else ""}"{name}": '), fields[name]]
    body = F.concat(*parts, F.lit("}"))
    return F.concat(F.lit("fact:"), F.substring(F.sha1(body), 1, 16))


def panel_key(seed: str, case: Column | str, item: Column | str) -> Column:
    """Sampling key that depends on ids only."""
    return F.sha2(F.concat_ws("|", F.lit(seed), _c(case), _c(item).cast("string")), 256)
