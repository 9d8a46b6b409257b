"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words without retrieval content.
STOPWORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "did", "do", "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "how",
    "i", "in", "is", "it", "its", "me", "my", "of", "on", "or", "our", "she", "that", "the", "their", "them", "they", "this", "to", "us", "was", "we",
    "were", "what", "when", "where", "which", "who", "whom", "why", "with", "you", "your",
)

# Case-folding pairs that differ from lower-casing.
FOLD = {"ß": "ss", "ſ": "s", "ς": "σ", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "µ": "μ"}

QUOTED = "[\"“”‘’]([^\"“”‘’]{8,})[\"“”‘’]"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tokens(text: Column | str) -> Column:
    """Runs of ASCII letters and digits after lower-casing; accents split words."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def informative(tokens_col: Column) -> Column:
    """Distinct tokens longer than one character that are not stop words."""
    kept = F.filter(tokens_col, lambda t: F.length(t) > 1)
    return F.array_except(kept, F.array(*[F.lit(w) for w in STOPWORDS]))


def coverage(question: Column | str, text: Column | str) -> Column:
    """Share of the question's informative tokens that occur in the text."""
    wanted = informative(tokens(question))
    found = F.size(F.array_intersect(wanted, tokens(text)))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(found.cast("double") / F.size(wanted))


def casefold(text: Column | str) -> Column:
    out = F.lower(_c(text))
    for source, target in FOLD.items():
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def collapse(text: Column | str) -> Column:
    """Whitespace runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def text_key(text: Column | str, fold: bool = False) -> Column:
    """Word characters only, lower-cased: the key under which facts are equal."""
    base = casefold(text) if fold else F.lower(_c(text))
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}_]+", " "))


def identity_key(value: Column | str) -> Column:
    """Name key: no leading @, case-folded, single blanks."""
    return collapse(casefold(F.regexp_replace(collapse(F.coalesce(_c(value), F.lit(""))), "^@+", "")))


def natural_key(value: Column | str) -> Column:
    """Sort key in which digit runs compare by value and other runs by letter."""
    parts = F.regexp_extract_all(F.coalesce(_c(value), F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), F.lower(p))),
        ),
        "\x01",
    )


def quotes(question: Column | str) -> Column:
    """Normalised quoted passages of at least eight characters."""
    found = F.regexp_extract_all(_c(question), F.lit(QUOTED), F.lit(1))
    return F.filter(F.transform(found, lambda q: F.array_join(tokens(q), " ")), lambda q: q != "")


def distinct_nonempty(values: Column) -> Column:
    """Trimmed, non-empty, first occurrence kept."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")))


def distinct_by_key(values: Column, key) -> Column:
    """First value per key, for keys that are not the value itself."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: (F.element_at(keys, i + 1) != "") & (F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))


def strip_speaker(text: Column | str, speaker: Column | str) -> Column:
    """Drop one leading ``speaker:`` label."""
    body = F.regexp_replace(_c(text), r"^\s+", "")
    rest = F.regexp_replace(F.substr(body, F.length(_c(speaker)) + 1), r"^\s*:\s*", "")
    labelled = F.startswith(body, _c(speaker)) & F.substr(body, F.length(_c(speaker)) + 1).rlike(r"^\s*:")
    return F.trim(F.when(labelled, rest).otherwise(_c(text)))
