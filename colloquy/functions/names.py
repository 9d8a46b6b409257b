"""Spoken-name expressions for identity evidence in transcripts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import _c, casefold

# Fixed values.
HONORIFICS = (
    "mr", "mrs", "ms", "dr", "doctor",
)
NON_NAMES = (
    "absolutely", "actually", "agreed", "ah", "alright", "amazing", "and", "anyhow", "anyway", "anytime", "awesome", "aw", "coming", "congrats",
    "cool", "definitely", "everyone", "everybody", "exactly", "excellent", "father", "fine", "first", "folks", "good", "gosh", "grandma", "grandpa",
    "gotcha", "great", "hello", "here", "hey", "hi", "hmm", "haha", "honestly", "man", "mhm", "mom", "mother", "morning", "nah", "next", "nice", "no",
    "nope", "noted", "now", "oh", "okay", "perfect", "phew", "remember", "right", "saved", "seriously", "so", "sure", "team", "thanks", "ugh", "um",
    "understood", "wait", "welcome", "well", "wonderful", "wow", "yeah", "yep", "yes",
)

# Name patterns.
_NAME = r"(?:(?:Ms|Mr|Mrs|Dr)\.?\s+)?[A-Z][A-Za-z'’-]+"
SELF_NAME = r"(?U)\b(?i:I(?:'|’)m|I am|my name is|this is)\s+(" + _NAME + r"(?:\s+[A-Z][A-Za-z'’-]+){1,2})\b"
_GREETING = r"(?:(?i:oh)\s*[,!-]?\s+)?(?:(?i:hey|hi|hello|thanks|okay|alright|so)\s*[,!-]?\s+)?"
LEADING = r"^\s*" + _GREETING + "(" + _NAME + r"(?:\s+[A-Z][A-Za-z'’-]+){0,2})\s*[,!:]"
TRAILING = r",\s*(" + _NAME + r"(?:\s+[A-Z][A-Za-z'’-]+){0,2})\s*[?!.]\s*$"
MIDDLE = r",\s*(" + _NAME + r"(?:\s+[A-Z][A-Za-z'’-]+){0,2})\s*[!?:.]"
SECOND_VOCATIVE = r"^\s*(?:and\s+)?[A-Z][A-Za-z'’-]+\s*[,—-]"


def norm(name: Column | str) -> Column:
    """Lower-case ASCII words of a name."""
    return F.trim(F.regexp_replace(casefold(F.coalesce(_c(name), F.lit(""))), "[^a-z]+", " "))


def core(name: Column | str) -> Column:
    """Name words without leading honorifics."""
    return F.regexp_replace(norm(name), "^(?:(?:" + "|".join(HONORIFICS) + ")(?: |$))+", "")


def words(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w != "")


def plausible(name: Column | str) -> Column:
    """One to three name words, none of them a filler word."""
    parts = words(core(name))
    return F.size(parts).between(1, 3) & ~F.arrays_overlap(parts, F.array(*[F.lit(w) for w in NON_NAMES]))


def same_family(left: Column | str, right: Column | str) -> Column:
    """Equal names, or a single word that is the other's first word."""
    a, b = core(left), core(right)
    wa, wb = words(a), words(b)
    one_sided = (F.size(wa) == 1) & (F.size(wb) >= 2) | (F.size(wb) == 1) & (F.size(wa) >= 2)
    return (a != "") & (b != "") & ((a == b) | (one_sided & (F.get(wa, F.lit(0)) == F.get(wb, F.lit(0)))))


def addresses(text: Column | str, name: Column | str) -> Column:
    """The text opens or closes by addressing the name."""
    body = F.lower(_c(text))
    pattern = F.array_join(words(norm(name)), r"\s+")
    # The two address patterns.
    lead = F.concat(F.lit(r"^\s*(?:oh\s*[,!-]?\s+)?(?:(?:hey|hi|hello|thanks|okay|alright|so)\s*[,!-]?\s+)?"), pattern, F.lit(r"\s*[,!:]"))
    trail = F.concat(F.lit(r",\s*"), pattern, F.lit(r"\s*[?!.]?\s*$"))
    return (norm(name) != "") & plausible(name) & (F.regexp_like(body, lead) | F.regexp_like(body, trail))


def mentions(text: Column | str, name: Column | str) -> Column:
    """The normalised name occurs as whole words of the text."""
    return (norm(name) != "") & F.contains(F.concat(F.lit(" "), norm(text), F.lit(" ")), F.concat(F.lit(" "), norm(name), F.lit(" ")))
