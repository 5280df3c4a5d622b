"""Text features as column expressions; order of rules and regex classes are spelled out for any language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def tokens(text: Column, shortest: int = 3) -> Column:
    """Distinct lower-case alphanumeric tokens of some length, in order of appearance."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-zа-яё0-9]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= shortest))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; null if either is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def plain_text(html: Column) -> Column:
    """Markup to text: scripts, styles and frames go, then tags, then doubled white space."""
    t = F.regexp_replace(html, r"(?is)<(script|style|iframe)[^>]*>.*?</(script|style|iframe)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"[\t\n\r][ \t\n\r]*| [ \t\n\r]+", " ")), r" ([.,;:!?])", "$1")  # single spaces stand already


def text_hash(text: Column) -> Column:
    """Digest of the squeezed lower-case text."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " ")), 256)
