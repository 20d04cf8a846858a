"""String, JSON and template expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keywords_of(description: Column) -> Column:
    """The pieces of a keyword rule: lower-cased, cut at '+', blanks kept."""
    return F.split(F.lower(description), "[+]", -1)


def contains_all(lowered_text: Column, keywords: Column) -> Column:
    """True when every keyword occurs in the text; an empty keyword always does.

    ``lowered_text`` has to be a lambda variable or a column of the frame itself (see
    ``once``), so that lower-casing is not repeated for each keyword.
    """
    return F.forall(keywords, lambda k: F.contains(lowered_text, k))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed a single time per row.

    Catalyst inlines a projected column into the expressions above it, even into a
    lambda that runs many times per row. Binding it as a lambda variable prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def int_or_text(label: Column) -> Column:
    """Labels as strings, whole numbers in their plain form ('07' -> '7')."""
    text = label.cast("string")
    return F.coalesce(text.try_cast("bigint").cast("string"), text)


def outer_json(content: Column) -> Column:
    """The stretch from the first '{' to the last '}' of a model answer."""
    return F.regexp_extract(content, r"(?s)\{.*\}", 0)


def parse_answer(content: Column, ddl: str) -> Column:
    """Lenient parse of a model answer: text around the object and raw control characters are fine."""
    return F.from_json(outer_json(content), ddl, {"allowUnquotedControlChars": "true"})


def section(title: str, body: Column) -> Column:
    """A titled prompt section, or null (and thus dropped by concat_ws) without a body."""
    return F.when(body.isNotNull(), F.concat(F.lit(f"## {title}\n"), body))


def prompt(*sections: Column) -> Column:
    return F.concat_ws("\n\n", *sections)


def seeded_order(seed: int | str, *parts: Column) -> Column:
    """A reproducible shuffling key: md5 of the seed and the given columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
