"""Text to typed values, strictly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The agency prefix of a bare site number and the accepted text forms.
AGENCY_PREFIX = "USGS-"
DATE_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
INSTANT_TEXT = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
    r"([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
)
NUMBER_TEXT = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def site_id(text: Column) -> Column:
    """A bare number gets the agency prefix; an id that has one is left alone."""
    trimmed = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return F.when(F.contains(trimmed, F.lit("-")), trimmed).otherwise(
        F.concat(F.lit(AGENCY_PREFIX), trimmed)
    )


def site_ids(text: Column) -> Column:
    """A comma-separated list of sites as an array of ids."""
    return F.transform(F.split(text, ","), site_id)


def number(text: Column) -> Column:
    """A double, or null if the text is not a plain number.

    ``try_cast`` alone would also take blanks around it and the suffixes d and f.
    """
    # Of the accepted forms the cast knows all but a NaN with a sign.
    parsed = F.coalesce(text.try_cast("double"), F.lit(float("nan")))
    return F.when(text.rlike(NUMBER_TEXT), parsed)


def local_date(text: Column) -> Column:
    """A bare ``YYYY-MM-DD``, or null."""
    return F.when(text.rlike(DATE_TEXT), text.try_cast("date"))


def instant(text: Column) -> Column:
    """An RFC 3339 time with its offset, as a UTC timestamp, or null."""
    return F.when(text.rlike(INSTANT_TEXT), F.upper(text).try_cast("timestamp"))


def unescaped(path: Column) -> Column:
    """Part of a path with each ``%XX`` turned back into its character."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def joined_text(value: Column) -> Column:
    """A variant holding a string or a list of strings, as one comma-joined string."""
    kind = F.schema_of_variant(value)
    joined = F.array_join(F.try_variant_get(value, "$", "array<string>"), ",")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        kind == "ARRAY<STRING>", joined
    )


def is_text_or_texts(value: Column) -> Column:
    """Whether a variant is absent, null, a string, or a list of strings without nulls."""
    items = F.try_variant_get(value, "$", "array<string>")
    return (
        F.when(value.isNull(), True)
        .when(F.schema_of_variant(value) == "ARRAY<STRING>", ~F.exists(items, F.isnull))
        .otherwise(F.schema_of_variant(value).isin("STRING", "VOID", "ARRAY<VOID>"))
    )


def strict_date(text: str, label: str) -> dt.date:
    """A date given as YYYY-MM-DD; anything else is an error that names it."""
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as error:
        raise ValueError(f"{label} date {text!r} is not a YYYY-MM-DD date") from error
