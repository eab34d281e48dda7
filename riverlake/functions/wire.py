"""Fixed text forms of dates, instants and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverlake.schemas import DAILY, check_service

# The text forms that readers of exported rows expect.
DATE_FORMAT = "yyyy-MM-dd"
SECOND_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
MICROSECOND_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def datetime_text(datetime: Column, service: str) -> Column:
    is_daily = check_service(service) == DAILY
    return F.date_format(datetime, DATE_FORMAT if is_daily else SECOND_FORMAT)


def modified_text(last_modified: Column) -> Column:
    """Always the same width, so that text order is time order; empty when unknown."""
    return F.coalesce(F.date_format(last_modified, MICROSECOND_FORMAT), F.lit(""))


def shown_datetime(datetime: Column, service: str) -> Column:
    """The reading time at the precision it is exported with."""
    if check_service(service) == DAILY:
        return datetime
    return F.date_trunc("second", datetime)


def fixed_decimals(value: Column, places: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, ties to even.

    ``format_string`` would round the shortest decimal text of the double, half up.
    """
    pattern = "0." + "0" * places if places else "0"
    return (
        F.when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(F.call_function("format_number", value, F.lit(pattern)))
    )
