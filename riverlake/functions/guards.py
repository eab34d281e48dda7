"""Row checks that cannot be optimised away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Fail the job on the first row where ``ok`` is not true.

    The check is a filter, not a column: Spark drops an unused column together with
    any ``raise_error`` in it, but it always evaluates a filter.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(text)))


def keep_or_fail(rules: list[tuple[Column, str | None, Column]]) -> Column:
    """One filter out of ordered rules ``(condition, message, detail)``.

    The first rule that holds decides: a rule without a message drops the row, one with
    a message fails the job. A row that meets no rule is kept. Being a single CASE, the
    order survives the optimizer, so a dropped row is never checked by later rules.
    """

    def branch(message: str | None, detail: Column) -> Column:
        if message is None:
            return F.lit(False)
        return F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(detail, F.lit("null"))))

    first, *rest = rules
    chain = reduce(
        lambda case, rule: case.when(rule[0], branch(rule[1], rule[2])),
        rest,
        F.when(first[0], branch(first[1], first[2])),
    )
    return chain.otherwise(F.lit(True))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when ``df`` is empty. Reads no more than it takes to find one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df
