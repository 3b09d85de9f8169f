"""Expressions evaluated once, where the optimizer would otherwise copy them to each place of use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, even where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its costly ``columns`` worked out once per row.

    Filters on them would be pushed below their expressions, and so evaluate these again for every
    condition; they are not pushed below a generator.
    """
    other = [c for c in df.columns if c not in columns]
    return df.select(*other, F.explode(F.array(F.struct(*columns))).alias("_once")).select(*other, "_once.*")
