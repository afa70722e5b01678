"""Values that later ones use many times, worked out once.

Spark puts the expression of a column into every filter above it, as often as the filter names the column, and into the body of
a lambda; long chains of columns then grow to many times their length. What is bound here keeps its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once for a row however often use names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def once(rows: DataFrame, record: Column, keep: list[str]) -> DataFrame:
    """The columns keep and the fields of record, a struct; rows with a null record are dropped. Filters above aren't worked
    into the record's expression."""
    return rows.select(*keep, F.inline(F.array_compact(F.array(record))))
