"""Predicates that mark faulty outputs, fixed from the original output: columns for rows, functions for RDD records."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest(output: DataFrame, column: str) -> Column:
    """At or below the original minimum; nothing is faulty in an empty output."""
    least = output.agg(F.min(column)).first()[0]
    return F.col(column) <= least if least is not None else F.lit(False)


def highest(output: DataFrame, column: str) -> Column:
    most = output.agg(F.max(column)).first()[0]
    return F.col(column) >= most if most is not None else F.lit(False)


def far_from_median(output: DataFrame, column: str, k: float) -> Column:
    """More than k population standard deviations from the median.

    The median is the element at place floor(n / 2) of the sorted values; nulls have no place.
    """
    n, deviation = output.agg(F.count(column), F.stddev_pop(column)).first()
    if not n:
        return F.lit(False)
    # half an element further, so that rounding of the share cannot reach a neighbour
    share = (n // 2 + 0.5) / n
    middle = output.agg(F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY {column})")).first()[0]
    return F.abs(F.col(column) - middle) > k * deviation


def missing(column: str) -> Column:
    """Null or NaN."""
    return F.col(column).isNull() | F.isnan(F.col(column).cast("double"))


def below(column: str, value: float) -> Column:
    return F.col(column) < value


def above(column: str, value: float) -> Column:
    return F.col(column) > value


# for RDD records: ``of`` takes the value to judge from a record

Oracle = Callable[[RDD], Callable[[Any], bool]]


def rdd_lowest(of: Callable[[Any], Any]) -> Oracle:
    def fixed(output: RDD) -> Callable[[Any], bool]:
        values = output.map(of).filter(lambda v: not is_missing(v))
        least = None if values.isEmpty() else values.min()
        return lambda record: least is not None and not is_missing(of(record)) and of(record) <= least

    return fixed


def rdd_highest(of: Callable[[Any], Any]) -> Oracle:
    def fixed(output: RDD) -> Callable[[Any], bool]:
        values = output.map(of).filter(lambda v: not is_missing(v))
        most = None if values.isEmpty() else values.max()
        return lambda record: most is not None and not is_missing(of(record)) and of(record) >= most

    return fixed


def rdd_far_from_median(of: Callable[[Any], Any], k: float) -> Oracle:
    def fixed(output: RDD) -> Callable[[Any], bool]:
        values = output.map(of).filter(lambda v: not is_missing(v)).map(float)
        found = values.stats()
        if not found.count():
            return lambda record: False
        place, deviation = found.count() // 2, found.stdev()
        middle = values.sortBy(lambda v: v).zipWithIndex().filter(lambda x: x[1] == place).keys().first()
        return lambda record: not is_missing(of(record)) and abs(of(record) - middle) > k * deviation

    return fixed


def rdd_missing(of: Callable[[Any], Any]) -> Oracle:
    return lambda output: lambda record: is_missing(of(record))


def is_missing(value: Any) -> bool:
    return value is None or isinstance(value, float) and math.isnan(value)
