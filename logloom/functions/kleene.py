"""Three-valued logic on columns: NULL is *undecided*, never false.

AND, OR and NOT of SQL already are the logic; what SQL lacks is an OR over a group that keeps NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any3(conditions: list[Column]) -> Column:
    """True if any is true, else undecided if any is undecided, else false; of none false."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def all3(conditions: list[Column]) -> Column:
    """False if any is false, else undecided if any is undecided, else true; of none true."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def not3(condition: Column) -> Column:
    return ~condition


def group_any3(condition: Column) -> Column:
    """:func:`any3` as an aggregate over a group's rows; of an empty group false."""
    undecided = F.count("*") > F.count(condition)
    return F.when(F.coalesce(F.bool_or(condition), F.lit(False)), True).when(undecided, F.lit(None).cast("boolean")).otherwise(False)


def group_all3(condition: Column) -> Column:
    """:func:`all3` as an aggregate; of an empty group true."""
    undecided = F.count("*") > F.count(condition)
    return F.when(~F.coalesce(F.bool_and(condition), F.lit(True)), False).when(undecided, F.lit(None).cast("boolean")).otherwise(True)
