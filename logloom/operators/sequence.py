"""Sequence operators over a session's ordered events: order within N steps, absence, change.

All are windows or aggregates of built-in functions; NULL is undecided throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.kleene import group_any3

SESSION = ("runtime", "session_id")


def order_within(events: DataFrame, first: Column, then: Column, within: int = 5, keys: tuple[str, ...] = SESSION, pos: str = "pos", step: Column | None = None) -> DataFrame:
    """Adds ``opened`` and ``followed``: was an event with ``first`` followed by one with ``then`` within ``within`` steps?

    A step is an event for which ``step`` holds (default: not a tool_result); the window ends at the
    ``within``-th later step, and other events inside it are still looked at. ``opened`` is true where
    ``first`` is true or undecided; ``followed`` is NULL for an undecided ``first``, else true if ``then`` is
    true inside the window, else undecided if it is undecided there, else false.

    Steps are counted by a running sum; the nearest later ``then`` is a running minimum over the events in
    reverse, which is linear where a frame that shrinks towards the end would be quadratic.
    """
    step = F.col("kind") != "tool_result" if step is None else step
    up = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    one = F.when(F.coalesce(step, F.lit(True)), 1).otherwise(0)
    df = events.withColumn("__one", one).withColumn("__count", F.sum("__one").over(up)).withColumn("__before", F.col("__count") - F.col("__one"))
    df = df.withColumn("__first", first).withColumn("__then", then)
    sure = F.min(F.when(F.col("__then"), F.col("__before"))).over(later)
    unsure = F.min(F.when(F.col("__then").isNull(), F.col("__before"))).over(later)
    end = F.col("__count") + within
    df = df.withColumn("opened", F.coalesce(F.col("__first"), F.lit(True)))
    followed = F.when(F.col("__first").isNull(), F.lit(None).cast("boolean")).when(F.coalesce(sure < end, F.lit(False)), True).when(F.coalesce(unsure < end, F.lit(False)), F.lit(None).cast("boolean")).otherwise(False)
    return df.withColumn("followed", F.when(F.col("opened"), followed)).drop("__one", "__count", "__before", "__first", "__then")


def absent(events: DataFrame, of: Column, scope: str = "session", keys: tuple[str, ...] = SESSION, pos: str = "pos") -> DataFrame:
    """One row per session (or per turn): ``turn`` of its last event, and ``found``, whether ``of`` held for any event (NULL: undecided).

    ``absent`` is true only where ``of`` is decidedly false everywhere.
    """
    if scope not in ("session", "turn"):
        raise ValueError(f"unknown scope {scope!r}")
    by = [*keys, "turn"] if scope == "turn" else list(keys)
    turn = [] if scope == "turn" else [F.max_by("turn", pos).alias("turn")]
    out = events.withColumn("__of", of).groupBy(*by).agg(*turn, group_any3(F.col("__of")).alias("found"), F.min(pos).alias(pos))
    return out.withColumn("absent", F.coalesce(~F.col("found"), F.lit(False)))


def change(events: DataFrame, field: Column, keep: Column | None = None, keys: tuple[str, ...] = SESSION, pos: str = "pos") -> DataFrame:
    """The events at which ``field`` differs from its value at the kept event before; ``keep`` says which events count."""
    df = events.withColumn("__value", field).where("__value is not null")
    if keep is not None:
        df = df.where(keep)
    before = F.lag("__value").over(Window.partitionBy(*keys).orderBy(pos))
    return df.withColumn("__before", before).where("__before is not null and __before <> __value").drop("__before", "__value")
