"""Hits against labels: precision, recall, and what falls below a floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_key(turn: Column, tool_use_id: Column) -> Column:
    """``turn:id``, or ``turn:-`` without an id."""
    return F.concat(turn.cast("string"), F.lit(":"), F.coalesce(F.nullif(tool_use_id, F.lit("")), F.lit("-")))


def validity_counts(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(detector, positives, negatives, tp, fp, fn) of the detectors that labels name.

    ``hits``: session, key, detector; ``labels``: session, key, detector, polarity (fire or near). A hit on
    anything but a ``fire`` label is a false positive. Repeated hits and labels count once.
    """
    fire = labels.where("polarity = 'fire'").select("session", "key", "detector").distinct().withColumn("wanted", F.lit(True))
    near = labels.where("polarity = 'near'").select("session", "key", "detector").distinct().groupBy("detector").agg(F.count("*").alias("negatives"))
    named = labels.select("detector").distinct()
    found = hits.select("session", "key", "detector").distinct().join(named, "detector", "left_semi").withColumn("found", F.lit(True))
    met = fire.join(found, ["session", "key", "detector"], "full_outer").groupBy("detector").agg(
        F.count_if(F.col("wanted")).alias("positives"),
        F.count_if(F.col("wanted") & F.col("found")).alias("tp"),
        F.count_if(F.col("found") & F.col("wanted").isNull()).alias("fp"),
        F.count_if(F.col("wanted") & F.col("found").isNull()).alias("fn"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(met, "detector", "left").join(near, "detector", "left").select("detector", zero("positives"), zero("negatives"), zero("tp"), zero("fp"), zero("fn"))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, rounded to four places; without any hit or miss they are 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = precision(tp, fp, fn), recall(tp, fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def total(counts: DataFrame) -> DataFrame:
    """The counts with one more row, ``(all)``, over all detectors."""
    names = ("positives", "negatives", "tp", "fp", "fn")
    return counts.rollup("detector").agg(*[F.sum(n).alias(n) for n in names], F.grouping("detector").alias("g")).select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("detector")).alias("detector"), *names)


def below_floor(scored: DataFrame, floor: float = 0.9) -> DataFrame:
    return scored.where((F.col("precision") < floor) | (F.col("recall") < floor)).select("detector").orderBy("detector")
