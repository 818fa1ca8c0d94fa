"""Comparison of benchmark runs: medians of runs, and the gate before a release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A slower time fails only if it is slower by both (fixed values).
SHARE, MILLISECONDS = 0.05, 3.0


def medians(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the medians of each run; bytes must agree over all runs."""
    each = runs.groupBy(*keys, "run").agg(F.median("seconds").alias("m"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    return each.groupBy(*keys).agg(F.median("m").alias("seconds"), F.min("lo").alias("bytes"), (F.min("lo") == F.max("hi")).alias("stable"))


def verdicts(base: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """``pass``, ``fail``, ``improved``, ``observed`` or ``missing`` for each key."""
    b, c = base.select(*keys, F.col("bytes").alias("b0"), F.col("seconds").alias("s0")), candidate.select(*keys, F.col("bytes").alias("b1"), F.col("seconds").alias("s1"))
    slower = F.col("s1") - F.col("s0")
    verdict = (
        F.when(F.col("b0").isNull() | F.col("b1").isNull(), "missing")
        .when(F.col("b1") > F.col("b0"), "fail")
        .when((slower > F.col("s0") * SHARE) & (slower * 1000 > MILLISECONDS), "fail")
        .when((F.col("b1") < F.col("b0")) | (slower < 0), "improved")
        .when(slower > 0, "observed")
        .otherwise("pass")
    )
    return b.join(c, keys, "full_outer").select(*keys, "b0", "b1", verdict.alias("verdict"))


def set_difference(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """What only one of two lists has: ``missing`` in the candidate, or ``new`` in it."""
    gone, new = base.exceptAll(candidate), candidate.exceptAll(base)
    return gone.withColumn("side", F.lit("missing")).unionByName(new.withColumn("side", F.lit("new")))
