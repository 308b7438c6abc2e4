"""Distributions, samples and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(c: Column) -> list[Column]:
    """min, median, mean, max and sample deviation (0 for one value)."""
    return [F.min(c).alias("min"), F.percentile(c, 0.5).alias("median"), F.avg(c).alias("mean"), F.max(c).alias("max"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")]


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (1..bins), n; the top edge belongs to the last bin, values outside the limits are left out.

    Without limits, from the least to the greatest value; one bin if they are equal.
    """
    limits = df.agg(F.lit(low).cast("double").alias("lo") if low is not None else F.min(value).cast("double").alias("lo"), F.lit(high).cast("double").alias("hi") if high is not None else F.max(value).cast("double").alias("hi"))
    x = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(limits)).filter(F.col(value).between(F.col("lo"), F.col("hi")))  # one row of limits
    place = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") + 1
    return x.select(F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), place)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def stratified(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """n rows of each stratum by the hash of key, with the inverse probability as weight; pick is the order."""
    w = Window.partitionBy(*strata)
    x = df.withColumns({"pool": F.count("*").over(w), "pick": F.row_number().over(w.orderBy(F.sha2(F.col(key).cast("string"), 256)))})
    return x.filter(F.col("pick") <= n).withColumn("weight", F.col("pool") / F.least(F.col("pool"), F.lit(n)))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that are there more than once: a key check passes if this is empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("r = 1").drop("r")
