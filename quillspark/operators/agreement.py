"""Agreement between raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nominal_alpha(ratings: DataFrame, by: list[str], unit: str = "unit", value: str = "value") -> DataFrame:
    """Krippendorff's alpha for nominal values; NULL ratings are missing, units with one rating do not count.

    From counts of values per unit, so no pairs of raters are formed.
    """
    n = ratings.filter(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count("*").alias("c"))
    n = n.withColumn("m", F.sum("c").over(Window.partitionBy(*by, unit))).filter("m > 1")
    seen = n.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("apart"))
    margin = n.groupBy(*by, value).agg(F.sum("c").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    x = seen.join(margin, by) if by else seen.crossJoin(margin)  # one row each
    expected = F.col("n") * F.col("n") - F.col("kk")
    return x.select(*by, F.when(expected > 0, 1 - (F.col("n") - 1) * F.col("apart") / expected).alias("alpha"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement and Cohen's kappa of two raters' 0/1 values; 1 if chance agreement is complete."""
    x = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("po"), F.avg(F.col(a)).alias("pa"), F.avg(F.col(b)).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return x.select("n", F.col("po").alias("agreement"), F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    def count(c):
        return F.count(F.when(c, True))

    tp, fp, fn, tn = count(predicted & actual), count(predicted & ~actual), count(~predicted & actual), count(~predicted & ~actual)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")]


def weighted_share(value: Column, weight: Column) -> list[Column]:
    """Weighted proportion, effective size (Kish) and the Wald interval cut to [0, 1]."""
    p = F.sum(F.when(value, weight).otherwise(0.0)) / F.sum(weight)
    n = F.sum(weight) * F.sum(weight) / F.sum(weight * weight)
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return [p.alias("share"), n.alias("effective_n"), F.greatest(F.lit(0.0), p - half).alias("low"), F.least(F.lit(1.0), p + half).alias("high")]


def majority(votes: DataFrame, by: list[str], value: str = "value", least: int = 2) -> DataFrame:
    """The value with the most votes, if it has at least ``least`` and no other has as many; else NULL."""
    c = votes.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    top = c.groupBy(*by).agg(F.max(F.struct("c", value)).alias("top"), F.max("c").alias("most"), F.array_sort(F.collect_list("c")).alias("all"))
    alone = F.size(F.filter("all", lambda x: x == F.col("most"))) == 1
    return top.select(*by, F.when(alone & (F.col("most") >= least), F.col(f"top.{value}")).alias("majority"))
