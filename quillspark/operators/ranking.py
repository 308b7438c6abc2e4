"""Ranks, fusion and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense_rank(score: str, *by: str) -> Column:
    """Equal scores share a rank, highest first; NULL scores have none."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    return F.when(F.col(score).isNotNull(), F.dense_rank().over(w))


def ordinal_rank(score: str, *by: str, tie: tuple[str, ...] = ()) -> Column:
    """1, 2, 3 ... by score, ties by the columns of tie."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *tie))


def rrf(*ranks: Column, k: int = 20) -> Column:
    """Reciprocal rank fusion, added in the order given; a missing rank adds 0."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return out


def top_k(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """The first k rows of each group; the limit is pushed below the exchange by Catalyst."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def round_robin(df: DataFrame, by: list[str], turn: str, key: str, n: int) -> DataFrame:
    """n rows of each group of by, one from each value of turn in turn; order within by a hash of key."""
    first = Window.partitionBy(*by, turn).orderBy(F.sha2(F.col(key).cast("string"), 256))
    then = Window.partitionBy(*by).orderBy("lap", turn)
    return df.withColumn("lap", F.row_number().over(first)).withColumn("pick", F.row_number().over(then)).filter(F.col("pick") <= n)
