"""Spans in texts: merging, masking, and runs of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, start, end, kind: overlapping spans joined, the kind of the first (longest of equal starts).

    Spans that only touch stay apart; equal spans fall into one, whatever their order. Null starts come last.
    """
    w = Window.partitionBy(*by).orderBy(F.col("start").asc_nulls_last(), F.col("end").desc())
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    run = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"))).alias("kind")).drop("island")


def mask(docs: DataFrame, merged: DataFrame, label: str = "[AUTHORITY]", id: str = "id") -> DataFrame:
    """id, text with each span replaced by the label; n_masked."""
    s = merged.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    x = docs.select(id, "text").join(s, id, "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int>>")))
    begins = F.concat(F.array(F.lit(0)), F.col("s.end"))
    ends = F.concat(F.col("s.start"), F.array(F.length("text")))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return x.select(id, F.when(F.col("text").isNotNull(), F.array_join(kept, label)).alias("text"), F.size("s").cast("long").alias("n_masked"))


def drop_sections(paragraphs: DataFrame, by: list[str], order: str, starts: str, continues: str) -> DataFrame:
    """kept boolean for each paragraph: a removed run begins at a start and lasts while paragraphs continue it.

    starts and continues are boolean columns; the state is the latest event before the row.
    """
    event = F.when(F.col(starts), True).when(~F.col(continues), False)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))
    return paragraphs.withColumn("kept", ~(F.col(starts) | (state & F.col(continues))))
