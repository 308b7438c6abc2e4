"""Paragraphs and sentences of a document, numbered, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Section headers, sub-section headers, list items, embedded section starts, sentence ends.
SECTION = r"(?iU)^(Section|Sec\.)\s+\d+\s*\.(?!\d)"
SUB_HEADERS = [r"(?U)^\d+-\d+\.\s+\S", r"(?U)^[A-Z]\.\s+[A-Za-z]", r"(?U)^[IVX]{2,}\.\s+[A-Za-z]"]
BULLET = r"(?U)^[•\-\*]\s"
ITEM = r"(?iU)^(\(\d+\)|\([a-z]\)|\([ivxlcdm]+\)|\d+\.)\s"
EMBEDDED = r"(?iU)(?<=[.!?:])\s+(?=(?:(?:Section|Sec\.)\s+\d+\s*\.(?!\d)|\d+-\d+\.\s+\S))"
SENTENCE_END = r"(?U)(?<![A-Z]\.)(?<=[.!?])\s+(?=[A-Z(])"


def paragraphs(docs: DataFrame, delimiter: str = r" {2,}") -> DataFrame:
    """id, idx (from 0), text of the non-empty paragraphs."""
    parts = F.filter(F.transform(F.split("text", delimiter), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("id", F.posexplode(parts).alias("idx", "text"))


def is_header(c: Column) -> Column:
    out = c.rlike(SECTION)
    for p in SUB_HEADERS:
        out = out | c.rlike(p)
    return out


def is_list_item(c: Column, longest: int = 400) -> Column:
    return c.rlike(BULLET) | (c.rlike(ITEM) & (F.length(c) < longest) & ~c.contains("..."))


def ends_incomplete(c: Column) -> Column:
    return c.rlike(r"(?U)[:\p{Alnum}]\s*$")


def resplit_sections(c: Column) -> Column:
    """Parts of a paragraph: it is cut before a section header that follows the end of a sentence."""
    return F.split(c, EMBEDDED)


def sentences(c: Column) -> Column:
    """Sentences, not cut inside parentheses; the depth of parentheses never falls under 0."""
    ends = F.split(c, SENTENCE_END)
    gaps = F.concat(F.regexp_extract_all(c, F.lit(SENTENCE_END), F.lit(0)), F.array(F.lit("")))
    pieces = F.zip_with(ends, gaps, lambda s, g: F.struct(s.alias("s"), g.alias("g")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit("").alias("gap"), F.lit(0).alias("depth"))

    def depth(start, s):
        marks = F.split(F.regexp_replace(s, r"[^()]", ""), "")
        return F.aggregate(marks, start, lambda d, m: F.greatest(F.lit(0), d + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)))

    def step(acc, x):
        whole, now = F.concat(acc["held"], acc["gap"], x["s"]), depth(acc["depth"], x["s"])
        is_open = now > 0
        return F.struct(
            F.when(is_open, acc["out"]).otherwise(F.concat(acc["out"], F.array(whole))).alias("out"),
            F.when(is_open, whole).otherwise("").alias("held"), F.when(is_open, x["g"]).otherwise("").alias("gap"), now.alias("depth"),
        )

    return F.aggregate(pieces, zero, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))


def number(rows: DataFrame, by: str, order: str, form: str = "%s:oa:%03d") -> DataFrame:
    """rows with ordinal and segment_id per document."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("ordinal", n).withColumn("segment_id", F.format_string(form, F.col(by).cast("string"), F.col("ordinal")))


def closing_cutoff(rows: DataFrame, by: str, order: str, closes: str) -> DataFrame:
    """rows with after_close: whether a closing row came at or before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("after_close", F.max(F.col(closes).cast("int")).over(w) == 1)


def islands(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Adjacent rows of one kind joined: by, first, last, kind, n, text."""
    w = Window.partitionBy(by).orderBy(order)
    fresh = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1)
    x = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s["t"]), " ")
    return x.groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min(kind).alias("kind"), F.count("*").alias("n"), text.alias("text")).drop("island")
