"""Ratings by several raters: completeness, agreement, status, policies and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a rating, in order; each is asked only if its condition holds.
FIELDS = ("category", "legal_effect", "scope", "national_security", "emergency")


def asked(field: str, whole_document: Column) -> Column:
    """Whether a rating's field is asked for: the effect of policies, the security of foreign scope, the emergency of whole documents."""
    if field == "legal_effect":
        return F.coalesce(F.col("category") == "policy", F.lit(False))
    if field == "national_security":
        return F.coalesce(F.col("scope") == "foreign", F.lit(False))
    return whole_document if field == "emergency" else F.lit(True)


def complete(whole_document: Column) -> Column:
    """Whether all fields that are asked for are there and not empty."""
    out = F.lit(True)
    for f in FIELDS:
        out = out & (~asked(f, whole_document) | (F.coalesce(F.col(f), F.lit("")) != ""))
    return out


def exact_value(whole_document: Column) -> Column:
    """The rating as JSON of the fields asked for; NULL if it is incomplete."""
    fields = [F.when(asked(f, whole_document), F.col(f)).alias(f) for f in FIELDS]
    return F.when(complete(whole_document), F.to_json(F.struct(*fields)))


def pairwise(values: Column) -> Column:
    """struct<every, unanimous, pairs, agree> of an array of ratings with NULL for a missing one.

    Pairs are counted from the counts of equal values, so none is formed.
    """
    there = F.filter(values, lambda v: v.isNotNull())
    kinds = F.array_distinct(there)
    n, every = F.size(there), F.size(there) == F.size(values)
    counts = F.transform(kinds, lambda k: F.size(F.filter(there, lambda v: v == k)))
    same = F.aggregate(counts, F.lit(0), lambda acc, c: acc + (c * (c - 1) / 2).cast("int"))
    return F.struct(every.alias("every"), (every & (F.size(kinds) == 1)).alias("unanimous"), (n * (n - 1) / 2).cast("int").alias("pairs"), same.alias("agree"))


def row_agreement(values: Column) -> Column:
    """missing without a value, disagree if two differ, missing if one is not there, else agree."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(there) == 0, "missing").when(F.size(F.array_distinct(there)) > 1, "disagree").when(F.size(there) < F.size(values), "missing").otherwise("agree")


def document_agreement(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """by, status: disagree if a row disagrees, else missing if one is missing, else agree."""
    n = {s: F.count(F.when(F.col(status) == s, True)) for s in ("disagree", "missing")}
    return rows.groupBy(by).agg(F.when(n["disagree"] > 0, "disagree").when(n["missing"] > 0, "missing").otherwise("agree").alias("status"))


def choose_policy(metrics: DataFrame, least: float = 0.8) -> DataFrame:
    """Of rows (policy, precision, predicted_positive) the one with the most positives at that precision, or else the most precise."""
    good = F.col("precision") >= least
    order = F.when(good, F.struct(F.lit(1).alias("g"), F.col("predicted_positive").cast("double").alias("a"), F.col("precision").alias("b")))
    order = F.coalesce(order, F.struct(F.lit(0).alias("g"), F.col("precision").alias("a"), F.col("predicted_positive").cast("double").alias("b")))
    return metrics.agg(F.max_by(F.struct("policy", "precision", "predicted_positive"), order).alias("x")).select("x.*")


def selection_order(both: str, low: str, high: str, key: str) -> list[Column]:
    """Flagged rows first, then by the least probability, the greatest, and the whole number of the id."""
    return [F.col(both).desc(), F.col(low).desc(), F.col(high).desc(), F.col(key).cast("long").asc()]


def strict_majority(votes: DataFrame, by: list[str], value: str, ties: DataFrame) -> DataFrame:
    """by, value: what more than half of the votes say, else what the table of ties says, else NULL."""
    c = votes.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    top = c.groupBy(*by).agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by(value, "c").alias("first"))
    won = top.select(*by, F.when(2 * F.col("most") > F.col("n"), F.col("first")).alias("won"))
    return won.join(ties.withColumnRenamed(value, "tie"), by, "left").select(*by, F.coalesce("won", "tie").alias(value))


def span_errors(rows: DataFrame, labels: list[str]) -> DataFrame:
    """doc, i, error for each rule that an annotation (doc, i, start, end, label, length) breaks; NULLs are of the wrong type."""
    prefix = F.concat("doc", F.lit(" ann["), F.col("i").cast("string"), F.lit("]: "))
    start, end = F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0))
    outside = (start < 0) | (end > F.col("length")) | (start >= end)
    said = F.format_string("offsets [%d:%d] invalid for text length %d", start, end, F.col("length"))
    known = F.col("label").isNotNull()
    each = F.array(
        F.when(F.col("start").isNull(), F.lit("'start' must be int")), F.when(F.col("end").isNull(), F.lit("'end' must be int")), F.when(~known, F.lit("'label' must be str")),
        F.when(known & outside, said), F.when(known & ~F.col("label").isin(labels), F.concat(F.lit("unknown label '"), "label", F.lit("'"))),
    )
    return rows.select("doc", "i", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("e")).select("doc", "i", F.concat(prefix, "e").alias("error"))


def evidence(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each alignment of pairs (child, parent, alignments), with both segments' ids and texts.

    segments has doc, idx (from 0), segment_id, text. An index that a document does not have is an error.
    """
    x = pairs.select("child", "parent", F.posexplode("alignments").alias("nth", "a")).select("child", "parent", "nth", "a.*")
    for side in ("child", "parent"):
        own = segments.select(F.col("doc").alias(side), F.col("idx").alias(f"{side}_index"), F.col("segment_id").alias(f"{side}_segment"), F.col("text").alias(f"{side}_text"))
        x = x.join(own, [side, f"{side}_index"], "left")
    lost = F.raise_error(F.format_string("alignment index out of range for %s -> %s", F.col("child").cast("string"), F.col("parent").cast("string"))).cast("string")
    for side in ("child", "parent"):
        x = x.withColumn(f"{side}_segment", F.when(F.col(f"{side}_segment").isNull(), lost).otherwise(F.col(f"{side}_segment")))
    return x
