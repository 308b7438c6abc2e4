"""Citation graph: references in texts, their resolution, typed edges to strictly earlier documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MEMORANDUM, match_spans, normalize_identifier

_DATE = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}"
#: Patterns of numbered references by type, each with the group or groups of its identifier.
REFERENCES = {
    "executive_order": (r"(?iU)\b(?:Executive\s+Orders?|Exec(?:utive)?\.?\s+Orders?|E\.?\s*O\.?)(?:\s+Nos?\.?)?\s+(\d{4,5}(?:\s*-\s*A)?)\b", (1,)),
    "proclamation": (r"(?iU)\bProclamations?(?:\s+Nos?\.?)?\s+(\d+)\b", (1,)),
    "memorandum": (MEMORANDUM, (1, 2)),
}
#: References to memoranda and letters by date and by quoted title.
BY_DATE = r"(?iU)\b(memorandum|letter)(?:\s+(?:to|for|from)\b.{0,100}?)?\s+(?:of|dated|on)\s+(" + _DATE + r")\b"
BY_TITLE = r"(?iU)\b(memorandum|letter)(?:\s+(?:titled|entitled|regarding|concerning))?\s*[\"“]([^\"”]{4,300})[\"”]"
#: Relation cues in verbal forms, and what before a cue makes it historical.
RELATIONS = {
    "amends": r"(?iU)\bamend(?:s|ed|ing)?\b|\brevis(?:e|es|ed|ing)\b",
    "revokes": r"(?iU)\brevok(?:e|es|ed|ing)\b|\brescind(?:s|ed|ing)?\b",
    "supersedes": r"(?iU)\bsupersed(?:e|es|ed|ing)\b",
    "modifies": r"(?iU)\bmodif(?:y|ies|ied|ying)\b|\badjust(?:s|ed|ing)?\b",
    "continues": r"(?iU)\bcontinu(?:e|es|ed|ing)\b|\bextend(?:s|ed|ing)?\b",
    "replaces": r"(?iU)\breplac(?:e|es|ed|ing)\b",
    "delegates_authority_under": r"(?iU)\bdelegat(?:e|es|ed|ing|ion)\b.{0,80}\b(?:authority\s+)?under\b|\bauthority\s+under\b.{0,80}\bdelegat",
}
HISTORICAL = r"(?iU)(?:\bas\s+|\bwas\s+|\bwere\s+|\bhas\s+been\s+|\bhave\s+been\s+|\bhad\s+been\s+|\bbeen\s+|\bpreviously\s+|\bformerly\s+|\bprior(?:ly)?\s+|\bsubsequently\s+)"
FALLBACK = "citation_discussion"
LOOK_BACK = 32


def references(docs: DataFrame) -> DataFrame:
    """id, type, identifier, title, date_text, start, text, context (the paragraph between double spaces or line ends) and at, the place in it, of every reference of docs (id, text)."""
    text, empty = F.col("text"), F.lit("")

    def found(pattern: str, kind: Column, identifier: Column, title: Column, date: Column) -> DataFrame:
        x = docs.select("id", "text", F.explode(match_spans(text, pattern)).alias("m")).withColumn("hit", F.col("m.text"))
        return x.select("id", "text", kind.alias("type"), identifier.alias("identifier"), title.alias("title"), date.alias("date_text"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), "hit")

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract("hit", pattern, n)

    rows = [found(p, F.lit(kind), normalize_identifier(F.concat(*[group(p, g) for g in groups])), empty, empty) for kind, (p, groups) in REFERENCES.items()]
    for p, by_date in ((BY_DATE, True), (BY_TITLE, False)):
        kind = F.when(F.lower(group(p, 1)).startswith("memo"), "memorandum").otherwise("letter")
        rows.append(found(p, kind, empty, empty if by_date else F.trim(group(p, 2)), group(p, 2) if by_date else empty))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    left = F.regexp_replace(F.regexp_replace(F.left(text, F.col("start")), r"(?s)^.*(?: {2}|\n)", ""), r"(?U)^\s+", "")
    right = F.regexp_replace(F.split(F.substring(text, F.col("end") + 1, F.length(text)), r" {2}|\n", 2)[0], r"(?U)\s+$", "")
    return out.select("id", "type", "identifier", "title", "date_text", "start", F.col("hit").alias("text"), F.concat(left, "hit", right).alias("context"), F.length(left).alias("at"))


def relation(refs: DataFrame) -> DataFrame:
    """refs with the relation: the cue nearest to the reference in its paragraph, ties by label.

    Cues with a historical word in the characters before them do not count; without a cue it is a discussion.
    """
    def cues_of(label: str, pattern: str) -> Column:
        return F.transform(match_spans(F.col("context"), pattern), lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start")))

    cues = [cues_of(*rule) for rule in RELATIONS.items()]
    alive = F.filter(F.flatten(F.array(*cues)), lambda c: ~F.substring(F.col("context"), F.greatest(F.lit(1), c["start"] - LOOK_BACK + 1), F.least(c["start"], F.lit(LOOK_BACK))).rlike(HISTORICAL))
    near = F.array_min(F.transform(alive, lambda c: F.struct(F.abs(c["start"] - F.col("at")).alias("distance"), c["label"].alias("label"))))
    return refs.withColumn("relation", F.coalesce(near["label"], F.lit(FALLBACK)))


def resolve_any(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs with hits and parent among docs (id, type, identifier, title, date_text): by identifier, else by title, else by date.

    One document of the type is the parent; none is ``outside_corpus``, more are an ``ambiguous_match``.
    """
    x = refs.withColumn("by", F.when(F.col("identifier") != "", "identifier").when(F.col("title") != "", "title").otherwise("date_text"))
    x = x.withColumn("key", F.coalesce(*[F.when(F.col("by") == c, F.col(c)) for c in ("identifier", "title", "date_text")]))
    keys = [docs.filter(F.col(c) != "").select(F.lit(c).alias("by"), "type", F.col(c).alias("key"), F.col("id").alias("parent")) for c in ("identifier", "title", "date_text")]
    index = keys[0].unionByName(keys[1]).unionByName(keys[2]).groupBy("by", "type", "key").agg(F.count("*").alias("hits"), F.min("parent").alias("parent"))
    x = x.join(index, ["by", "type", "key"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("hits") == 0, "outside_corpus").when(F.col("hits") > 1, "ambiguous_match").otherwise("resolved")
    return x.withColumn("parent", F.when(F.col("hits") == 1, F.col("parent"))).withColumn("status", status).drop("by", "key")


def artifacts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each of docs (id, ...): its edges (parent, relation), ordered, and has_automatic_parent."""
    own = found.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list(F.struct("parent", "relation"))).alias("parents"))
    none = F.array().cast("array<struct<parent:" + dict(found.dtypes)["parent"] + ",relation:" + dict(found.dtypes)["relation"] + ">>")
    return docs.join(own, "id", "left").withColumn("has_automatic_parent", F.col("parents").isNotNull()).withColumn("parents", F.coalesce("parents", none))


def resolve(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """refs (child, type, identifier, ...) with parent and status, against docs (id, type, identifier, date).

    status: edge, outside_corpus, ambiguous_match, self, cross_type_reference or not_earlier.
    """
    index = docs.filter("identifier is not null").groupBy(F.col("type").alias("t"), F.col("identifier").alias("i")).agg(F.count("*").alias("hits"), F.min("id").alias("parent"))
    x = refs.join(index, (F.col("type") == F.col("t")) & (F.col("identifier") == F.col("i")), "left").drop("t", "i")
    child = docs.select(F.col("id").alias("child"), F.col("type").alias("child_type"), F.col("date").alias("child_date"))
    parent = docs.select(F.col("id").alias("parent"), F.col("date").alias("parent_date"))
    x = x.join(child, "child").join(parent, "parent", "left")
    status = (
        F.when(F.col("hits").isNull(), "outside_corpus").when(F.col("hits") > 1, "ambiguous_match").when(F.col("child") == F.col("parent"), "self")
        .when(F.col("type") != F.col("child_type"), "cross_type_reference").when(F.coalesce(F.col("parent_date") >= F.col("child_date"), F.lit(True)), "not_earlier").otherwise("edge")
    )
    return x.withColumn("status", status)


def edges(resolved: DataFrame, relation: str = "relation", order: str = "start") -> DataFrame:
    """The first reference of each (child, parent, relation)."""
    w = Window.partitionBy("child", "parent", relation).orderBy(order)
    return resolved.filter("status = 'edge'").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
