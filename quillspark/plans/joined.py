"""Queries of the segment merges, script payloads, citation edges and alignment evidence over small literal inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..operators import merges, models, references, review
from ..sources import tables
from .golden import golden

SEGMENTS = "id long, s array<struct<type:string,text:string,chunks:array<int>>>"


def rows_of(c: str, x):
    out = x.select("id", F.posexplode(c).alias("idx", "e"))
    return out.select("id", F.col("idx").cast("long").alias("idx"), "e.type", "e.text", F.array_join("e.chunks", ",").alias("chunks"))


@golden(
    "id, idx, text, vesting",
    (0, 0, "one two", False), (0, 1, "by the authority", True), (0, 2, "under law", True), (0, 3, "three four", False), (1, 0, "v", True),
)
def seg13_coalesce(spark):
    rows = [(0, [("one", False), ("two", False), ("by the authority", True), ("under law", True), ("three", False), ("four", False)]), (1, [("v", True)]), (2, [])]
    x = spark.createDataFrame(rows, "id long, p array<struct<text:string,vesting:boolean>>")
    out = x.select("id", F.posexplode(merges.coalesce_pieces(F.col("p"))).alias("idx", "e"))
    return out.select("id", F.col("idx").cast("long").alias("idx"), "e.text", "e.vesting")


@golden(
    "id, idx, type, text, chunks",
    (0, 0, "order_action", "5. General Provisions. (a) Nothing affects: (i) the authority; (ii) the functions.", "0,1,2"), (0, 1, "order_action", "6. Next.", "3"),
    (0, 2, "boilerplate", "(a) stays", "4"), (0, 3, "order_action", "(b) after a break", "5"), (0, 4, "order_action", "no marker", "6"), (0, 5, "order_action", "(1) apart", "7"),
    (1, 0, "ordering_phrase", "it is ordered:", "0"), (1, 1, "order_action", "(a) First.", "1"), (1, 2, "ordering_phrase", "(b) same depth:", "2"), (1, 3, "order_action", "(i) own", "3"),
)
def seg17_sublists(spark):
    a, p = "order_action", "ordering_phrase"
    rows = [
        (0, [(a, "5. General Provisions.", [0]), (p, "(a) Nothing affects:", [0, 1]), (a, "(i) the authority;", [1]), (a, "(ii) the functions.", [2]), (a, "6. Next.", [3]), ("boilerplate", "(a) stays", [4]),
             (a, "(b) after a break", [5]), (a, "no marker", [6]), (a, "(1) apart", [7])]),
        (1, [(p, "it is ordered:", [0]), (a, "(a) First.", [1]), (p, "(b) same depth:", [2]), (a, "(i) own", [3])]), (2, []),
    ]
    return rows_of("m", spark.createDataFrame(rows, SEGMENTS).select("id", merges.merge_sublists(F.col("s")).alias("m")))


@golden(
    "id, idx, type, text, chunks",
    (0, 0, "order_action", "do hereby call upon the people to observe the day.", "0,1"), (0, 1, "order_action", "It is so.", "1"), (0, 2, "order_action", "Then more of it", "2"), (0, 3, "paragraph", "short", "3"),
    (0, 4, "order_action", "and", "3"), (1, 0, "order_action", "a b c", "0,1,2"),
)
def seg18_short_fragments(spark):
    a = "order_action"
    rows = [
        (0, [(a, "do hereby ", [0]), (a, " call upon the people to observe the day.", [0, 1]), (a, "It is so.", [1]), (a, "Then more of it", [2]), ("paragraph", "short", [3]), (a, "and", [3])]),
        (1, [(a, "a", [0]), (a, "b", [1]), (a, "c", [2])]), (2, []),
    ]
    return rows_of("m", spark.createDataFrame(rows, SEGMENTS).select("id", merges.merge_short(F.col("s")).alias("m")))


@golden(
    "id, idx, type, text, chunks",
    (0, 0, "ordering_phrase", "I further determine,", "4"), (0, 1, "vesting_clause", "pursuant to section 2,", "4,5"), (0, 2, "order_action", "that it is so.", "5"),
    (1, 0, "order_action", "I determine,", "0"), (1, 1, "vesting_clause", "under law,", "1"), (1, 2, "order_action", "that it is so.", "1"), (2, 0, "order_action", "I determine,", "0"),
)
def seg19_connectors(spark):
    a, v = "order_action", "vesting_clause"
    rows = [
        (0, [(a, "I further determine,", [4]), (v, "pursuant to section 2,", [4, 5]), (a, "that it is so.", [5])]),
        (1, [(a, "I determine,", [0]), (v, "under law,", [1]), (a, "that it is so.", [1])]), (2, [(a, "I determine,", [0])]),
    ]
    return rows_of("m", spark.createDataFrame(rows, SEGMENTS).select("id", merges.relabel_connectors(F.col("s")).alias("m")))


@golden(
    "id, idx, type, text, chunks",
    (0, 0, "paragraph", "[By the authority vested in me,] I order", "0"), (0, 1, "order_action", "Act [under law] now.", "1"), (0, 2, "order_action", "Then act.", "1"),
    (1, 0, "paragraph", "[Lost clause]", "0"), (1, 1, "section", "Sec. 1. it goes on", "1,2"), (1, 2, "paragraph", "[The end]", "9"),
)
def seg25_display(spark):
    a, v, p = "order_action", "vesting_clause", "paragraph"
    rows = [
        (0, [(v, "By the authority vested in me,", [0]), (p, "I order", [0]), (a, "Act", [1]), (v, "under law", [1]), (p, "now.", [1]), (a, "Then act.", [1])]),
        (1, [(v, "Lost clause", [0]), ("section", "Sec. 1.", [1]), (p, "it goes on", [1, 2]), (v, "The end", [9])]), (2, []),
    ]
    x = spark.createDataFrame(rows, SEGMENTS).select("id", F.posexplode(merges.for_display(F.col("s"))).alias("idx", "e"))
    shown = F.transform("e.parts", lambda q: F.when(q["vesting"], F.regexp_replace(q["text"], r"(?s)^( ?)(.*)$", "$1[$2]")).otherwise(q["text"]))
    return x.select("id", F.col("idx").cast("long").alias("idx"), "e.type", F.array_join(shown, "").alias("text"), F.array_join("e.chunks", ",").alias("chunks"))


@golden(
    "id, nth, kind, text, place",
    (0, 0, "context", "Preamble.", None), (0, 1, "operative", "Act (now)\n and [then].", 0), (0, 2, "context", "Between", None), (0, 3, "operative", "End it.", 2), (1, 0, "operative", "All of it", 0), (2, 0, "context", "none here", None),
)
def seg26_sections(spark):
    rows = [(0, "Preamble.  Act (now)\n and [then]. Between  End it. ", ["Act (now) and [then].", "not there", "End it."]), (1, "All of it", ["All  of it"]), (2, "none here", []), (3, "  ", ["x"])]
    x = spark.createDataFrame(rows, "id long, t string, p array<string>").select("id", F.posexplode(merges.sections(F.col("t"), F.col("p"))).alias("nth", "e"))
    return x.select("id", F.col("nth").cast("long").alias("nth"), "e.kind", "e.text", F.col("e.idx").cast("long").alias("place"))


@golden("id, json", (0, '{"a": "}\\" {", "b": [1, {"c": 2}]}'), (1, "[[1], [2]]"), (2, "{}"))
def src10_json_assignment(spark):
    rows = [(0, 'x; var D= {"a": "}\\" {", "b": [1, {"c": 2}]}; var E={};'), (1, "var D=[[1], [2]];]"), (2, "var D=\n{}")]
    return spark.createDataFrame(rows, "id long, t string").select("id", tables.json_assignment(F.col("t"), "D").alias("json"))


@golden(
    "child, found_parent, status",
    (1, 2, "edge"), (1, None, "outside_corpus"), (1, 1, "self"), (1, 3, "cross_type_reference"), (2, 1, "not_earlier"), (4, 5, "not_earlier"), (1, 6, "not_earlier"),
)
def ref06_edge_rules(spark):
    docs = [(1, "order", "100", "2001-01-01"), (2, "order", "90", "2000-01-01"), (3, "notice", "7", "1999-01-01"), (4, "notice", "8", "1998-01-01"), (5, "notice", "9", "1998-01-01"), (6, "order", "80", None)]
    refs = [(1, "order", "90", 0), (1, "order", "55", 5), (1, "order", "100", 9), (1, "notice", "7", 12), (2, "order", "100", 0), (4, "notice", "9", 0), (1, "order", "80", 20)]
    d = spark.createDataFrame(docs, "id long, type string, identifier string, date string")
    r = spark.createDataFrame(refs, "child long, type string, identifier string, start long")
    return references.resolve(r, d).select("child", F.col("parent").alias("found_parent"), "status")


@golden(
    "child, parent, nth, child_segment, parent_segment, child_text, parent_text",
    (1, 2, 0, "1:oa:002", "2:oa:001", "one b", "two a"), (1, 2, 1, "1:oa:001", "2:oa:001", "one a", "two a"),
)
def sim12_alignment_evidence(spark):
    pairs = spark.createDataFrame([(1, 2, [(1, 0, 0.9), (0, 0, 0.8)]), (2, 1, [])], "child long, parent long, alignments array<struct<child_index:int,parent_index:int,score:double>>")
    segments = spark.createDataFrame([(1, 0, "1:oa:001", "one a"), (1, 1, "1:oa:002", "one b"), (2, 0, "2:oa:001", "two a")], "doc long, idx int, segment_id string, text string")
    return review.evidence(pairs, segments).select("child", "parent", F.col("nth").cast("long").alias("nth"), "child_segment", "parent_segment", "child_text", "parent_text")


VESTED = [
    (0, ["By the authority vested in me as President by the Constitution and the laws of the United States of America, and in order to act, I order:"]),
    (1, ["By virtue of the authority vested in me by Article II, Section 2 of the Constitution, it is ordered."]), (2, ["Pursuant to section 301 of title 3, United States Code, I order."]),
    (3, ["Pursuant to section 5 of this order, I act."]), (4, []), (5, ["I hereby order."]), (6, ["Whereas Congress acted under the authority of law;", "Whereas the National Emergencies Act authorizes the President to act;"]),
    (7, ["By the authority vested in me by the Constitution and the National Emergencies Act, consistent with the laws"]), (8, ["Pursuant to the laws of the United States"]), (9, None),
]


@golden(
    "id, nth, source",
    (0, 0, "authority vested in me as President by the Constitution and the laws of the United States of America"), (1, 0, "By virtue of the authority vested in me by Article II, Section 2 of the Constitution, it is ordered."),
    (2, 0, "Pursuant to section 301 of title 3, United States Code, I order."), (3, 0, "Pursuant to section 5 of this order, I act."), (6, 0, "Whereas the National Emergencies Act authorizes the President to act"),
    (7, 0, "authority vested in me by the Constitution and the National Emergencies Act"), (8, 0, "Pursuant to the laws of the United States"),
)
def cls05_authority_sources(spark):
    x = spark.createDataFrame(VESTED, "id long, c array<string>").select("id", F.posexplode(legal.authority_sources(F.col("c"))).alias("nth", "source"))
    return x.withColumn("nth", F.col("nth").cast("long"))


@golden(
    "id, category, whole",
    (0, "generic_constitution_and_generic_statute", "generic_constitution_and_generic_statute"), (1, "specific_constitution_only", "specific_constitution_only"), (2, "specific_statute_only", "specific_statute_only"),
    (3, "other_vesting_authority", "other_vesting_authority"), (4, "no_vesting_clause", "no_vesting_clause"), (5, "other_vesting_authority", "other_vesting_authority"), (6, "specific_statute_only", "specific_statute_only"),
    (7, "generic_constitution_and_specific_statute", "generic_constitution_and_specific_statute"), (8, "generic_statute_only", "generic_statute_only"), (9, "no_vesting_clause", "no_vesting_clause"),
)
def cls06_authority_category(spark):
    x = spark.createDataFrame(VESTED, "id long, c array<string>")
    return x.select("id", legal.authority_category(F.col("c")).alias("category"), legal.authority_category(F.col("c"), whole=True).alias("whole"))


@golden(
    "id, category, rationale, evidence",
    (0, "self_executing_legal_effect", "tariff/import/HTS change", "Harmonized Tariff Schedule of the United States (HTSUS) is modified"),
    (1, "self_executing_legal_effect", "tariff/import/HTS change", "suspended and restricted. The entry"),
    (11, "self_executing_legal_effect", "immigration entry restriction", "entry of certain immigrants and nonimmigrants into the United States is hereby suspended"),
    (2, "self_executing_legal_effect", "property blocking or transaction prohibition", "property and interests in property are blocked and may not be transferred"),
    (3, "not_self_executing_legal_effect", "agency reporting/review/coordination directive", "Secretary shall review existing programs, coordinate with agencies, and submit a report"),
    (4, "not_self_executing_legal_effect", "ceremonial observance language", "do hereby proclaim May 1 as Loyalty Day, and I call upon the people to observe that day"),
    (5, "self_executing_legal_effect", "land/designation or legal instrument status change", "Executive Order 12345 is hereby revoked"),
    (6, "self_executing_legal_effect", "funding or eligibility legal consequence", "No federal funds shall be made available"),
    (7, "not_self_executing_legal_effect", "proclamation without direct private-party effect trigger", ""), (8, "uncertain_review", "no conservative rule matched", ""),
    (9, "not_self_executing_legal_effect", "internal management establishment or membership", "council report"), (10, "uncertain_review", "no conservative rule matched", ""),
)
def cls07_legal_effect(spark):
    rows = [
        (0, "executive_order", "The Harmonized Tariff Schedule of the United States (HTSUS) is modified to help."), (1, "proclamation", "The entry of certain immigrants and nonimmigrants into the United States is hereby suspended and restricted. The entry"),
        (11, "proclamation", "The entry of certain immigrants and nonimmigrants into the United States is hereby suspended and restricted."),
        (2, "executive_order", "All property and interests in property are blocked and may not be transferred."), (3, "memorandum", "The Secretary shall review existing programs, coordinate with agencies, and submit a report."),
        (4, "proclamation", "I do hereby proclaim May 1 as Loyalty Day, and I call upon the people to observe that day."), (5, "executive_order", "Executive Order 12345 is hereby revoked."),
        (6, "letter", "No federal funds shall be made available."), (7, "proclamation", "Nothing here."), (8, "letter", None),
        (9, "executive_order", "The designation is hereby modified for the council report."), (10, "executive_order", "Nothing in this order shall be construed so: all transactions are prohibited."),
    ]
    x = spark.createDataFrame(rows, "id long, type string, t string").select("id", legal.legal_effect(F.col("t"), F.col("type")).alias("e"))
    return x.select("id", "e.category", "e.rationale", "e.evidence")


class Letters:
    """A stand-in for a model: vectors of letter counts, yes-probabilities from common words, code probabilities from digits."""

    def length(self, text: str) -> int:
        return len(text.split())

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in "abc"] for t in texts]

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split()))) for a, b in pairs]

    def codes(self, prompts: list[str]) -> list[list[float]]:
        return [[p.count(str(c)) / 10 for c in range(5)] for p in prompts]


@golden("id, query, document", (0, "0.0,0.0,1.0", "0.6,0.8,0.0"), (1, "0.0,0.0,1.0", "1.0,0.0,0.0"))
def udf01_encode(spark):
    x = spark.createDataFrame([(0, "a b b a a b b"), (1, "aa")], "id long, text string")
    out = models.encode(x, Letters, longest=20, as_query=lambda t: "c")
    return out.select("id", *[F.array_join(F.transform(c, lambda v: F.round(v, 4).cast("string")), ",").alias(c) for c in ("query", "document")])


@golden("id, score", (0, 0.5), (1, 0.0), (2, 1.0), (3, 0.0))
def udf02_pair_scores(spark):
    x = spark.createDataFrame([(0, "x y z", "x y w"), (1, "x", "y"), (2, "q", "q"), (3, "", None)], "id long, query string, document string")
    return models.pair_scores(x, Letters, most=2, budget=6).select("id", "score")


@golden("id, score, n_pairs, matched, n_matched", (0, 0.5, 4, 1.0, 1), (1, 0.0, 1, None, 0))
def udf04_rerank(spark):
    rows = [(0, ["x y", "p q"], ["x y", "z"], [(0, 0, 0.9)]), (1, ["k"], ["l"], [])]
    x = spark.createDataFrame(rows, "id long, child array<string>, parent array<string>, a array<struct<child:int,parent:int,score:double>>")
    whole = models.rerank(x, Letters).select("id", "score", "n_pairs")
    part = models.rerank(models.matched(x, "a"), Letters).select("id", F.col("score").alias("matched"), F.col("n_pairs").alias("n_matched"))
    return whole.join(part, "id")


@golden("id, codes, all_code3, least, most, evidence", (0, "3,3", True, 0.2, 0.3, "33 hereby"), (1, "1,1", False, 0.0, 0.1, "1"))
def udf05_code_predictions(spark):
    x = spark.createDataFrame([(0, "order", "33 hereby"), (1, "letter", "1")], "id long, type string, text string")
    out = models.code_predictions(x, ["{document_type}: {text}", "3 {document_type}: {text}"], Letters)
    return out.select("id", F.array_join("codes", ",").alias("codes"), "all_code3", "least", "most", "evidence")
