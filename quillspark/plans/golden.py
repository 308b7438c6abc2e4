"""Queries of the text operators over a small literal corpus, with the rows that must come out as SQL values.

The driver's tables hold invented prose without citations or section numbers, so these operators get
their own texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import authority, text
from ..operators import references, review, segments
from .queries import ORACLES, QUERIES


def golden(columns: str, *rows: tuple):
    """Registers f(spark), whose rows must be ``rows`` under ``columns``."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(spark)
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({columns})"
        return f

    return add


def texts(spark: SparkSession, *values: str):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


AUTHORITIES = (
    "By the authority vested in me by the Constitution and pursuant to section 301 of title 3, United States Code, I hereby order.",
    "Under the International Emergency Economic Powers Act and Executive Order 12345.",
    'Under Proclamation 9984, PPD-41, my memorandum of March 31, 2010, and the letter entitled "Report to the Congress".',
    "The Secretary shall act under section 2 of this order.",
    "Public Law 95-223 and 91 Stat. 1625 and the laws of the United States and House Joint Resolution 7.",
)


@golden(
    "id, nth, kind, span_start, span_end",
    (0, 0, "constitution", 33, 49), (0, 1, "usc_section", 66, 108), (1, 0, "named_act", 6, 53), (1, 1, "executive_order", 58, 79), (2, 0, "proclamation", 6, 23),
    (2, 1, "numbered_memorandum", 25, 31), (2, 2, "dated_unnumbered_directive", 36, 64), (2, 3, "titled_unnumbered_directive", 74, 114), (4, 0, "public_law", 0, 17),
    (4, 1, "statutes_at_large", 22, 35), (4, 2, "generic_laws", 40, 69), (4, 3, "joint_resolution", 74, 98),
)
def msk01_authority_spans(spark):
    x = texts(spark, *AUTHORITIES).select("id", F.posexplode(authority.authority_spans(F.col("text"))).alias("nth", "s"))
    return x.select("id", F.col("nth").cast("long").alias("nth"), "s.kind", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"))


@golden(
    "id, masked, whole",
    (0, "By the authority vested in me by [AUTHORITY] and pursuant to [AUTHORITY], I hereby order.", True), (1, "Under [AUTHORITY] and [AUTHORITY].", True),
    (2, "Under [AUTHORITY], [AUTHORITY], my [AUTHORITY], and the [AUTHORITY].", True), (3, "The Secretary shall act under section 2 of this order.", True),
    (4, "[AUTHORITY] and [AUTHORITY] and [AUTHORITY] and [AUTHORITY].", True),
)
def msk02_str16_mask_and_restore(spark):
    x = texts(spark, *AUTHORITIES).withColumn("s", authority.authority_spans(F.col("text"))).withColumn("masked", authority.mask(F.col("text"), F.col("s")))
    cut = F.transform("s", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    return x.select("id", "masked", (text.unmask(F.col("masked"), cut) == F.col("text")).alias("whole"))


PROVISIONS = (
    "Sec. 1. The Secretary shall establish a program.  Sec. 2. General Provisions. (a) Nothing in this order shall be construed to impair or otherwise affect:  "
    "(i) the authority granted by law to an executive department or agency; or  (ii) the functions of the Director of the Office of Management and Budget.  (d) The Secretary shall issue EO-specific guidance.",
    "The agency shall act.  If any provision of this order is held invalid, the remainder of this order shall not be affected.",
    "The Secretary shall establish a program.  This memorandum shall be implemented consistent with applicable law.  If any provision of this proclamation is held invalid, the remainder shall not be affected.",
    "Section 1. Findings. The Nation faces an unusual threat.  Sec. 2. Definitions. Agency means an executive department.",
    "(i) the authority granted by law stays  under Executive Order 12345 it acts",
)


@golden(
    "id, kept, n_removed",
    (0, "Sec. 1. The Secretary shall establish a program.  (d) The Secretary shall issue EO-specific guidance.", 3), (1, "The agency shall act.", 1),
    (2, "The Secretary shall establish a program.", 2), (3, PROVISIONS[3], 0), (4, "(i) the authority granted by law stays  under [AUTHORITY] it acts", 0),
)
def msk03_msk04_preprocess(spark):
    x = texts(spark, *PROVISIONS).withColumn("b", authority.without_boilerplate(F.col("text")))
    kept = F.col("b.kept")
    return x.select("id", authority.mask(kept, authority.authority_spans(kept)).alias("kept"), F.size("b.removed").cast("long").alias("n_removed"))


CITING = (
    "Executive Order 12345 is hereby revoked.  We discuss Executive Order 12346.",
    "Executive Order 12345, as amended and modified in scope, is discussed.  Executive Order 12346 is hereby revoked.",
    "The amendment shall amend Proclamation No. 77.  It was long ago and hereby extends PPD-41.",
    'See Presidential Determination No. 2010 - 5 and the memorandum of May 5, 2009, and letter titled "On Trade".',
    "The delegation of functions under Executive Order 11000 goes on.",
)


@golden(
    "id, type, identifier, title, date_text, at_char, relation",
    (0, "executive_order", "12345", "", "", 0, "revokes"), (0, "executive_order", "12346", "", "", 53, "citation_discussion"), (1, "executive_order", "12345", "", "", 0, "citation_discussion"),
    (1, "executive_order", "12346", "", "", 72, "revokes"), (2, "proclamation", "77", "", "", 26, "amends"), (2, "memorandum", "PPD-41", "", "", 83, "citation_discussion"),
    (3, "memorandum", "2010-5", "", "", 4, "citation_discussion"), (3, "memorandum", "", "", "May 5, 2009", 52, "citation_discussion"), (3, "letter", "", "On Trade", "", 83, "citation_discussion"),
    (4, "executive_order", "11000", "", "", 34, "delegates_authority_under"),
)
def ref01_ref04_references(spark):
    x = references.relation(references.references(texts(spark, *CITING)))
    return x.select("id", "type", "identifier", "title", "date_text", F.col("start").cast("long").alias("at_char"), "relation")


@golden("id, at_char, context", (0, 0, "Executive Order 12345 is hereby revoked."), (0, 53, "We discuss Executive Order 12346."), (4, 34, CITING[4]))
def ref03_context(spark):
    x = references.references(texts(spark, *CITING)).filter("type = 'executive_order' and id <> 1")
    return x.select("id", F.col("start").cast("long").alias("at_char"), "context")


DIRECTIVES = [
    (10, "executive_order", "12345", "On Ships", "January 1, 2000"), (11, "proclamation", "77", "", ""), (12, "proclamation", "77", "", ""), (13, "memorandum", "", "", "May 5, 2009"),
    (14, "letter", "", "On Trade", ""), (15, "memorandum", "PPD-41", "", ""),
]


@golden(
    "id, type, found_parent, status",
    (0, "executive_order", 10, "resolved"), (0, "executive_order", None, "outside_corpus"), (1, "executive_order", 10, "resolved"), (1, "executive_order", None, "outside_corpus"),
    (2, "proclamation", None, "ambiguous_match"), (2, "memorandum", 15, "resolved"), (3, "memorandum", None, "outside_corpus"), (3, "memorandum", 13, "resolved"), (3, "letter", 14, "resolved"),
    (4, "executive_order", None, "outside_corpus"),
)
def ref02_ref05_resolve_any(spark):
    docs = spark.createDataFrame(DIRECTIVES, "id long, type string, identifier string, title string, date_text string")
    return references.resolve_any(references.references(texts(spark, *CITING)), docs).select("id", "type", F.col("parent").alias("found_parent"), "status")


@golden(
    "id, section, list_item, incomplete",
    (0, True, False, False), (1, False, False, False), (2, True, False, False), (3, True, False, False), (4, True, False, False), (5, False, True, True), (6, False, True, False), (7, False, False, True),
    (8, False, False, False), (9, False, False, True),
)
def seg04_seg05_seg06_predicates(spark):
    x = texts(
        spark, "Section 1. Policy.", "Section 1016 of the Act applies.", "Sec. 2 . Title is here.", "1-101. Text of it.", "II. Title there.", "(a) the agencies shall act", "• a point.",
        "the following:", "T. 16 N., R. 13 E.,", "(1) Page ... 5",
    )
    c = F.col("text")
    return x.select("id", segments.is_header(c).alias("section"), segments.is_list_item(c).alias("list_item"), segments.ends_incomplete(c).alias("incomplete"))


@golden(
    "id, idx, part",
    (0, 0, "It ends."), (0, 1, "Sec. 2. Next comes."), (0, 2, "1-102. More of it"), (1, 0, "Under Section 5.2 it stays. Section 9 of the Act too."),
)
def seg02_resplit(spark):
    x = texts(spark, "It ends. Sec. 2. Next comes. 1-102. More of it", "Under Section 5.2 it stays. Section 9 of the Act too.")
    return x.select("id", F.posexplode(segments.resplit_sections(F.col("text"))).alias("idx", "part")).withColumn("idx", F.col("idx").cast("long"))


@golden(
    "id, idx, sentence",
    (0, 0, "One (two. Three) four."), (0, 1, "Five! six"), (1, 0, "Robert T. Stafford acts."), (1, 1, "J. Smith too."), (2, 0, "A stray ) closes."), (2, 1, "Then (it.  Keeps) gaps."), (2, 2, "End"),
)
def seg07_sentences(spark):
    x = texts(spark, "One (two. Three) four. Five! six", "Robert T. Stafford acts. J. Smith too.", "A stray ) closes. Then (it.  Keeps) gaps. End")
    return x.select("id", F.posexplode(segments.sentences(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


@golden("id, title", (0, "Protecting The Nation"), (1, "Order 123"))
def str05_title_words(spark):
    return texts(spark, "https://x.org/a/protecting-the-nation-13769/", "https://x.org/order-123").select("id", text.title_words(F.col("text")).alias("title"))


@golden("id, identifier", (0, "13769"), (1, "9984"), (2, "PPD-41"), (3, "2010-5"), (4, ""), (5, ""))
def str07_row_identifier(spark):
    rows = [
        (0, "executive_order", "https://x/executive-order-13769-protecting", ""), (1, "proclamation", "https://x/proclamation-9984", ""), (2, "memorandum", "", "National Security Directive/PPD- 41 says"),
        (3, "memorandum", "", "Presidential Determination No. 2010–5"), (4, "memorandum", "", "x" * 600 + " PPD-41"), (5, "letter", "https://x/proclamation-9984", "PPD-41"),
    ]
    x = spark.createDataFrame(rows, "id long, doc_type string, url string, text string")
    return x.select("id", text.row_identifier(F.col("doc_type"), F.col("url"), F.col("text")).alias("identifier"))


@golden("id, html", (0, "a &lt;b&gt; &amp; <mark>shall</mark> it&#x27;s &quot;<mark>must</mark>&quot;"), (1, "plain"))
def str22_highlight(spark):
    return texts(spark, "a <b> & shall it's \"must\"", "plain").select("id", text.highlight(F.col("text"), r"\b(?:shall|must)\b").alias("html"))


@golden("id, nth, chunk", (0, 0, "[1] a b\n\n[2] c"), (0, 1, "[3] d e f g"), (0, 2, "h i"), (1, 0, "[1] one"))
def udf03_pack_pieces(spark):
    x = spark.createDataFrame([(0, ["a b", "c", "d e f g h i"]), (1, ["one"]), (2, [])], "id long, p array<string>")
    return x.select("id", F.posexplode(text.pack_pieces(F.col("p"), 5)).alias("nth", "chunk")).withColumn("nth", F.col("nth").cast("long"))


@golden(
    "doc, i, error",
    ("a", 1, "a ann[1]: offsets [5:5] invalid for text length 9"), ("a", 2, "a ann[2]: unknown label 'x'"), ("b", 0, "b ann[0]: 'start' must be int"), ("b", 0, "b ann[0]: offsets [0:20] invalid for text length 9"),
    ("b", 1, "b ann[1]: 'label' must be str"),
)
def str26_span_errors(spark):
    rows = [("a", 0, 1, 4, "order_action", 9), ("a", 1, 5, 5, "order_action", 9), ("a", 2, 0, 9, "x", 9), ("b", 0, None, 20, "order_action", 9), ("b", 1, 1, 2, None, 9)]
    return review.span_errors(spark.createDataFrame(rows, "doc string, i long, start int, end int, label string, length int"), ["order_action"])


RATINGS = [
    (1, "policy", "ordering", "domestic", None, "no"), (2, "policy", None, "domestic", None, "no"), (3, "symbolic", None, "foreign", "yes", "no"), (4, "symbolic", None, "foreign", "", "no"),
    (5, "symbolic", "ordering", "domestic", "yes", None), (6, None, None, "domestic", None, None),
]


@golden(
    "id, whole, of_document, of_chunk",
    (1, True, '{"category":"policy","legal_effect":"ordering","scope":"domestic","emergency":"no"}', '{"category":"policy","legal_effect":"ordering","scope":"domestic"}'), (2, False, None, None),
    (3, True, '{"category":"symbolic","scope":"foreign","national_security":"yes","emergency":"no"}', '{"category":"symbolic","scope":"foreign","national_security":"yes"}'), (4, False, None, None),
    (5, False, None, '{"category":"symbolic","scope":"domestic"}'), (6, False, None, None),
)
def sta08_exact_rating(spark):
    x = spark.createDataFrame(RATINGS, "id long, " + ", ".join(f"{f} string" for f in review.FIELDS))
    whole, part = F.lit(True), F.lit(False)
    return x.select("id", review.complete(whole).alias("whole"), review.exact_value(whole).alias("of_document"), review.exact_value(part).alias("of_chunk"))


@golden("id, every, unanimous, pairs, agree, status", (0, True, True, 3, 3, "agree"), (1, True, False, 3, 1, "disagree"), (2, False, False, 1, 1, "missing"), (3, False, False, 1, 0, "disagree"), (4, False, False, 0, 0, "missing"))
def sta09_sta11_agreement(spark):
    x = spark.createDataFrame([(0, ["a", "a", "a"]), (1, ["a", "b", "a"]), (2, ["a", None, "a"]), (3, ["a", None, "b"]), (4, [None, None, None])], "id long, v array<string>")
    p = review.pairwise(F.col("v"))
    return x.select("id", p["every"].alias("every"), p["unanimous"].alias("unanimous"), p["pairs"].cast("long").alias("pairs"), p["agree"].cast("long").alias("agree"), review.row_agreement(F.col("v")).alias("status"))


@golden("least, policy", (0.8, "rule"), (0.9, "rule"), (0.6, "dual_model"))
def sta04_choose_policy(spark):
    m = spark.createDataFrame([("dual_model_plus_rule", 0.833, 6), ("dual_model", 0.625, 24), ("rule", 0.857, 7)], "policy string, precision double, predicted_positive long")
    out = [review.choose_policy(m, least).select(F.lit(least).alias("least"), "policy") for least in (0.8, 0.9, 0.6)]
    return out[0].union(out[1]).union(out[2])
