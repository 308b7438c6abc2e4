"""Golden cases for operators that SQL on the driver's tables does not cover."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import legal, rules, text
from quillspark.operators import agreement, ranking, references, segments, similarity, spans, stats
from quillspark.sources import sinks, tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_scalars(spark):
    assert one(spark, "August 06, 2025", text.parse_date) == one(spark, "August 6, 2025", text.parse_date) == datetime.date(2025, 8, 6)
    assert one(spark, "no date", text.parse_date) is None
    assert one(spark, "10 – 12 a", text.normalize_identifier) == "10-12A"
    assert one(spark, "https://x/y/executive-order-123-a+b%20c/", text.title_from_url) == "a+b c"
    assert one(spark, "  a  b \n   c   ", text.display_text) == "a\n\nb\n\nc"
    assert [tuple(m) for m in one(spark, "ab a ab", lambda c: text.match_spans(c, r"\bab\b"))] == [(0, 2, "ab"), (5, 7, "ab")]
    assert one(spark, "x" * 25, lambda c: F.size(text.text_windows(c, 10, 5))) == 4
    assert one(spark, "", text.try_number) is None and one(spark, "1.5", text.try_number) == 1.5
    with pytest.raises(Exception, match="finite"):
        one(spark, "Infinity", text.try_number)


@pytest.mark.parametrize(
    ("kind", "body", "title", "want"),
    [
        ("proclamation", "flags at half-staff", "", "memorial_half_staff"),
        ("proclamation", "flags at half-staff under the trade agreement", "", None),
        ("memorandum", "I approve the design", "a plain note", None),
        ("memorandum", "approving the design", "the new flag", "symbol_design"),
        ("executive_order", "I call upon all Americans to observe this", "", "public_commemoration"),
        ("executive_order", "text", "campaign-medal", "symbolic_honor"),
        ("proclamation", "do hereby proclaim May 1 as Loyalty Day", "", "observance_designation"),
        ("proclamation", "a National Day of Prayer", "", "national_observance"),
        ("executive_order", "a National Day of Prayer", "", None),
    ],
)
def test_ceremonial(spark, kind, body, title, want):
    df = spark.createDataFrame([(kind, body, title, "https://x/slug/")], "k string, b string, t string, u string")
    assert df.select(rules.ceremonial_reason(*(F.col(c) for c in "kbtu"))).first()[0] == want


def test_references(spark):
    day = datetime.date
    docs = spark.createDataFrame(
        [
            ("1", "executive_order", "10001", day(2000, 1, 1), "Executive Order 10001 begins."),
            ("2", "executive_order", "10002", day(2001, 1, 1), "This order amends Executive Order 10001.\nAs amended, E.O. 10001 stands. Proclamation 77 and Executive Order 99999."),
            ("3", "executive_order", "10003", day(2001, 1, 1), "It revokes Executive Order No. 10002 and cites Executive Order 10002 - A."),
            ("4", "proclamation", "77", day(1999, 1, 1), "nothing"),
            ("5", "proclamation", "88", day(1999, 1, 1), "x"),
            ("6", "proclamation", "88", day(1999, 1, 1), "see Proclamation 88"),
        ],
        "id string, type string, identifier string, date date, text string",
    )
    refs = references.relation(references.references(docs)).withColumnRenamed("id", "child")
    got = {(r["child"], r["identifier"], r["status"], r["relation"]) for r in references.resolve(refs, docs).collect()}
    assert got == {
        ("1", "10001", "self", "citation_discussion"),
        ("2", "10001", "edge", "amends"),
        ("2", "10001", "edge", "citation_discussion"),
        ("2", "77", "cross_type_reference", "citation_discussion"),
        ("2", "99999", "outside_corpus", "citation_discussion"),
        ("3", "10002", "not_earlier", "revokes"),
        ("3", "10002-A", "outside_corpus", "revokes"),
        ("6", "88", "ambiguous_match", "citation_discussion"),
    }
    assert references.edges(references.resolve(refs, docs)).count() == 2


def test_spans(spark):
    d = spark.createDataFrame([(1, "abcdefghij"), (2, "none"), (3, None)], "id int, text string")
    s = spark.createDataFrame([(1, 1, 3, "a"), (1, 2, 5, "b"), (1, 5, 6, "c"), (1, 8, 9, "d")], "id int, start int, end int, kind string")
    m = spans.merge_spans(s, ["id"])
    assert sorted(tuple(r) for r in m.select("start", "end", "kind").collect()) == [(1, 5, "a"), (5, 6, "c"), (8, 9, "d")]
    assert {r["id"]: r["text"] for r in spans.mask(d, m, "#").collect()} == {1: "a##gh#j", 2: "none", 3: None}
    assert spans.mask(d, m, "#").filter("id = 1").first()["text"] == "a##gh#j"


def test_sections(spark):
    rows = [(1, 0, "BODY", False, False), (1, 1, "START", True, False), (1, 2, "(a) more", False, True), (1, 3, "other", False, False), (1, 4, "(b) more", False, True)]
    out = spans.drop_sections(spark.createDataFrame(rows, "id int, i int, t string, s boolean, c boolean"), ["id"], "i", "s", "c")
    assert [r["kept"] for r in out.orderBy("i").collect()] == [True, False, False, True, True]


def test_sentences(spark):
    assert one(spark, "One (two. Three) four. Five! six", segments.sentences) == ["One (two. Three) four.", "Five! six"]
    assert one(spark, "It ends. Sec. 2. Next", segments.resplit_sections) == ["It ends.", "Sec. 2. Next"]
    assert one(spark, "Sec. 3. Text", segments.is_header) and not one(spark, "plain", segments.is_header)
    assert one(spark, "(a) item", segments.is_list_item) and not one(spark, "plain", segments.is_list_item)
    assert one(spark, "the following:", segments.ends_incomplete) and not one(spark, "Done.", segments.ends_incomplete)


def test_alpha_and_kappa(spark):
    a, b, c = [1, 2, 3, 3, 2, 1, 4, None], [1, 2, 3, 3, 2, 2, 4, 1], [None, 3, 3, 3, 2, 3, 4, 2]
    rows = [(i, v) for r in (a, b, c) for i, v in enumerate(r)]
    got = agreement.nominal_alpha(spark.createDataFrame(rows, "unit int, value int"), []).first()["alpha"]
    # by the definition, pair by pair
    units = [[x for x in u if x is not None] for u in zip(a, b, c)]
    units = [u for u in units if len(u) > 1]
    flat = [x for u in units for x in u]
    seen = sum(sum(x != y for x in u for y in u) / (len(u) - 1) for u in units) / len(flat)
    chance = sum(x != y for x in flat for y in flat) / (len(flat) * (len(flat) - 1))
    assert got == pytest.approx(1 - seen / chance)
    same = agreement.kappa(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b").first()
    assert (same["agreement"], same["kappa"]) == (1.0, 1.0)
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "u int, value string")
    assert {r["u"]: r["majority"] for r in agreement.majority(votes, ["u"]).collect()} == {1: "a", 2: None, 3: None}


def test_ranks_and_matrix(spark):
    x = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, None)], "id int, s double").withColumn("g", F.lit(1))
    assert [r["r"] for r in x.select("id", ranking.dense_rank("s", "g").alias("r")).orderBy("id").collect()] == [1, 1, 2, None]
    m = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.2), (1, 1, 0, 0.4), (1, 1, 1, 0.3)], "k int, i int, j int, score double")
    assert similarity.bidirectional_best(m, ["k"]).first()["score"] == pytest.approx(((0.9 + 0.4) / 2 + (0.9 + 0.3) / 2) / 2)
    assert sorted((r["i"], r["j"]) for r in similarity.best_evidence(m, ["k"]).collect()) == [(0, 0), (1, 0), (1, 1)]


def test_text_reuse(spark):
    c = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x")], "id int, text string")
    p = spark.createDataFrame([(9, "a b c d z e f g")], "id int, text string")
    assert [tuple(r) for r in similarity.reused_words(c, p, 3).collect()] == [(1, 9, 7)]


def test_neighbours_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 8))
    rows = [(i, i % 2, i, v[i].tolist()) for i in range(90)]
    got = similarity.earlier_neighbours(spark.createDataFrame(rows, "id long, type int, at long, v array<double>"), 4, block=16).collect()
    for i in (0, 1, 5, 40, 89):
        earlier = sorted((j for j in range(i) if j % 2 == i % 2), key=lambda j: (-(v[i] @ v[j]), j))[:4]
        assert [r["parent"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == earlier


def test_histogram_edges(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 1.0, 5.0, 10.0, None)], "v double")
    assert {r["bin"]: r["n"] for r in stats.histogram(x, "v", 2).collect()} == {1: 2, 2: 2}
    assert stats.histogram(x.filter("v = 5"), "v", 4).first()["n"] == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"",doc_type,url,date,doc_text\n1,memo,u1,"May 1, 2000","say ""yes"", then\nno"\n2,other,u2,,x\n', encoding="utf-8")
    df = tables.read_corpus(spark, [str(tmp_path / "a.csv")], ["memo"])
    assert [(r["id"], r["doc_text"], r["source_file"]) for r in df.collect()] == [("1", 'say "yes", then\nno', "a.csv")]
    with pytest.raises(ValueError):
        tables.read_corpus(spark, [str(tmp_path / "a.csv")] * 2, ["memo"])
    maps = spark.createDataFrame([('{"EO1": "5", "EO2": "x"}',)], "json string")
    assert [r["id"] for r in tables.id_map(maps, "json").collect()] == [5]
    e = spark.createDataFrame([('{"7": {"status": "done", "annotations": [{"start": 1, "end": 3, "label": "L"}]}, "annotator": null}',)], "json string")
    got = tables.annotations(e, spark.createDataFrame([("7", "abcd")], "doc string, text string")).first()
    assert (got["span"], got["label"], got["status"]) == ("bc", "L", "done")
    sinks.write_csv(sinks.public_columns(df.withColumn("_x", F.lit(1))), str(tmp_path / "out"))
    assert "_x" not in spark.read.csv(str(tmp_path / "out"), header=True).columns
    assert "</" not in sinks.payload(spark.createDataFrame([("</script>",)], "t string")).first()["json"]


def test_whole_titles(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    spark.createDataFrame([(1, "A-b " * 200 + "Last!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["str03_title_whole"](spark, str(tmp_path)).first()["title"] == "a b " * 200 + "last"


def test_segment_similarity(spark):
    c = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "x y z"), (2, 0, "a b c"), (3, 0, "A b c")], "id long, i int, text string")
    p = spark.createDataFrame([(7, 0, "a b c"), (7, 1, "p q r"), (8, 0, "x y z")], "id long, i int, text string")
    got = {(r["child"], r["parent"]): r["score"] for r in similarity.segment_similarity(c, p).collect()}
    assert got == {(1, 7): pytest.approx(1 / 3), (2, 7): pytest.approx(1 / 2), (1, 8): pytest.approx(1 / 2)}


def test_scraped_paragraphs_are_trimmed(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    html = "<p> 0a0 </p><p>1 b 1</p><p> 2　</p>\n<p>\t3</p>"
    spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["paragraphs"] for r in QUERIES["src09_scrape_html"](spark, str(tmp_path)).collect()}
    assert got == {1: "0a0|1 b 1|2|\t3", 2: None}


def test_display_lines_are_trimmed(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    spark.createDataFrame([(1, " 0a \n1 b 1\n\n　\n4　c4 "), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["display"] for r in QUERIES["str09_display_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "0a\n\n1 b 1\n\n4　c4", 2: None}


def test_authority_keeps_the_digits_at_a_unit_s_edge(spark):
    clauses = "Whereas it is so: Now, Therefore, by the authority vested in me by section 1"
    got = spark.createDataFrame([([clauses],)], "c array<string>").select(legal.authority_sources(F.col("c")).alias("s")).first()["s"]
    assert got == ["authority vested in me by section 1"]


def test_merged_spans_with_equals_and_nulls(spark):
    rows = [(1, 37, 41, "a"), (1, 32, 36, "r"), (1, 37, 41, "a"), (2, None, None, "a"), (2, 3, 5, "r"), (3, None, None, "a")]
    got = spans.merge_spans(spark.createDataFrame(rows, "id long, start int, end int, kind string"), ["id"]).select("id", "start", "end").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 32, 36), (1, 37, 41), (2, 3, 5), (3, None, None)]


def test_segment_similarity_exchanges_counts_only(spark):
    c = spark.createDataFrame([(1, 0, "a b c d"), (2, 0, "a b c"), (2, 0, "a b c q"), (3, 0, "k l m")], "id long, i int, text string")
    p = spark.createDataFrame([(7, 0, "a b c")], "id long, i int, text string")
    ids = [d.select(F.concat(F.lit(s), "id").alias("id"), "text") for s, d in (("c", c), ("p", p))]
    want = {tuple(r)[:2]: r["weight"] for r in similarity.tfidf(ids[0].union(ids[1]), words=text.tokens(F.col("text"))).collect()}
    got = {tuple(r)[:2]: r["weight"] for r in similarity.shared_weights(*ids).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if k[1] == "a b c"} and len(got) == 3


def test_blank_lines_are_no_segments(spark, tmp_path):
    from quillspark.plans.queries import QUERIES

    for name, key, body in (("documents", "doc_id", "a b c\n　"), ("benchmark", "item_id", "a b c\n ")):
        spark.createDataFrame([(1, body)], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in QUERIES["sim03_trigram_similarity"](spark, str(tmp_path)).collect()] == [(1, 1, 1.0)]
