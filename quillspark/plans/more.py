"""More queries over the driver's tables, one for each operator that ``queries`` leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ranking, references, review
from ..sources import sinks
from .queries import count, query, r6


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# sources and sinks


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, count(*) AS n FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL GROUP BY 1")
def src06_id_map(t):
    values = F.explode(F.map_values(F.from_json("props", "map<string,string>")))
    return t("events").select(values.alias("v")).select(F.expr("try_cast(v AS BIGINT)").alias("id")).filter("id IS NOT NULL").groupBy("id").agg(count().alias("n"))


@query("SELECT 'labels' AS output, count(*) AS n FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'documents', CAST(-1 AS BIGINT)")
def snk07_manifest(t):
    old = t("labels").select(F.explode(F.array(F.lit("labels"), F.lit("documents"))).alias("output")).distinct().withColumn("n", F.lit(-1).cast("long"))
    new = t("labels").agg(F.lit("labels").alias("output"), count().alias("n")).unionByName(t("benchmark").agg(F.lit("benchmark").alias("output"), count().alias("n")))
    return old.join(new, "output", "left_anti").unionByName(new)


@query("SELECT doc_id, 0 AS round FROM labels UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk08_resume(t):
    done = t("labels").select("doc_id")
    rest = t("documents").select("doc_id").join(done, "doc_id", "left_anti")
    return done.withColumn("round", F.lit(0)).unionByName(rest.withColumn("round", F.lit(1)))


@query("SELECT o_custkey, o_orderkey, coalesce(CASE WHEN toxic = 1 THEN 'rejected' WHEN toxic = 0 THEN 'accepted' END, 'not_reviewed') AS judgment FROM orders LEFT JOIN labels ON o_orderkey = doc_id")
def snk11_judgments(t):
    x = t("orders").join(t("labels"), F.col("o_orderkey") == F.col("doc_id"), "left")
    said = F.when(F.col("toxic") == 1, "rejected").when(F.col("toxic") == 0, "accepted")
    return x.select("o_custkey", "o_orderkey", F.coalesce(said, F.lit("not_reviewed")).alias("judgment"))


@query("SELECT doc_id, replace(to_json({'doc_id': doc_id, 'lang': lang, 'source': source}), '</', '<\\/') AS json FROM documents")
def snk06_payload(t):
    x = sinks.payload(t("documents").select("doc_id", "lang", "source"), nulls=True)
    return x.select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), "json")


# strings and filters


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def str24_sha256(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def flt01_in_list(t):
    return t("documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\bth[a-z]*tion\b')) AS BIGINT) AS n FROM documents WHERE contains(text, 'tion') AND len(regexp_extract_all(text, '\bth[a-z]*tion\b')) > 0")
def flt03_prefilter(t):
    """A cheap substring test, pushed to the scan, before the costly pattern."""
    x = t("documents").filter(F.contains("text", F.lit("tion")))
    return x.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\bth[a-z]*tion\b"), F.lit(0))).cast("long").alias("n")).filter("n > 0")


@query("SELECT doc_id, contains(lower(text), 'the') AND contains(text, 'tion') AND NOT regexp_matches(text, '\\n') AS hit FROM documents WHERE text IS NOT NULL")
def flt06_compound(t):
    c = F.col("text")
    return t("documents").filter("text IS NOT NULL").select("doc_id", (F.lower(c).contains("the") & c.contains("tion") & ~c.rlike(r"\n")).alias("hit"))


@query(
    "WITH v AS (SELECT o_custkey AS doc, list(DISTINCT o_orderstatus) AS s, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) "
    "SELECT doc, n, u FROM v WHERE len(list_intersect(s, ['F', 'P'])) > 0 AND 2 * u > n"
)
def flt10_hybrid(t):
    """Any chosen status, and more than half of the raters flag it."""
    v = t("orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.collect_set("o_orderstatus").alias("s"), count().alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return v.filter(F.arrays_overlap("s", F.array(F.lit("F"), F.lit("P"))) & (2 * F.col("u") > F.col("n"))).select("doc", "n", "u")


@query("SELECT doc_id, CASE WHEN contains(text, 'zz') THEN NULL WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'the') THEN 'the' END AS reason FROM documents")
def flt05_veto_then_first(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.when(c.contains("zz"), F.lit(None).cast("string")).when(c.contains("tion"), "tion").when(c.contains("the"), "the").alias("reason"))


# joins and sets


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def jon06_one_to_many(t):
    x = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys"))


@query("SELECT o_orderkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'kept' ELSE 'cross_type_reference' END AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def jon08_cross_type(t):
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "kept").otherwise("cross_type_reference").alias("status"))


@query("SELECT s_suppkey, coalesce(m.name, s_name) AS name FROM supplier LEFT JOIN (VALUES (1, 'one'), (3, 'three')) m(k, name) ON s_suppkey = m.k")
def jon10_small_map(t):
    """Corrections of a few fixed rows, which are broadcast as they do not grow."""
    s = t("supplier")
    fixed = F.create_map(F.lit(1), F.lit("one"), F.lit(3), F.lit("three"))
    return s.select("s_suppkey", F.coalesce(F.try_element_at(fixed, F.col("s_suppkey").cast("int")), F.col("s_name")).alias("name"))


@query("SELECT doc_id, lang, quality, n FROM documents JOIN labels USING (doc_id) JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON doc_id = conv_id")
def jon11_three_tables(t):
    n = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(count().alias("n"))
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id").join(n, "doc_id")


@query("SELECT doc_id AS id, 'documents' AS part FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT vec_id, 'embeddings' FROM embeddings")
def set01_union_all(t):
    parts = [t(name).select(F.col(key).cast("long").alias("id"), F.lit(name).alias("part")) for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_custkey AS a, max(o_orderkey) AS b FROM orders GROUP BY 1 UNION SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1")
def set06_union_of_positions(t):
    """Best from either side, each pair once, by one aggregate and no second scan."""
    g = t("orders").groupBy(F.col("o_custkey").alias("a")).agg(F.max("o_orderkey").alias("x"), F.min("o_orderkey").alias("y"))
    return g.select("a", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))


# aggregates


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, count(*) AS n FROM orders GROUP BY 1")
def agg10_percentile(t):
    p = F.percentile("o_totalprice", 0.9)
    checked = F.when(F.count("o_totalprice") > 0, p).otherwise(F.raise_error(F.lit("no values")).cast("double"))
    return t("orders").groupBy("o_orderpriority").agg(F.round(checked, 6).alias("p90"), count().alias("n"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_orderstatus = 'F') AS all_f FROM orders GROUP BY 1")
def agg16_any_all(t):
    f = F.col("o_orderstatus") == "F"
    return t("orders").groupBy("o_custkey").agg(F.bool_or(f).alias("any_f"), F.bool_and(f).alias("all_f"))


@query(
    "WITH c AS (SELECT o_custkey AS id, o_orderstatus AS value, count(*) AS c FROM orders GROUP BY 1, 2), t AS (SELECT id, sum(c) AS n, max(c) AS most FROM c GROUP BY 1) "
    "SELECT t.id, coalesce((SELECT max(value) FROM c WHERE c.id = t.id AND 2 * c.c > t.n), CASE WHEN t.id % 2 = 0 THEN 'tie' END) AS value FROM t"
)
def agg18_strict_majority(t):
    votes = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("value"))
    ties = votes.select("id").distinct().filter("id % 2 = 0").withColumn("value", F.lit("tie"))
    return review.strict_majority(votes, ["id"], "value", ties)


@query("SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (n_chars > 500) AS long_texts, count(DISTINCT source) AS sources FROM documents")
def agg24_facets(t):
    return t("documents").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("n_chars") > 500).alias("long_texts"), F.countDistinct("source").alias("sources"))


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS judged, count(*) AS pairs, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS fully FROM documents LEFT JOIN labels USING (doc_id)")
def agg25_progress(t):
    x = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return x.agg(F.count_if(F.col("quality").isNotNull()).alias("judged"), count().alias("pairs"), F.count_if(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("fully"))


# windows and top rows


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def win02_ordinal_rank(t):
    return longs(t("orders").select("o_custkey", "o_orderkey", ranking.ordinal_rank("o_totalprice", "o_custkey", tie=("o_orderkey",)).alias("rank")), "rank")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, prior, o_orderkey) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS prior FROM orders)")
def win03_rank_with_prior(t):
    x = t("orders").withColumn("prior", ranking.ordinal_rank("o_totalprice", "o_custkey", tie=("o_orderkey",)))
    return longs(x.select("o_custkey", "o_orderkey", ranking.ordinal_rank("o_orderstatus", "o_custkey", tie=("prior", "o_orderkey")).alias("rank")), "rank")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position FROM conversations")
def win04_position(t):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return t("conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(role, 2) OVER w AS after_next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win06_neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead("role", 2).over(w).alias("after_next"))


@query(
    "WITH e AS (SELECT o_custkey AS id, o_orderkey AS s, o_orderkey + 400 AS e FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), "
    "i AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s) AS island FROM m) SELECT id, min(s) AS first, max(e) AS last, count(*) AS n FROM i GROUP BY id, island"
)
def win07_interval_islands(t):
    x = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 400).alias("e"))
    w = Window.partitionBy("id").orderBy("s")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("new", F.when(before.isNull() | (F.col("s") >= before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("id", "island").agg(F.min("s").alias("first"), F.max("e").alias("last"), count().alias("n")).drop("island")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 10 AS top FROM orders")
def top02_top_flag(t):
    return t("orders").select("o_custkey", "o_orderkey", (ranking.ordinal_rank("o_totalprice", "o_custkey", tie=("o_orderkey",)) <= 10).alias("top"))


@query("SELECT o_custkey AS child, rank, o_orderkey AS parent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top04_first_two(t):
    """Ranks 1 and 2; a rank that occurs twice in a group is an error."""
    x = t("orders").withColumn("rank", ranking.ordinal_rank("o_totalprice", "o_custkey", tie=("o_orderkey",)).cast("long")).filter("rank <= 2")
    g = x.groupBy(F.col("o_custkey").alias("child"), "rank").agg(count().alias("n"), F.min("o_orderkey").alias("parent"))
    return g.select("child", "rank", F.when(F.col("n") == 1, F.col("parent")).otherwise(F.raise_error(F.lit("a rank occurs twice")).cast("long")).alias("parent"))


@query("SELECT doc_id, row_number() OVER (ORDER BY lang NULLS LAST, source DESC NULLS FIRST, doc_id) AS place FROM (SELECT * FROM documents ORDER BY lang NULLS LAST, source DESC NULLS FIRST, doc_id LIMIT 100)")
def top06_output_order(t):
    order = [F.col("lang").asc_nulls_last(), F.col("source").desc_nulls_first(), F.col("doc_id")]
    x = t("documents").select("doc_id", "lang", "source").orderBy(*order).limit(100)
    return x.select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 100 rows


@query("SELECT doc_id, row_number() OVER (ORDER BY CAST(quality = 1 AND toxic = 1 AS INT) DESC, quality DESC, toxic DESC, doc_id) AS place FROM (SELECT * FROM labels ORDER BY CAST(quality = 1 AND toxic = 1 AS INT) DESC, quality DESC, toxic DESC, doc_id LIMIT 50)")
def top08_selection(t):
    x = t("labels").withColumn("both", ((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("int"))
    order = review.selection_order("both", "quality", "toxic", "doc_id")
    return x.orderBy(*order).limit(50).select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 50 rows


# similarity, citations, samples, agreement


@query("SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def sim01_dot(t):
    a, b = t("embeddings").select("vec_id", "embedding"), t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    terms = F.zip_with("embedding", "other", lambda x, y: x.cast("double") * y.cast("double"))
    return a.join(b, "vec_id").select(F.col("vec_id").alias("id"), F.round(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), 5).alias("dot"))


@query(
    r"WITH p AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '\b[a-z]+ tion[a-z]*'))) AS phrase FROM benchmark) "
    "SELECT a.item_id AS child, b.item_id AS parent, count(*) AS shared FROM p a JOIN p b ON a.phrase = b.phrase AND a.item_id < b.item_id GROUP BY 1, 2"
)
def sim05_phrase_pairs(t):
    phrases = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\b[a-z]+ tion[a-z]*"), F.lit(0)), lambda m: F.regexp_replace(F.lower(m), r"\s+", " ")))
    p = t("benchmark").select("item_id", F.explode(phrases).alias("phrase"))
    a, b = p.withColumnRenamed("item_id", "child"), p.withColumnRenamed("item_id", "parent")
    return a.join(b, "phrase").filter("child < parent").groupBy("child", "parent").agg(count().alias("shared"))


@query(
    "WITH c AS (SELECT o_orderkey AS id, o_custkey AS child, o_totalprice AS a, o_orderkey % 17 AS b FROM orders), r AS (SELECT *, dense_rank() OVER (PARTITION BY child ORDER BY a DESC) AS ra, dense_rank() OVER (PARTITION BY child ORDER BY b DESC) AS rb FROM c), "
    "f AS (SELECT *, round(1.0 / (20 + ra) + 1.0 / (20 + rb), 9) AS score FROM r) SELECT child, id, ra AS rank_a, rb AS rank_b, score, row_number() OVER (PARTITION BY child ORDER BY score DESC, id) <= 10 AS top FROM f"
)
def sim07_rank_pipeline(t):
    x = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("child"), F.col("o_totalprice").alias("a"), (F.col("o_orderkey") % 17).alias("b"))
    x = x.withColumns({"rank_a": ranking.dense_rank("a", "child").cast("long"), "rank_b": ranking.dense_rank("b", "child").cast("long")})
    x = x.withColumn("score", F.round(ranking.rrf(F.col("rank_a"), F.col("rank_b")), 9))
    return x.select("child", "id", "rank_a", "rank_b", "score", (ranking.ordinal_rank("score", "child", tie=("id",)) <= 10).alias("top"))


@query(
    "WITH e AS (SELECT o_custkey AS child, max(o_orderkey) AS parent FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS n_parents, parent IS NOT NULL AS has_automatic_parent FROM customer LEFT JOIN e ON c_custkey = child"
)
def ref09_artifacts(t):
    e = t("orders").groupBy(F.col("o_custkey").alias("child")).agg(F.max("o_orderkey").alias("parent")).withColumn("relation", F.lit("amends"))
    x = references.artifacts(t("customer").select(F.col("c_custkey").alias("id")), e)
    return x.select("id", F.size("parents").alias("n_parents"), "has_automatic_parent")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 5")
def smp02_per_type(t):
    x = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return ranking.top_k(x, 5, ["lang"], [F.sha2(F.col("doc_id").cast("string"), 256)]).select("doc_id", "lang")


@query(
    "WITH l AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS lap FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lap, source) AS pick FROM l) SELECT doc_id, lang, CASE WHEN pick % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM p WHERE pick <= 10"
)
def smp04_disjoint_halves(t):
    x = t("documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source")
    x = ranking.round_robin(x, ["lang"], "source", "doc_id", 10)
    return x.select("doc_id", "lang", F.when(F.col("pick") % 2 == 1, "A").otherwise("B").alias("half"))


@query(
    "WITH m AS (SELECT lang, round(avg(quality), 6) AS q FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY 1) SELECT (SELECT q FROM m WHERE lang = 'en') AS en, (SELECT q FROM m WHERE lang = 'de') AS de, "
    "round((SELECT q FROM m WHERE lang = 'en') - (SELECT q FROM m WHERE lang = 'de'), 6) AS difference"
)
def sta06_difference(t):
    x = t("documents").join(t("labels"), "doc_id").agg(*[r6(F.avg(F.when(F.col("lang") == g, F.col("quality"))), g) for g in ("en", "de")])
    return x.select("en", "de", F.round(F.col("en") - F.col("de"), 6).alias("difference"))


@query("SELECT doc_id, 'quality' AS field FROM labels WHERE quality NOT IN (1) UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic NOT IN (0)")
def sta07_coded_values(t):
    """Rows whose value is not among those allowed."""
    allowed = {"quality": [1], "toxic": [0]}
    bad = F.array(*[F.when(~F.col(c).isin(v), F.lit(c)) for c, v in allowed.items()])
    return t("labels").select("doc_id", F.explode(F.filter(bad, lambda b: b.isNotNull())).alias("field"))


@query(
    "WITH v AS (SELECT lang, doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality <> toxic THEN 'disagree' ELSE 'agree' END AS s FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT lang, CASE WHEN count(*) FILTER (s = 'disagree') > 0 THEN 'disagree' WHEN count(*) FILTER (s = 'missing') > 0 THEN 'missing' ELSE 'agree' END AS status FROM v GROUP BY lang"
)
def sta11_document_agreement(t):
    x = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return review.document_agreement(x.select("lang", review.row_agreement(F.array("quality", "toxic")).alias("status")), "lang")


@query("SELECT conv_id, turn, substring(text, 1, 4) AS span FROM conversations WHERE role = 'user' AND turn > 1")
def sta12_custom_spans(t):
    """Spans of one label as each rater drew them, listed and not matched to anything."""
    x = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), "text")).alias("a"))
    x = x.select("conv_id", F.explode("a").alias("a")).filter("a.label = 'user' AND a.turn > 1")
    return x.select("conv_id", "a.turn", F.substring(F.col("a.text"), F.col("a.start") + 1, F.col("a.end") - F.col("a.start")).alias("span"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion') AND n_chars > 300")
def udf07_matcher(t):
    def matching(df, predicate):
        return df.filter(predicate)

    return matching(t("documents"), F.contains("text", F.lit("tion")) & (F.col("n_chars") > 300)).select("doc_id")
