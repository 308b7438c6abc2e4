"""Queries over the driver's tables, one or more for each operator, with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, text
from ..operators import agreement, ranking, references, segments, similarity, spans, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Invented rulebook that matches the tables' prose: (name, pattern).
RULES = [("the_noun", r"\bthe [a-z]+"), ("in_noun", r"\bin [a-z]+"), ("and_noun", r"\band [a-z]+")]
GENERIC, SPECIFIC = [("the", r"\bthe th[a-z]+")], [("of", r"\bof in[a-z]*")]


def count():
    return F.count(F.lit(1))


def query(sql: str | None = None):
    """Registers f(t), where t(name) reads a table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d, f=f: f(lambda n: spark.read.parquet(f"{d.rstrip('/')}/{n}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# sources and sinks


@query("SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE lang IN ('en','fr') AND source IS NOT NULL")
def src01_load_types(t):
    return t("documents").filter(F.col("lang").isin("en", "fr") & F.col("source").isNotNull()).select("doc_id", "lang", "source", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def src02_duplicate_ids(t):
    return stats.duplicates(t("documents").select("doc_id").unionByName(t("labels").select("doc_id")), "doc_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def src04_last_row_wins(t):
    return stats.last_wins(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT (SELECT count(*) FROM documents d ANTI JOIN embeddings e ON d.doc_id = e.vec_id) AS only_documents, (SELECT count(*) FROM embeddings e ANTI JOIN documents d ON d.doc_id = e.vec_id) AS only_vectors")
def src07_id_agreement(t):
    d, e = t("documents").select(F.col("doc_id").alias("id")), t("embeddings").select(F.col("vec_id").alias("id"))
    both = d.join(e, "id", "left_anti").select(F.lit(1).alias("x"), F.lit(0).alias("y")).union(e.join(d, "id", "left_anti").select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("only_documents"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("only_vectors"))


@query(r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(x)), '|') AS paragraphs, CAST(len(regexp_extract_all(html, '<[^>]+>')) AS BIGINT) AS n_tags FROM pages")
def src09_scrape_html(t):
    found = F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))
    return t("pages").select("page_id", F.array_join(F.transform(found, text.strip), "|").alias("paragraphs"), F.size(F.regexp_extract_all("html", F.lit("<[^>]+>"), F.lit(0))).cast("bigint").alias("n_tags"))


@query("SELECT source AS category, count(*) AS n, CAST(max(length(left(text, 32767))) AS BIGINT) AS longest FROM documents GROUP BY source")
def snk05_by_category(t):
    return t("documents").groupBy(F.col("source").alias("category")).agg(count().alias("n"), F.max(F.length(F.left("text", F.lit(32767)))).cast("bigint").alias("longest"))


# scalar functions


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS date_text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def str01_parse_date(t):
    x = t("orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM dd, yyyy").alias("date_text"))
    return x.withColumn("day", text.parse_date(F.col("date_text")).cast("string"))


@query(r"SELECT p_partkey, upper(regexp_replace(regexp_replace(p_brand, '[‐-―−]', '-', 'g'), '\s+', '', 'g')) AS identifier FROM part")
def str02_identifier(t):
    return t("part").select("p_partkey", text.normalize_identifier(F.col("p_brand")).alias("identifier"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(left(text, 200)), '[a-z0-9]+'), ' ') AS title FROM documents")
def str03_title(t):
    return t("documents").select("doc_id", text.normalize_title(F.left("text", F.lit(200))).alias("title"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS title FROM documents")
def str03_title_whole(t):
    return t("documents").select("doc_id", text.normalize_title(F.col("text")).alias("title"))


@query("SELECT page_id, replace(regexp_replace(url_decode(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)), '^(executive-order|proclamation|memorandum)-[0-9]+-', ''), '-', ' ') AS title FROM pages")
def str04_title_from_url(t):
    return t("pages").select("page_id", text.title_from_url(F.col("url")).alias("title"))


@query("SELECT doc_id, left(CASE WHEN contains(text, '. ') THEN split_part(text, '. ', 1) WHEN contains(text, ', ') THEN split_part(text, ', ', 1) ELSE text END, 140) AS title FROM documents")
def str06_directive_title(t):
    first = F.when(F.contains("text", F.lit(". ")), F.substring_index("text", ". ", 1)).when(F.contains("text", F.lit(", ")), F.substring_index("text", ", ", 1)).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.left(first, F.lit(140)).alias("title"))


@query("SELECT n_nationkey, coalesce(m.fixed, n_name) AS name FROM nation LEFT JOIN (VALUES ('FRANCE','Gaul'),('CHINA','Cathay')) m(n, fixed) ON n_name = m.n")
def str08_override_map(t):
    n = t("nation")
    m = n.sparkSession.createDataFrame([("FRANCE", "Gaul"), ("CHINA", "Cathay")], "n string, fixed string")
    return n.join(F.broadcast(m), F.col("n_name") == F.col("n"), "left").select("n_nationkey", F.coalesce("fixed", "n_name").alias("name"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS display FROM documents")
def str09_display_text(t):
    parts = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda p: p != "")
    return t("documents").select("doc_id", F.array_join(parts, "\n\n").alias("display"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*')) AS BIGINT) AS n, sha256(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*'), ' ')) AS digest FROM documents")
def str10_tokens(t):
    w = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("bigint").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("digest"))


@query("WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*') AS w FROM benchmark), s AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 0) + 1), lambda i: array_to_string(w[i:i+9], ' '))) AS s FROM w) SELECT item_id, s AS shingle FROM s GROUP BY ALL")
def str11_shingles(t):
    return t("benchmark").select("item_id", F.explode(text.word_shingles(text.tokens(F.col("text")))).alias("shingle"))


@query(r"""WITH m AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS s FROM documents), x AS (SELECT *, greatest(0, s - 140) AS a, least(length(text), s + 4 + 140) AS b FROM m WHERE s >= 0)
SELECT doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || trim(regexp_replace(substring(text, CAST(a AS INT) + 1, CAST(b - a AS INT)), '[ \t\n\x0B\f\r]+', ' ', 'g')) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS excerpt FROM x""")
def str12_excerpt(t):
    x = t("documents").withColumn("s", F.instr("text", "tion") - 1).filter("s >= 0")
    return x.select("doc_id", text.excerpt(F.col("text"), F.col("s"), F.col("s") + 4).alias("excerpt"))


@query("SELECT doc_id, left(text, strpos(text, 'the') - 1) AS before, substring(text, strpos(text, 'the') + 3, 240) AS after FROM documents WHERE contains(text, 'the')")
def str13_context(t):
    at = F.instr("text", "the")
    return t("documents").filter(F.contains("text", F.lit("the"))).select("doc_id", F.substring("text", F.lit(1), at - 1).alias("before"), F.substring("text", at + 3, F.lit(240)).alias("after"))


@query("WITH n AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 50) / 950.0) AS INT)) AS c FROM documents), w AS (SELECT doc_id, text, unnest(range(0, c)) AS i FROM n) SELECT doc_id, i AS idx, sha256(substring(text, CAST(i * 950 + 1 AS INT), 1000)) AS digest FROM w")
def str14_windows(t):
    x = t("documents").select("doc_id", F.posexplode(text.text_windows(F.col("text"), 1000, 50)).alias("idx", "w"))
    return x.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.sha2("w", 256).alias("digest"))


@query("WITH p AS (SELECT doc_id, string_split(text, 'tion') AS s FROM documents), e AS (SELECT doc_id, unnest(range(1, len(s))) AS i, s FROM p) SELECT doc_id, i AS nth, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + 4 * (i - 1) AS BIGINT) AS start FROM e")
def str15_match_offsets(t):
    x = t("documents").select("doc_id", F.posexplode(text.match_spans(F.col("text"), "tion")).alias("i", "m"))
    return x.select("doc_id", (F.col("i") + 1).cast("bigint").alias("nth"), F.col("m.start").cast("bigint").alias("start"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), e AS (SELECT doc_id, lower(unnest(a)) AS k, generate_subscripts(a, 1) AS p FROM w) SELECT doc_id, k AS word, min(p) AS first FROM e WHERE k <> '' GROUP BY ALL")
def str17_first_seen(t):
    x = t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w")).select("doc_id", "p", F.lower("w").alias("word")).filter("word <> ''")
    return x.groupBy("doc_id", "word").agg((F.min("p") + 1).cast("bigint").alias("first"))


@query("SELECT c_custkey, c_mktsegment || ' (' || c_nationkey || ')' AS administration, right(c_name, 4) AS tail FROM customer")
def str18_administration(t):
    return t("customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")")).alias("administration"), F.right("c_name", F.lit(4)).alias("tail"))


@query("SELECT event_id, CASE WHEN value / 100 IS NULL THEN 'missing' WHEN value / 100 >= 0.9 THEN 'very_high' WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.7 THEN 'moderate' ELSE 'low' END AS band FROM events")
def str19_score_band(t):
    return t("events").select("event_id", text.score_band(F.col("value") / 100).alias("band"))


@query("SELECT s_suppkey, split_part(s_name, '#', 1) AS prefix, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM supplier")
def str20_sort_key(t):
    return t("supplier").select("s_suppkey", F.substring_index("s_name", "#", 1).alias("prefix"), F.regexp_extract("s_name", "([0-9]+)$", 1).cast("bigint").alias("number"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN toxic END AS effective FROM labels")
def str21_gated_attribute(t):
    return t("labels").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).alias("effective"))


@query("SELECT item_id, 'Instruct: retrieve' || chr(10) || 'Query: ' || text AS prompt, sha256(text) AS digest FROM benchmark")
def str23_prompt_and_digest(t):
    return t("benchmark").select("item_id", F.format_string("Instruct: retrieve\nQuery: %s", "text").alias("prompt"), F.sha2("text", 256).alias("digest"))


@query("SELECT event_id, CAST(nullif(trim(CAST(value AS VARCHAR)), '') AS DOUBLE) AS v FROM events")
def str25_try_number(t):
    return t("events").select("event_id", text.try_number(F.col("value").cast("string")).alias("v"))


# predicates


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bthe (th|in)')")
def flt02_topic(t):
    return t("documents").filter(F.col("text").rlike(r"(?i)\bthe (th|in)")).select("doc_id")


@query("SELECT doc_id, contains(lower(text), 'erth') OR contains(lower(text), 'ción') OR contains(lower(text), 'keit') AS signal FROM documents")
def flt04_any_substring(t):
    signals = F.array(*[F.lit(s) for s in ("erth", "ción", "keit")])
    return t("documents").select("doc_id", F.exists(signals, lambda s: F.contains(F.lower("text"), s)).alias("signal"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '\\bthe, [a-z]+')) AS match FROM documents")
def flt07_matches(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\bthe, [a-z]+"), F.lit(0))).alias("match"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en','de') AND source IN ('src1','src2','src3')")
def flt08_facets(t):
    return t("documents").filter(F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("de"))) & F.arrays_overlap(F.array("source"), F.array(*[F.lit(s) for s in ("src1", "src2", "src3")]))).select("doc_id")


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_, bool_and(event_type = 'purchase') AS all_, count(*) FILTER (event_type = 'purchase') * 2 > count(*) AS most FROM events GROUP BY user_id")
def flt09_criterion(t):
    hit = F.col("event_type") == "purchase"
    return t("events").groupBy("user_id").agg(F.bool_or(hit).alias("any_"), F.bool_and(hit).alias("all_"), (F.count_if(hit) * 2 > count()).alias("most"))


# segmentation


@query("WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS text, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS idx FROM documents) SELECT doc_id, CAST(idx AS BIGINT) AS idx, sha256(text) AS digest FROM p")
def seg01_paragraphs(t):
    p = segments.paragraphs(t("documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"^ +| +$", "").alias("text")), "\n")
    return p.select(F.col("id").alias("doc_id"), F.col("idx").cast("bigint").alias("idx"), F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, turn, regexp_matches(text, '[:A-Za-z0-9]\\s*$') AS incomplete FROM conversations")
def seg06_incomplete(t):
    return t("conversations").select("conv_id", "turn", F.col("text").rlike(r"[:A-Za-z0-9]\s*$").alias("incomplete"))


@query("WITH s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), g AS (SELECT *, sum(CASE WHEN p = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM s) SELECT conv_id, min(turn) AS first, max(turn) AS last, min(role) AS kind, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, i")
def seg14_islands(t):
    return segments.islands(t("conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, max(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS after_close FROM conversations")
def seg22_closing_cutoff(t):
    x = t("conversations").withColumn("closes", F.col("role") == "assistant")
    return segments.closing_cutoff(x, "conv_id", "turn", "closes").select("conv_id", "turn", "after_close")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND lead(role) OVER w = 'assistant' AND lead(role, 2) OVER w = 'user' THEN 'connector' ELSE role END AS kind FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def seg23_neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    kind = F.when((F.col("role") == "user") & (F.lead("role").over(w) == "assistant") & (F.lead("role", 2).over(w) == "user"), "connector").otherwise(F.col("role"))
    return t("conversations").select("conv_id", "turn", kind.alias("kind"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS ordinal, conv_id || ':oa:' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS segment_id FROM conversations WHERE role = 'assistant'")
def seg24_numbering(t):
    x = segments.number(t("conversations").filter("role = 'assistant'"), "conv_id", "turn")
    return x.select("conv_id", "turn", F.col("ordinal").cast("bigint").alias("ordinal"), "segment_id")


@query("SELECT conv_id, left(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), string_agg(text, chr(10) ORDER BY turn)), 6000) AS excerpt FROM conversations GROUP BY conv_id")
def seg27_excerpt(t):
    def joined(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["text"]), "\n")

    mine = joined(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    return t("conversations").groupBy("conv_id").agg(F.left(F.coalesce(F.nullif(mine, F.lit("")), joined(F.struct("turn", "text"))), F.lit(6000)).alias("excerpt"))


# masking

_SPANS = "SELECT l_orderkey AS id, CAST(l_partkey % 50 AS INT) AS s, CAST(l_partkey % 50 + 1 + l_suppkey % 9 AS INT) AS e, l_returnflag AS kind FROM lineitem"


@query(f"WITH s AS ({_SPANS}), b AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s >= m THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e DESC, kind ROWS UNBOUNDED PRECEDING) AS i FROM b) SELECT id, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY id, i")
def msk01_merge_spans(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.col("l_returnflag").alias("kind"))
    return spans.merge_spans(x, ["id"]).select("id", "start", "end")


@query("SELECT doc_id, replace(text, 'tion', '[AUTHORITY]') AS text, CAST(len(string_split(text, 'tion')) - 1 AS BIGINT) AS n_masked FROM documents")
def msk02_mask(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    s = d.select("id", F.explode(text.match_spans(F.col("text"), "tion")).alias("m")).select("id", "m.start", "m.end", F.lit("suffix").alias("kind"))
    return spans.mask(d, spans.merge_spans(s, ["id"])).withColumnRenamed("id", "doc_id")


@query("""WITH e AS (SELECT conv_id, turn, role, length(text) % 3 = 0 AS st, role = 'assistant' AS co FROM conversations),
f AS (SELECT *, coalesce(last_value(CASE WHEN st THEN true WHEN NOT co THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS state FROM e)
SELECT conv_id, turn, NOT (st OR (state AND co)) AS kept FROM f""")
def msk03_boilerplate_state(t):
    x = t("conversations").withColumns({"starts": F.length("text") % 3 == 0, "continues": F.col("role") == "assistant"})
    return spans.drop_sections(x, ["conv_id"], "turn", "starts", "continues").select("conv_id", "turn", "kept")


# citation graph: orders cite parts of the customer's earlier orders

_INDEX = "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderpriority AS type, CAST(o_custkey AS VARCHAR) AS identifier, CAST(o_orderdate AS DATE) AS date FROM orders"


def _citations(t):
    o = t("orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").cast("string").alias("identifier"), F.to_date("o_orderdate").alias("date"))
    refs = t("lineitem").select(F.col("l_orderkey").alias("child"), F.lit("1-URGENT").alias("type"), F.col("l_partkey").cast("string").alias("identifier"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("relation"))
    return references.resolve(refs, o)


_RESOLVED = f"""WITH o AS ({_INDEX}), r AS (SELECT l_orderkey AS child, '1-URGENT' AS type, CAST(l_partkey AS VARCHAR) AS identifier, l_linenumber AS start, l_returnflag AS relation FROM lineitem),
ix AS (SELECT type, identifier, count(*) AS hits, min(id) AS parent FROM o WHERE identifier IS NOT NULL GROUP BY ALL),
x AS (SELECT r.child, r.start, r.relation, ix.parent, CASE WHEN hits IS NULL THEN 'outside_corpus' WHEN hits > 1 THEN 'ambiguous_match' WHEN r.child = ix.parent THEN 'self' WHEN r.type <> c.type THEN 'cross_type_reference' WHEN p.date >= c.date THEN 'not_earlier' ELSE 'edge' END AS status
FROM r JOIN o c ON c.id = r.child LEFT JOIN ix ON ix.type = r.type AND ix.identifier = r.identifier LEFT JOIN o p ON p.id = ix.parent)"""


@query(_RESOLVED + " SELECT status, count(*) AS n FROM x GROUP BY status")
def ref05_resolution(t):
    return _citations(t).groupBy("status").agg(count().alias("n"))


@query(_RESOLVED + " SELECT child, parent, relation, min(start) AS start FROM x WHERE status = 'edge' GROUP BY ALL")
def ref07_edges(t):
    return references.edges(_citations(t)).select("child", "parent", "relation", "start")


@query(_RESOLVED + " SELECT o_orderkey FROM orders ANTI JOIN x ON o_orderkey = x.child AND x.status = 'edge'")
def ref08_unresolved(t):
    e = references.edges(_citations(t)).select(F.col("child").alias("o_orderkey"))
    return t("orders").select("o_orderkey").join(e, "o_orderkey", "left_anti")


# classifiers


@query("""WITH m AS (SELECT doc_id, 1 AS k, 'the_noun' AS rule, unnest(regexp_extract_all(text, '\\bthe [a-z]+')) AS m FROM documents UNION ALL SELECT doc_id, 2, 'in_noun', unnest(regexp_extract_all(text, '\\bin [a-z]+')) FROM documents
UNION ALL SELECT doc_id, 3, 'and_noun', unnest(regexp_extract_all(text, '\\band [a-z]+')) FROM documents) SELECT doc_id, rule, m AS match, count(*) AS n FROM m GROUP BY ALL""")
def cls01_find_matches(t):
    x = t("documents").select("doc_id", F.explode(rules.find_matches(F.col("text"), RULES)).alias("m"))
    return x.groupBy("doc_id", F.col("m.rule").alias("rule"), F.col("m.text").alias("match")).agg(count().alias("n"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 'no_vesting_clause' WHEN regexp_matches(text, '\\bthe th[a-z]+') AND NOT regexp_matches(text, '\\bof in[a-z]*') THEN 'generic' ELSE 'specific' END AS kind FROM documents")
def cls02_clause_class(t):
    return t("documents").select("doc_id", rules.clause_class(F.filter(F.split("text", "\n"), lambda x: x != ""), GENERIC, SPECIFIC).alias("kind"))


@query("SELECT conv_id, count(DISTINCT role) > 2 AS hybrid, array_to_string(list_sort(list(DISTINCT role)), '+') AS reason FROM conversations GROUP BY conv_id")
def cls08_hybrid(t):
    return t("conversations").groupBy("conv_id").agg((F.countDistinct("role") > 2).alias("hybrid"), F.array_join(F.array_sort(F.collect_set("role")), "+").alias("reason"))


@query(None)
def cer01_ceremonial(t):
    return t("documents").select("doc_id", rules.ceremonial_reason(F.col("lang"), F.col("text"), F.lit(""), F.col("source")).alias("reason"))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jon01_inner(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, coalesce(s_name, 'none') AS s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def jon02_left_default(t):
    return t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left").select("c_custkey", F.coalesce("s_name", F.lit("none")).alias("s_name"))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def jon03_semi(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def jon04_anti(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query("SELECT c.o_orderkey AS child, p.o_orderkey AS parent FROM orders c JOIN orders p ON p.o_custkey = c.o_custkey AND p.o_orderdate < c.o_orderdate")
def jon05_strictly_earlier(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c, p = o.alias("c"), o.alias("p")
    return c.join(p, (F.col("c.o_custkey") == F.col("p.o_custkey")) & (F.col("p.o_orderdate") < F.col("c.o_orderdate"))).select(F.col("c.o_orderkey").alias("child"), F.col("p.o_orderkey").alias("parent"))


@query("SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag <> b.l_returnflag")
def jon07_within_key(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, "l_orderkey").filter(F.col("a.l_returnflag") != F.col("b.l_returnflag")).select("l_orderkey", F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low' WHEN l.doc_id IS NOT NULL THEN 'good' ELSE 'unlabelled' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon09_status(t):
    x = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality").isNotNull(), "good").otherwise("unlabelled").alias("status"))


# aggregates


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg01_count(t):
    return t("events").groupBy("event_type").agg(count().alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, round(count(*) FILTER (event_type = 'click') / nullif(count(*), 0), 6) AS share FROM events GROUP BY user_id")
def agg02_share(t):
    hit = F.count_if(F.col("event_type") == "click")
    return t("events").groupBy("user_id").agg(hit.alias("clicks"), r6(hit / F.nullif(count(), F.lit(0)), "share"))


@query("SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, length(text) > 1500 AS long, count(*) AS n FROM documents GROUP BY CUBE (source, lang), length(text) > 1500")
def agg03_cube(t):
    # the few groups of the finest level are cubed, not the rows
    fine = t("documents").groupBy("source", "lang", (F.length("text") > 1500).alias("long")).agg(count().alias("n"))
    each = F.explode(F.array(*[F.struct(s.alias("s"), v.alias("v")) for s in (F.col("source"), F.lit("total")) for v in (F.col("lang"), F.lit("all"))]))
    return fine.select(each.alias("e"), "long", "n").groupBy(F.col("e.s").alias("source"), F.col("e.v").alias("lang"), "long").agg(F.sum("n").alias("n"))


@query("WITH k AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT DISTINCT f FROM k), s AS (SELECT DISTINCT s FROM k) SELECT f.f, s.s, coalesce(CAST(n AS BIGINT), 0) AS n FROM f CROSS JOIN s LEFT JOIN k ON k.f = f.f AND k.s = s.s UNION ALL SELECT 'all', s, CAST(sum(n) AS BIGINT) FROM k GROUP BY s")
def agg04_dense_sets(t):
    k = t("lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(count().alias("n"))
    domain = k.select("f").distinct().crossJoin(k.select("s").distinct())  # two short domains
    dense = domain.join(k, ["f", "s"], "left").select("f", "s", F.coalesce("n", F.lit(0)).alias("n"))
    return dense.union(k.groupBy("s").agg(F.sum("n").alias("n")).select(F.lit("all"), "s", "n"))


@query("WITH a AS (SELECT l_orderkey, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY 1) SELECT count(*) AS n FROM a FULL JOIN (SELECT o_orderkey FROM orders) o ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL OR o_orderkey IS NULL")
def agg05_reconciliation(t):
    a, o = t("lineitem").select("l_orderkey").distinct(), t("orders").select("o_orderkey")
    return a.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "full").filter("l_orderkey is null or o_orderkey is null").agg(count().alias("n"))


@query("SELECT coalesce(l_returnflag, 'total') AS flag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def agg06_crosstab(t):
    x = t("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"), count().alias("total"))
    return x.rollup("l_returnflag").agg(*[F.sum(c).alias(c) for c in ("f", "o", "total")]).select(F.coalesce("l_returnflag", F.lit("total")).alias("flag"), "f", "o", "total")


@query("SELECT event_type, min(value) AS min, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY event_type")
def agg07_summary(t):
    x = t("events").groupBy("event_type").agg(*stats.summary(F.col("value")))
    return x.select("event_type", "min", r6(F.col("median"), "median"), r6(F.col("mean"), "mean"), "max", r6(F.col("std"), "std"))


@query("WITH r AS (SELECT DISTINCT role FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT c.conv_id, r.role, count(t.turn) AS n FROM c CROSS JOIN r LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.role = r.role GROUP BY ALL) SELECT role, min(n) AS min, round(avg(n), 6) AS mean, max(n) AS max FROM n GROUP BY role")
def agg08_dense_counts(t):
    c = t("conversations")
    roles = c.select("role").distinct()
    n = c.select("conv_id").distinct().crossJoin(F.broadcast(roles)).join(c.groupBy("conv_id", "role").agg(count().alias("k")), ["conv_id", "role"], "left")  # a few roles
    n = n.withColumn("k", F.coalesce("k", F.lit(0)))
    return n.groupBy("role").agg(F.min("k").alias("min"), r6(F.avg("k"), "mean"), F.max("k").alias("max"))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM events GROUP BY event_type")
def agg09_quantiles(t):
    qs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    x = t("events").groupBy("event_type").agg(F.percentile("value", F.array(*[F.lit(q) for q in qs])).alias("p"))
    return x.select("event_type", *[r6(F.col("p")[i], f"p{round(100 * q):02d}") for i, q in enumerate(qs)])


@query("WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(20, floor((o_totalprice - lo) / (hi - lo) * 20) + 1) AS INT) AS bin, count(*) AS n FROM orders, m GROUP BY 1")
def agg11_histogram(t):
    return stats.histogram(t("orders"), "o_totalprice", 20)


@query("SELECT CAST(least(10, floor(value / 50.0 * 10) + 1) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 50 GROUP BY 1")
def agg12_histogram_limits(t):
    return stats.histogram(t("events"), "value", 10, 0.0, 50.0)


@query("SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first FROM orders GROUP BY o_custkey")
def agg13_first_seen(t):
    return t("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).cast("string").alias("first"))


@query("SELECT o_custkey, o_orderkey AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def agg14_arg_max(t):
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("best"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def agg15_ordered_list(t):
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), m AS (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM c) SELECT user_id, CASE WHEN max(m) >= 2 AND count(*) FILTER (c = m) = 1 THEN max(event_type) FILTER (c = m) END AS majority FROM m GROUP BY user_id")
def agg17_majority(t):
    return agreement.majority(t("events").select("user_id", F.col("event_type").alias("value")), ["user_id"])


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'labels_only' WHEN l.doc_id IS NULL THEN 'documents_only' ELSE 'both' END AS cause, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def agg19_missing_causes(t):
    d, l = t("documents").select(F.col("doc_id").alias("d")), t("labels").select(F.col("doc_id").alias("l"))
    cause = F.when(F.col("d").isNull(), "labels_only").when(F.col("l").isNull(), "documents_only").otherwise("both")
    return d.join(l, F.col("d") == F.col("l"), "full").groupBy(cause.alias("cause")).agg(count().alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS weight, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share FROM lineitem GROUP BY l_returnflag")
def agg20_weighted(t):
    q = F.sum("l_quantity")
    return t("lineitem").groupBy("l_returnflag").agg(F.round(q, 4).alias("weight"), r6(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)) / q, "share"))


@query("SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents GROUP BY source")
def agg21_distinct(t):
    return t("documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct(F.sha2("text", 256)).alias("texts"))


@query("SELECT count(*) AS documents, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS clean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def agg22_funnel(t):
    x = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return x.agg(count().alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@query("SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus IN ('F','P')) / nullif(count(*), 0), 6) AS percent FROM orders GROUP BY o_orderpriority")
def agg23_percent(t):
    return t("orders").groupBy("o_orderpriority").agg(r6(100.0 * F.count_if(F.col("o_orderstatus").isin("F", "P")) / F.nullif(count(), F.lit(0)), "percent"))


# windows


@query("SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC) AS BIGINT) AS dense, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000) DESC, CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS ordinal FROM orders")
def win01_ranks(t):
    x = t("orders").withColumns({"s": F.round(F.col("o_totalprice") / 1000), "k": F.col("o_orderkey").cast("string")})
    return x.select("o_orderkey", ranking.dense_rank("s", "o_orderpriority").cast("bigint").alias("dense"), ranking.ordinal_rank("s", "o_orderpriority", tie=("k",)).cast("bigint").alias("ordinal"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_click FROM events")
def win05_latest_event(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w).alias("last_click"))


@query("WITH l AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS lap FROM documents) SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY lap, source) AS BIGINT) AS pick FROM l QUALIFY pick <= 25")
def win08_round_robin(t):
    x = ranking.round_robin(t("documents").select("doc_id", "lang", "source"), ["lang"], "source", "doc_id", 25)
    return x.select("doc_id", "lang", "source", F.col("pick").cast("bigint").alias("pick"))


# top-k and similarity

_NEAR = """WITH v AS (SELECT vec_id AS id, label AS type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT c.id, p.id AS parent, list_dot_product(c.v, p.v) AS score FROM v c JOIN v p ON c.type = p.type AND p.id < c.id)"""


def _near(t, k: int = 25):
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.col("vec_id").alias("at"), F.col("embedding").alias("v"))
    return similarity.earlier_neighbours(v, k)


@query(_NEAR + " SELECT id, parent, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, parent) AS BIGINT) AS rank FROM s QUALIFY rank <= 25")
def top01_earlier_neighbours(t):
    return _near(t).select("id", "parent", r6(F.col("score"), "score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS score FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) GROUP BY o_custkey")
def top03_mean_of_three(t):
    x = similarity.top_mean(t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score")), ["o_custkey"], tie=("o_orderkey",))
    return x.select("o_custkey", r6(F.col("score"), "score"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 10")
def top05_hash_ordered(t):
    return ranking.top_k(t("documents").select("doc_id", "lang"), 10, ["lang"], [F.sha2(F.col("doc_id").cast("string"), 256)]).select("doc_id", "lang")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top07_limit(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def set02_union_distinct(t):
    return t("labels").select("doc_id").union(t("embeddings").select("vec_id")).distinct()


@query("SELECT doc_id FROM labels INTERSECT SELECT vec_id AS doc_id FROM embeddings")
def set03_intersect(t):
    return t("labels").select("doc_id").intersect(t("embeddings").select(F.col("vec_id").alias("doc_id")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set04_except(t):
    return t("documents").select("doc_id").subtract(t("labels").select("doc_id"))


@query("WITH w AS (SELECT conv_id, role, list_distinct(regexp_extract_all(lower(string_agg(text, ' ')), '[a-z]{6,}')) AS w FROM conversations GROUP BY ALL) SELECT a.conv_id, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS shared FROM w a JOIN w b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant' AND len(list_intersect(a.w, b.w)) > 0")
def set05_shared_phrases(t):
    w = t("conversations").groupBy("conv_id", "role").agg(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("w"))
    a, b = w.filter("role = 'user'").alias("a"), w.filter("role = 'assistant'").alias("b")
    both = F.array_sort(F.array_intersect("a.w", "b.w"))
    return a.join(b, "conv_id").select("conv_id", F.array_join(both, " ").alias("shared")).filter("shared <> ''")


_MATRIX = "SELECT a.l_orderkey AS k, a.l_linenumber AS i, b.l_linenumber AS j, abs(a.l_quantity - b.l_quantity) + a.l_discount AS score FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R'"


@query(f"WITH m AS ({_MATRIX}), l AS (SELECT k, avg(m) AS a FROM (SELECT k, i, max(score) AS m FROM m GROUP BY ALL) GROUP BY k), r AS (SELECT k, avg(m) AS b FROM (SELECT k, j, max(score) AS m FROM m GROUP BY ALL) GROUP BY k) SELECT k, round((a + b) / 2, 6) AS score FROM l JOIN r USING (k)")
def sim02_bidirectional_best(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    a, b = x.filter("l_returnflag = 'R'").alias("a"), x.filter("l_returnflag <> 'R'").alias("b")
    m = a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("k"), F.col("a.l_linenumber").alias("i"), F.col("b.l_linenumber").alias("j"), (F.abs(F.col("a.l_quantity") - F.col("b.l_quantity")) + F.col("a.l_discount")).alias("score"))
    return similarity.bidirectional_best(m, ["k"]).select("k", r6(F.col("score"), "score"))


@query("""WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), g AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i+2], ' '))) AS gram FROM w),
tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), x AS (SELECT id, gram, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (gram)),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM x GROUP BY id) SELECT id, gram, round(x / n, 6) AS weight FROM x JOIN n USING (id)""")
def sim03_trigram_tfidf(t):
    return similarity.tfidf(t("benchmark").select(F.col("item_id").alias("id"), "text")).select("id", "gram", r6(F.col("weight"), "weight"))


@query("""WITH l AS (SELECT 0 AS side, doc_id AS id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents UNION ALL SELECT 1, item_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') FROM benchmark),
s AS (SELECT side, id, unnest(range(1, len(l) + 1)) AS i, l FROM l), w AS (SELECT side, id, i, regexp_extract_all(l[i], '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*') AS w FROM s),
g AS (SELECT side, id, i, unnest(list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda k: array_to_string(w[k:k+2], ' '))) AS gram FROM w), tf AS (SELECT side, id, i, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
x AS (SELECT side, id, i, gram, tf * (ln((1 + (SELECT count(*) FROM s)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (gram)), n AS (SELECT side, id, i, sqrt(sum(x * x)) AS n FROM x GROUP BY ALL), v AS (SELECT side, id, i, gram, x / n AS x FROM x JOIN n USING (side, id, i)),
c AS (SELECT a.id AS child, b.id AS parent, a.i AS i, b.i AS j, sum(a.x * b.x) AS score FROM v a JOIN v b USING (gram) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL), k AS (SELECT side, id, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT child, parent, sum(score) AS total FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY child, parent ORDER BY score DESC, i, j) <= 3) GROUP BY ALL)
SELECT child, parent, round(total / least(3, a.n * b.n), 6) AS score FROM t JOIN k a ON a.side = 0 AND a.id = child JOIN k b ON b.side = 1 AND b.id = parent""")
def sim03_trigram_similarity(t):
    def lines(name, key):
        one = F.filter(F.split("text", "\n"), lambda p: text.strip(p) != "")
        return t(name).select(F.col(key).alias("id"), F.posexplode(one).alias("i", "text"))

    return similarity.segment_similarity(lines("documents", "doc_id"), lines("benchmark", "item_id")).select("child", "parent", r6(F.col("score"), "score"))


@query("""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*') AS w FROM documents), p AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)*') AS w FROM benchmark),
cs AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 9, 0) + 1)) AS i, w FROM c), cr AS (SELECT doc_id, i, array_to_string(w[i:i+9], ' ') AS run FROM cs), ps AS (SELECT item_id, unnest(range(1, greatest(len(w) - 9, 0) + 1)) AS i, w FROM p), pr AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS run FROM ps),
h AS (SELECT doc_id, item_id, i, lead(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS q FROM cr JOIN pr USING (run)) SELECT doc_id AS child, item_id AS parent, CAST(sum(least(10, coalesce(q - i, 10))) AS BIGINT) AS words FROM h GROUP BY ALL""")
def sim04_text_reuse(t):
    return similarity.reused_words(t("documents").select(F.col("doc_id").alias("id"), "text"), t("benchmark").select(F.col("item_id").alias("id"), "text"))


@query(_NEAR + """, r AS (SELECT id, parent, row_number() OVER (PARTITION BY id ORDER BY score DESC, parent) AS r1 FROM s QUALIFY r1 <= 10), x AS (SELECT *, CASE WHEN parent % 3 <> 0 THEN dense_rank() OVER (PARTITION BY id ORDER BY CASE WHEN parent % 3 <> 0 THEN parent % 7 END DESC NULLS LAST) END AS r2 FROM r)
SELECT id, parent, round(1.0 / (20 + r1) + coalesce(1.0 / (20 + r2), 0), 6) AS score FROM x""")
def sim06_rank_fusion(t):
    x = _near(t, 10).withColumn("s2", F.when(F.col("parent") % 3 != 0, F.col("parent") % 7)).withColumn("r2", ranking.dense_rank("s2", "id"))
    return x.select("id", "parent", r6(ranking.rrf(F.col("rank"), F.col("r2")), "score"))


@query("SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 1e-3")
def sim08_bad_vectors(t):
    return similarity.bad_vectors(t("embeddings").select("vec_id", F.col("embedding").alias("v")), 64).select("vec_id")


@query(_NEAR + ", a AS (SELECT id, parent FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, parent) = 1), b AS (SELECT id, max(parent) AS parent FROM s GROUP BY id) SELECT count(*) AS n, count(*) FILTER (a.parent = b.parent) AS same FROM a JOIN b USING (id)")
def sim09_top1_agreement(t):
    a = _near(t, 1).select("id", F.col("parent").alias("a"))
    v = t("embeddings").select("vec_id", "label")
    w = Window.partitionBy("label").orderBy("vec_id")
    b = v.select(F.col("vec_id").alias("id"), F.lag("vec_id").over(w).alias("b")).filter("b is not null")
    return a.join(b, "id").agg(count().alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


# samples


@query("SELECT doc_id, lang, CAST(count(*) OVER (PARTITION BY lang) AS BIGINT) AS pool, round(count(*) OVER (PARTITION BY lang) / least(count(*) OVER (PARTITION BY lang), 15), 6) AS weight FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 15")
def smp01_stratified(t):
    return stats.stratified(t("documents").select("doc_id", "lang"), ["lang"], "doc_id", 15).select("doc_id", "lang", "pool", r6(F.col("weight"), "weight"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 40")
def smp03_random_after_exclusion(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(40)


@query("SELECT doc_id, upper(lang) || row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS label FROM documents")
def smp05_id_map(t):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return t("documents").select("doc_id", F.concat(F.upper("lang"), F.row_number().over(w).cast("string")).alias("label"))


# agreement


@query("""WITH r AS (SELECT doc_id AS unit, quality AS value FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels), n AS (SELECT unit, value, count(*) AS c FROM r WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY unit) AS m FROM n QUALIFY m > 1),
o AS (SELECT sum(c) AS n, sum(c * (m - c) / (m - 1)) AS d FROM m), e AS (SELECT sum(k * k) AS kk FROM (SELECT sum(c) AS k FROM m GROUP BY value)) SELECT round(1 - (n - 1) * d / (n * n - kk), 6) AS alpha FROM o, e""")
def sta01_alpha(t):
    l = t("labels")
    r = l.select(F.col("doc_id").alias("unit"), F.col("quality").alias("value")).union(l.select("doc_id", 1 - F.col("toxic")))
    return agreement.nominal_alpha(r, []).select(r6(F.col("alpha"), "alpha"))


@query("WITH x AS (SELECT count(*) AS n, avg(CAST(quality = 1 - toxic AS INT)) AS po, avg(quality) AS pa, avg(1 - toxic) AS pb FROM labels) SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM x")
def sta02_kappa(t):
    x = agreement.kappa(t("labels").select("quality", (1 - F.col("toxic")).alias("other")), "quality", "other")
    return x.select("n", r6(F.col("agreement"), "agreement"), r6(F.col("kappa"), "kappa"))


@query("WITH x AS (SELECT length(d.text) > 500 AS p, l.quality = 1 AS a FROM documents d JOIN labels l USING (doc_id)) SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn, round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0), 6) AS precision, round(count(*) FILTER (p AND a) / nullif(count(*) FILTER (a), 0), 6) AS recall FROM x")
def sta03_confusion(t):
    x = t("documents").select("doc_id", "text").join(t("labels"), "doc_id").agg(*agreement.confusion(F.length("text") > 500, F.col("quality") == 1))
    return x.select("tp", "fp", "fn", "tn", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query("WITH x AS (SELECT o_orderpriority AS p, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS s, sum(o_totalprice) * sum(o_totalprice) / sum(o_totalprice * o_totalprice) AS n FROM orders GROUP BY 1) SELECT p AS o_orderpriority, round(s, 6) AS share, round(n, 3) AS effective_n, round(greatest(0, s - 1.96 * sqrt(s * (1 - s) / n)), 6) AS low, round(least(1, s + 1.96 * sqrt(s * (1 - s) / n)), 6) AS high FROM x")
def sta05_weighted_interval(t):
    x = t("orders").groupBy("o_orderpriority").agg(*agreement.weighted_share(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return x.select("o_orderpriority", r6(F.col("share"), "share"), F.round("effective_n", 3).alias("effective_n"), r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("SELECT user_id, CASE WHEN count(event_type) < count(*) THEN 'incomplete' WHEN count(DISTINCT event_type) > 1 THEN 'disagree' ELSE 'agree' END AS status FROM events GROUP BY user_id")
def sta10_unit_status(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.when(F.count(kind) < count(), "incomplete").when(F.countDistinct(kind) > 1, "disagree").otherwise("agree").alias("status"))


@query("SELECT conv_id, bool_or(role = 'system') AS any_system, max(CASE WHEN role = 'user' THEN length(text) END) AS longest FROM conversations GROUP BY conv_id")
def udf06_roll_up(t):
    return t("conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("any_system"), F.max(F.when(F.col("role") == "user", F.length("text").cast("bigint"))).alias("longest"))


from . import golden, joined, more  # noqa: E402, F401  registers its queries
