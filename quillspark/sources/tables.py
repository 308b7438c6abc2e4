"""Readers for CSV corpora, JSON lines, id maps, annotation exports and HTML viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import duplicates

CORPUS = "id string, doc_type string, url string, date string, doc_text string"


def read_corpus(spark: SparkSession, paths: list[str], types: list[str], schema: str = CORPUS) -> DataFrame:
    """CSV files with a header and doubled quotes, kept types only, with source_file; ids and urls must be unique."""
    raw = spark.read.schema(schema).csv(paths, header=True, escape='"', multiLine=True).withColumn("source_file", F.col("_metadata.file_name"))
    out = raw.filter(F.col("doc_type").isin(types))
    for key in ("id", "url"):
        if not duplicates(out, key).isEmpty():
            raise ValueError(f"a document {key} is there more than once")
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def id_map(df: DataFrame, json: str) -> DataFrame:
    """The whole numbers among the values of JSON maps."""
    values = F.explode(F.map_values(F.from_json(json, "map<string,string>")))
    return df.select(values.alias("v")).select(F.expr("try_cast(v as bigint)").alias("id")).filter("id is not null").distinct()


def annotations(exports: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, status, start, end, label, span of exports (json of doc -> {status, annotations}) over texts (doc, text)."""
    kind = "map<string,struct<status:string,annotations:array<struct<start:int,end:int,label:string>>>>"
    docs = exports.select(F.explode(F.from_json("json", kind)).alias("doc", "e")).filter(~F.col("doc").isin("annotator", "document_metadata"))
    flat = docs.select("doc", "e.status", F.explode("e.annotations").alias("a")).select("doc", "status", "a.*")
    x = flat.join(texts.withColumn("__there", F.lit(True)), "doc", "left")
    span = F.when(F.col("__there"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    unknown = F.raise_error(F.concat(F.lit("no document "), F.col("doc"))).cast("string")
    return x.withColumn("span", F.when(F.col("__there").isNull(), unknown).otherwise(span)).drop("text", "__there")


def json_assignment(source, name: str):
    """The JSON array or object that ``var name=`` assigns in a script: up to its closing bracket, strings left out of the count."""
    head = F.lit(f"var {name}=")
    rest = F.regexp_replace(F.substring(source, F.locate(f"var {name}=", source) + F.length(head), F.length(source)), r"(?U)^\s+", "")
    opener = F.left(rest, F.lit(1))
    closer = F.when(opener == "{", "}").otherwise("]")
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|"'), F.lit(0))

    def step(acc, p):
        depth = acc["depth"] + F.when(p == opener, 1).when(p == closer, -1).when(p == '"', 1 << 30).otherwise(0)  # a string without end
        over = acc["over"]
        return F.struct(F.when(over, acc["n"]).otherwise(acc["n"] + F.length(p)).alias("n"), F.when(over, acc["depth"]).otherwise(depth).alias("depth"), (over | (depth == 0)).alias("over"))

    end = F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("over")), step)
    fails = F.raise_error(F.lit(f"no JSON is assigned to {name}")).cast("string")
    return F.when((F.locate(f"var {name}=", source) > 0) & opener.isin("[", "{") & end["over"], F.left(rest, end["n"])).otherwise(fails)


def strip_tags(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]+>", " "), r"\s+", " "))
