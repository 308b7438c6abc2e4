"""Scores by a model that the caller supplies: vectors of texts, yes-probabilities of pairs, codes of provisions.

``load`` is a callable without arguments, called once a task, that gives the model. The model is asked for
``length(text)``, ``encode(texts)``, ``score(pairs)`` or ``codes(prompts)``, whichever the operator needs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.text import text_windows

#: Signs of a direct effect, by which the window shown as evidence is chosen.
SIGNS = ("hereby", "prohibited", "suspended", "blocked", "revoked")


def _same(text: str) -> str:
    return text


def encode(df: DataFrame, load: Callable, longest: int, as_query: Callable[[str], str] = _same, text: str = "text") -> DataFrame:
    """df with query and document: unit vectors of each text in both roles.

    A text longer than the model takes is an error, never cut. A null text counts as empty; a zero vector is an error.
    """

    def unit(vectors):
        v = np.asarray(vectors, np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        if not np.isfinite(v).all() or not (norm > 0).all():
            raise ValueError("a vector is zero or not finite")
        return list(v / norm)

    def run(frames):
        model = load()
        for f in frames:
            documents = f[text].fillna("").tolist()
            queries = [as_query(t) for t in documents]
            over = max((model.length(t) for t in documents + queries), default=0)
            if over > longest:
                raise ValueError(f"a text of {over} tokens exceeds the model's {longest}")
            yield f.assign(query=unit(model.encode(queries)), document=unit(model.encode(documents))) if documents else f.assign(query=[], document=[])

    vector = ArrayType(DoubleType())
    return df.mapInPandas(run, StructType([*df.schema.fields]).add("query", vector).add("document", vector))


def _batches(lengths: list[int], most: int, budget: int):
    """(first, last) of runs of at most ``most`` texts and ``budget`` tokens; a longer text goes alone."""
    first = size = 0
    for i, n in enumerate(lengths):
        if i > first and (i - first == most or size + n > budget):
            yield first, i
            first, size = i, 0
        size += n
    if lengths:
        yield first, len(lengths)


def pair_scores(df: DataFrame, load: Callable, most: int = 8, budget: int = 12_000) -> DataFrame:
    """df (query, document, ...) with score: the model's probability of yes. Null texts count as empty."""

    def run(frames):
        model = load()
        for f in frames:
            pairs = list(zip(f["query"].fillna(""), f["document"].fillna(""), strict=True))
            lengths = [model.length(q) + model.length(d) for q, d in pairs]
            yield f.assign(score=[float(s) for a, b in _batches(lengths, most, budget) for s in model.score(pairs[a:b])])

    return df.mapInPandas(run, StructType([*df.schema.fields]).add("score", DoubleType()))


def matched(df: DataFrame, alignments: str) -> DataFrame:
    """df (child, parent: arrays of provisions) with only the provisions that the alignments (child, parent: places) name."""

    def kept(side: str) -> Column:
        places = F.array_sort(F.array_distinct(F.transform(alignments, lambda a: a[side])))
        return F.transform(places, lambda i: F.element_at(side, i + 1))

    return df.withColumns({side: kept(side) for side in ("child", "parent")})


def rerank(df: DataFrame, load: Callable, **limits: int) -> DataFrame:
    """id, score, n_pairs of df (id, child, parent: arrays of packed provisions).

    score is the mean of the best scores of the child's provisions and of the parent's; null without pairs.
    ids must be unique.
    """
    x = df.select("id", F.posexplode("child").alias("c", "query"), "parent").select("id", "c", "query", F.posexplode("parent").alias("p", "document"))
    s = pair_scores(x, load, **limits).select("id", "c", "p", "score")
    sides = [s.groupBy("id", i).agg(F.max("score").alias("best"), F.count("*").alias("n")).groupBy("id").agg(F.avg("best").alias(f"by_{i}"), F.sum("n").alias(f"n_{i}")) for i in ("c", "p")]
    both = sides[0].join(sides[1], "id")
    return df.select("id").join(both, "id", "left").select("id", ((F.col("by_c") + F.col("by_p")) / 2).alias("score"), F.coalesce("n_c", F.lit(0)).cast("long").alias("n_pairs"))


def code_predictions(items: DataFrame, prompts: list[str], load: Callable, code: int = 3, shown: int = 1200) -> DataFrame:
    """id, codes (one a prompt), all_code3, least and most (probability of ``code`` over the prompts), evidence of items (id, type, text).

    Prompts hold {document_type} and {text}. Of a text's windows the one likeliest to have ``code`` speaks for
    each prompt; ties go to the first window and the lowest code. ids must be unique; a null text counts as empty.
    """
    x = items.select("id", "type", F.coalesce("text", F.lit("")).alias("text"))
    said = [F.struct(F.lit(i).alias("k"), F.replace(F.replace(F.lit(p), F.lit("{document_type}"), F.coalesce("type", F.lit(""))), F.lit("{text}"), F.col("window")).alias("prompt")) for i, p in enumerate(prompts)]
    asked = x.select("id", "type", F.posexplode(text_windows(F.col("text"))).alias("w", "window")).select("id", "w", F.explode(F.array(*said)).alias("s")).select("id", "w", "s.k", "s.prompt")

    def run(frames):
        model = load()
        for f in frames:
            yield f.drop(columns="prompt").assign(p=[[float(v) for v in row] for row in model.codes(f["prompt"].tolist())])

    kind = StructType([field for field in asked.schema.fields if field.name != "prompt"]).add("p", ArrayType(DoubleType()))
    best = asked.mapInPandas(run, kind).groupBy("id", "k").agg(F.max_by("p", F.struct(F.element_at("p", code + 1), -F.col("w"))).alias("p"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"])
    per = best.groupBy("id").agg(found.alias("ps"))
    codes = F.transform("ps", lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    odds = F.transform("ps", lambda p: F.element_at(p, code + 1))
    per = per.select("id", codes.alias("codes"), F.forall(codes, lambda c: c == code).alias("all_code3"), F.array_min(odds).alias("least"), F.array_max(odds).alias("most"))

    def signs(w: Column) -> Column:
        out = F.lit(0)
        for sign in SIGNS:
            out = out + F.lower(w).contains(sign).cast("int")
        return out

    ranked = F.transform(text_windows(F.col("text")), lambda w, i: F.struct(signs(w).alias("n"), (-i).alias("i"), w.alias("w")))
    return x.select("id", F.left(F.array_max(ranked)["w"], F.lit(shown)).alias("evidence")).join(per, "id").select("id", "codes", "all_code3", "least", "most", "evidence")
