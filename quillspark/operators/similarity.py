"""Similarities between documents and between their segments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens, word_shingles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def earlier_neighbours(vectors: DataFrame, k: int = 25, block: int = 2048) -> DataFrame:
    """id, parent, score, rank: for each row the k most similar strictly earlier rows of its type.

    vectors has id, type, at (order of time) and v. Each type is dealt into blocks; a task multiplies one
    block of children with one block of parents and keeps its k best for each child, so no task holds more
    than two blocks and only k rows per child and block are exchanged.
    """
    sized = vectors.withColumn("n", F.count("*").over(Window.partitionBy("type"))).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = sized.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    child = own.select("id", "type", "at", "v", F.col("b").alias("cb"), spread.alias("pb"))
    parent = own.select("id", "type", "at", "v", F.col("b").alias("pb"), spread.alias("cb"))

    def best(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "parent": [], "score": []}
        if len(c) and len(p):
            p = p.sort_values("id")
            s = np.array(c["v"].tolist(), np.float64) @ np.array(p["v"].tolist(), np.float64).T
            s[p["at"].to_numpy()[None, :] >= c["at"].to_numpy()[:, None]] = -np.inf
            ids = p["id"].to_numpy()
            for i, row in zip(c["id"], s, strict=True):
                for j in np.argsort(-row, kind="stable")[:k]:
                    if row[j] > -np.inf:
                        out["id"].append(i), out["parent"].append(ids[j]), out["score"].append(row[j])
        return pd.DataFrame(out)

    found = child.groupBy("type", "cb", "pb").cogroup(parent.groupBy("type", "cb", "pb")).applyInPandas(best, "id long, parent long, score double")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "parent")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bidirectional_best(pairs: DataFrame, by: list[str], i: str = "i", j: str = "j", score: str = "score") -> DataFrame:
    """Mean of the two directions' mean best scores, from the long form of each pair's matrix."""
    left = pairs.groupBy(*by, i).agg(F.max(score).alias("m")).groupBy(*by).agg(F.avg("m").alias("left"))
    right = pairs.groupBy(*by, j).agg(F.max(score).alias("m")).groupBy(*by).agg(F.avg("m").alias("right"))
    return left.join(right, by).select(*by, ((F.col("left") + F.col("right")) / 2).alias("score"))


def best_evidence(pairs: DataFrame, by: list[str], i: str = "i", j: str = "j", score: str = "score") -> DataFrame:
    """The union of every i's best j and every j's best i (the first of equals)."""
    a = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*by, i).orderBy(F.col(score).desc(), j))).filter("r = 1")
    b = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*by, j).orderBy(F.col(score).desc(), i))).filter("r = 1")
    return a.union(b).drop("r").distinct()


def top_mean(pairs: DataFrame, by: list[str], n: int = 3, score: str = "score", tie: tuple[str, ...] = ("i", "j")) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).groupBy(*by).agg(F.avg(score).alias("score"))


def reused_words(children: DataFrame, parents: DataFrame, size: int = 10) -> DataFrame:
    """child, parent, words: words of the child within runs of size words that the parent has too.

    children and parents have id and text. The join is on runs; overlapping runs count their words once.
    """
    c = children.select(F.col("id").alias("child"), tokens(F.col("text")).alias("w")).filter(F.size("w") >= size)
    run = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda p: F.array_join(F.slice("w", p, size), " "))
    c = c.select("child", F.posexplode(run).alias("p", "run"))
    p = parents.select(F.col("id").alias("parent"), F.explode(word_shingles(tokens(F.col("text")), size)).alias("run"))
    w = Window.partitionBy("child", "parent").orderBy("p")
    hit = c.join(p, "run").select("child", "parent", "p", F.lead("p").over(w).alias("q"))
    return hit.groupBy("child", "parent").agg(F.sum(F.least(F.lit(size), F.coalesce(F.col("q") - F.col("p"), F.lit(size)))).cast("long").alias("words"))


def tfidf(segments: DataFrame, n: int = 3, words: Column | None = None) -> DataFrame:
    """id, gram, weight: word n-grams (without words: lower case, two characters or more a word), smooth idf, unit length."""
    words = words if words is not None else F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    grams = segments.select("id", words.alias("w")).filter(F.size("w") >= n)
    grams = grams.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
    tf = grams.groupBy("id", "gram").agg(F.count("*").alias("tf"))
    total = segments.agg(F.count("*").alias("total"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    x = tf.join(df, "gram").withColumn("x", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = x.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, "id").select("id", "gram", (F.col("x") / F.col("norm")).alias("weight"))


def cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """left, right, score of all pairs that share a gram."""
    x, y = a.select(F.col("id").alias("left"), "gram", F.col("weight").alias("wa")), b.select(F.col("id").alias("right"), "gram", F.col("weight").alias("wb"))
    return x.join(y, "gram").groupBy("left", "right").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def _grams(n: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))


def shared_weights(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, gram, weight as by tfidf over both sides, of the grams that right has: all that a cosine between the sides needs.

    left and right have id (never equal across sides) and text; rows of one id are one segment. Of all
    grams only their counts are exchanged, once. Weights and lengths are worked out for the segments of
    left with a gram of right, and for right.
    """
    segments = left.union(right)

    l, r = (d.select("id", tokens(F.col("text")).alias("w")).filter(F.size("w") >= 3) for d in (left, right))
    here = r.select(F.explode(_grams()).alias("gram")).distinct()
    met = l.select("id", F.explode(_grams()).alias("gram")).join(here, "gram", "left_semi").select("id").distinct()
    mine = l.join(met, "id", "left_semi").union(r)
    tf = mine.select("id", F.explode(_grams()).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    every = l.union(r)
    again = segments.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    once = every if again.isEmpty() else every.join(again, "id", "left_anti")
    seen = once.select(F.explode(F.array_distinct(_grams())).alias("gram"))
    if once is not every:  # a gram counts once an id
        seen = seen.union(every.join(again, "id", "left_semi").select("id", F.explode(_grams()).alias("gram")).distinct().select("gram"))
    df = seen.groupBy("gram").agg(F.count("*").alias("df"))
    total = segments.agg(F.count("*").alias("total"))
    x = tf.join(df, "gram").crossJoin(F.broadcast(total))  # one row
    x = x.select("id", "gram", (F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("x"))
    x = x.join(here.withColumn("here", F.lit(True)), "gram", "left")
    by = x.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("here"), F.struct("gram", "x"))).alias("v"))
    return by.select("id", "norm", F.explode("v").alias("v")).select("id", "v.gram", (F.col("v.x") / F.col("norm")).alias("weight"))


def segment_similarity(children: DataFrame, parents: DataFrame, count: int = 3) -> DataFrame:
    """child, parent, score: mean of the count best trigram TF-IDF cosines of their segments; idf over all segments.

    children and parents have id, i (the segment's place) and text. Pairs of segments without a common
    gram count as 0; documents without any such pair are left out.
    """
    both = [d.select(F.struct(F.lit(side).alias("side"), F.col("id").alias("doc"), "i").alias("id"), "text") for side, d in enumerate((children, parents))]
    w = shared_weights(*both)
    pairs = cosine(w.filter("id.side = 0"), w.filter("id.side = 1")).select(F.col("left.doc").alias("child"), F.col("right.doc").alias("parent"), F.col("left.i").alias("i"), F.col("right.i").alias("j"), "score")
    best = Window.partitionBy("child", "parent").orderBy(F.col("score").desc(), "i", "j")
    top = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= count).groupBy("child", "parent").agg(F.sum("score").alias("total"))
    sizes = [d.groupBy(F.col("id").alias(name)).agg(F.count("*").alias(f"n_{name}")) for d, name in ((children, "child"), (parents, "parent"))]
    x = top.join(sizes[0], "child").join(sizes[1], "parent")
    return x.select("child", "parent", (F.col("total") / F.least(F.lit(count), F.col("n_child") * F.col("n_parent"))).alias("score"))


def bad_vectors(vectors: DataFrame, width: int, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose vector has another width, a value that is not finite, or no unit length."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return vectors.filter(F.col("v").isNull() | (F.size("v") != width) | odd | (F.abs(F.sqrt(dot(F.col("v"), F.col("v"))) - 1) > tolerance))
