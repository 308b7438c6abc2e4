"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token counts are raked until their
sums agree with the target shares of every source, language and topic; the ratio of raked to present
tokens is the cell's weight. A document is drawn with the probability min(1, scale x weight), the scale
chosen so that the expected tokens are the wanted share of all. Draws compare a hash of the doc_id with
the probability: they do not depend on partitions and repeat exactly.

Without targets, a margin's shares are its present shares raised to ``flatten`` and normalised. Topics, if
there is no column, are clusters of hashed word counts, fitted to all documents: each round of k-means is a scan
that adds up whole numbers, so the centres do not depend on partitions.

Null sources, languages and topics are values of their own. Null and empty texts have no tokens and
the weight of their cell, or of 1 if the cell has no tokens. Rows with one doc_id are drawn together. An empty table gives an
empty result; extra columns are kept by ``sample`` and ignored by ``probabilities``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, alone, cut, hashed_docs, pick, small_batches, unused, utf8

FEATURES, TOPICS, ROUNDS = 64, 8, 20
#: Features are added up as whole numbers of this fraction.
UNIT = 1 << 24
#: Cells up to which raking runs in the driver (a few MB); beyond, each step is a query over the cells, with the same
#: steps, tolerance and limit of rounds.
DRIVER_CELLS = 100_000
TOLERANCE, GAIN, RAKE_ROUNDS = 1e-9, 1e-4, 200


def settled(worst: float, before: float) -> bool:
    """Whether raking ends: the margins agree, or, if no cells can meet them all, a round gains next to nothing."""
    return worst < TOLERANCE or worst > (1 - GAIN) * before


MARGINS = ("source", "lang", "topic")


def features(h: np.ndarray) -> np.ndarray:
    """Square roots of hashed word counts, of length 1 (0 without words)."""
    v = np.sqrt(np.bincount((h >> U64(58)).astype(np.int64), minlength=FEATURES).astype(np.float64))
    n = np.sqrt((v * v).sum())
    return v / n if n else v


@alone
def _vectors(batches):
    for batch in batches:
        n, v = [], []
        for h in hashed_docs(utf8(batch.column("text"), lower=True)):
            n.append(len(h))
            v.append(np.round(features(h) * UNIT).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64()), pa.array(v, pa.binary())], names=["doc_id", "source", "lang", "n_tokens", "v"])


def _matrix(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, FEATURES)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ centres.T


def _sums(centres: np.ndarray):
    """Rows of (place in the centres, sum of the features of the vectors next to that centre)."""

    def run(batches):
        total = np.zeros((len(centres), FEATURES), np.int64)
        for batch in batches:
            x = _matrix(batch)
            x = x[x.any(axis=1)]
            near = _near(x, centres).argmax(axis=1)
            for j in range(len(centres)):
                total[j] += x[near == j].sum(axis=0, dtype=np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["k", "x"])

    return run


def _farthest(centres: np.ndarray):
    """The task's vector least like its nearest centre."""

    def run(batches):
        best = None
        for batch in batches:
            x = _matrix(batch)
            x = x[x.any(axis=1)]
            if len(x):
                key = np.round(_near(x, centres).max(axis=1) / UNIT, 9)
                here = min((float(key[i]), x[i].tobytes()) for i in np.flatnonzero(key == key.min()))
                best = min(best or here, here)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], names=["key", "v"])

    return run


def fit_topics(vectors: DataFrame, k: int = TOPICS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means over all vectors (doc_id, n_tokens, v), started from documents far from each other."""

    def moved(centres: np.ndarray) -> np.ndarray:
        got = vectors.mapInArrow(_sums(centres), "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).toArrow()  # at most k x FEATURES rows
        c = np.zeros(centres.size)
        c[got["k"].to_numpy()] = got["x"].to_numpy()
        c = c.reshape(centres.shape)
        size = np.sqrt((c * c).sum(axis=1, keepdims=True))
        return np.where(size > 0, c / np.maximum(size, 1), centres)

    def unit(raw: bytes) -> np.ndarray:
        v = np.frombuffer(raw, "<i4").astype(np.float64)
        return v / np.sqrt((v * v).sum())

    one = vectors.filter("n_tokens > 0").orderBy("doc_id", "v").select("v").first()
    if one is None:
        return np.zeros((1, FEATURES))
    centres = unit(one["v"])[None, :]
    vectors = vectors.select("v")
    while len(centres) < k:
        far = vectors.mapInArrow(_farthest(centres), "key double, v binary").agg(F.min(F.struct("key", "v")).alias("x")).first()["x"]
        if far["key"] >= 1 - 1e-6:
            break
        centres = np.vstack([centres, unit(far["v"])])
    for _ in range(rounds):
        old, centres = centres, moved(centres)
        if np.array_equal(old, centres):
            break
    return centres


def _assign(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            topic = _near(_matrix(batch), centres).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(topic.astype(np.int32)), batch.column("n_tokens")], names=["doc_id", "source", "lang", "topic", "n_tokens"])

    return run


def uniform(c: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 11) * (2.0**-53)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each row."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=doc_id, text=text, source=source, lang=lang)
    kind = dict(d.dtypes)
    own = f"doc_id {kind['doc_id']}, source {kind['source']}, lang {kind['lang']}"
    x = cut(d.mapInArrow(_vectors, f"{own}, n_tokens long, v binary"), "mix-vectors")
    return x.mapInArrow(_assign(fit_topics(x)), f"{own}, topic int, n_tokens long")


def flat_targets(shares: dict, flatten: float) -> dict:
    up = {k: v**flatten for k, v in shares.items() if v > 0}
    total = sum(up.values()) or 1.0
    return {k: v / total for k, v in up.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Cells scaled until their sums over each coding are the targets."""
    w, worst = cells.astype(np.float64).copy(), np.inf
    for _ in range(RAKE_ROUNDS):
        before, worst = worst, 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weights=w, minlength=len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target)[now > 0].max(initial=0)) / max(target.sum(), 1e-300))
            w *= factor[code]
        if settled(worst, before):
            break
    return w


def scale_for(tokens: np.ndarray, weight: np.ndarray, share: float) -> float:
    """s with sum(tokens min(1, s weight)) = share of all tokens, or the s that draws all that can be."""
    order = np.argsort(-weight)
    t, w = tokens[order].astype(np.float64), weight[order]
    whole = np.concatenate(([0.0], np.cumsum(t)))  # tokens of the cells drawn in full
    part = np.concatenate((np.cumsum((t * w)[::-1])[::-1], [0.0]))
    for i in range(len(t) + 1):
        if part[i] <= 0:
            break
        s = (share * t.sum() - whole[i]) / part[i]
        if s * w[i] <= 1:
            return max(s, 0.0)
    return 1 / w[w > 0].min() if (w > 0).any() else 1.0


def _rake_cells(cells: DataFrame, targets: dict, flatten: float, share: float) -> DataFrame:
    rows = cells.toArrow().to_pylist()
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    if not tokens.sum():
        return cells.select(*MARGINS, F.lit(1.0).alias("weight"), F.lit(float(share)).alias("p"))
    codes, goals = [], []
    for m in MARGINS:
        names = {v: i for i, v in enumerate(dict.fromkeys(r[m] for r in rows))}
        code = np.array([names[r[m]] for r in rows])
        now = np.bincount(code, weights=tokens, minlength=len(names)) / tokens.sum()
        goal = targets.get(m) or flat_targets(dict(zip(names, now.tolist(), strict=True)), flatten)
        codes.append(code)
        goals.append(np.array([goal.get(v, 0.0) for v in names]) * tokens.sum())
    goals = [g * tokens.sum() / max(g.sum(), 1e-300) for g in goals]
    w = np.divide(rake(tokens, codes, goals), tokens, out=np.ones_like(tokens), where=tokens > 0)
    p = np.minimum(1.0, scale_for(tokens, w, share) * w)
    out = [(*(r[m] for m in MARGINS), float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)]
    kind = dict(cells.dtypes)
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{m} {kind[m]}" for m in MARGINS) + ", weight double, p double")


def _rake_table(cells: DataFrame, targets: dict, flatten: float, share: float) -> DataFrame:
    """The same, step by step over a table of cells of any size."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*MARGINS, F.lit(1.0).alias("weight"), F.lit(float(share)).alias("p"))
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    goals = {}
    for m in MARGINS:
        there = cells.groupBy(F.col(m).alias("v")).agg((F.sum("tokens") / total).alias("now"))
        if targets.get(m):
            t = spark.createDataFrame(list(targets[m].items()), f"u {dict(cells.dtypes)[m]}, goal double")
            t = there.join(t, there["v"].eqNullSafe(t["u"]), "left").select("v", F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            t = there.select("v", F.when(F.col("now") > 0, F.pow("now", F.lit(flatten))).otherwise(0.0).alias("goal"))
        whole = max(float(t.agg(F.sum("goal")).first()[0]), 1e-300)
        goals[m] = cut(t.withColumn("goal", F.col("goal") * (total / whole)), "mix-goals")
    worst = float("inf")
    for _ in range(RAKE_ROUNDS):
        before, worst = worst, 0.0
        for m in MARGINS:
            now = w.groupBy(F.col(m).alias("v")).agg(F.sum("w").alias("now")).alias("n").join(goals[m].alias("g"), F.col("n.v").eqNullSafe(F.col("g.v")))
            now = cut(now.select("n.v", "now", "goal", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("f")), "mix-factors")
            worst = max(worst, (now.agg(F.max(F.when(F.col("now") > 0, F.abs(F.col("now") - F.col("goal"))))).first()[0] or 0.0) / total)
            w = w.join(now.select("v", "f"), w[m].eqNullSafe(now["v"])).select(*MARGINS, "tokens", (F.col("w") * F.col("f")).alias("w"))
        w = cut(w, "mix-cells")
        if settled(worst, before):
            break
    w = w.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0))
    ends = w.filter("weight > 0").agg(F.min("weight"), F.max("weight")).first()
    low, high = share / ends[1], 1 / ends[0]
    while high > low * (1 + 1e-9):  # halves the logarithm, as weights may differ by many powers of ten
        mid = math.sqrt(low) * math.sqrt(high)
        drawn = w.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), mid * F.col("weight")))).first()[0]
        low, high = (mid, high) if drawn < share * total else (low, mid)
    return w.select(*MARGINS, "weight", F.least(F.lit(1.0), high * F.col("weight")).alias("p"))


def probabilities(docs: DataFrame, share: float = 0.5, targets: dict | None = None, flatten: float = 0.5, seed: int = 11, **columns: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled for every row of docs."""
    m = cut(measure(docs, **columns), "mix-measures")
    cells = m.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    cells = cut(cells, "mix-cells")
    few = cells.count() <= DRIVER_CELLS
    p = (_rake_cells if few else _rake_table)(cells, targets or {}, flatten, share).alias("p")
    p = F.broadcast(p) if few else p
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in MARGINS]
    x = m.alias("m").join(p, same, "left")
    return x.select("m.doc_id", *[f"m.{c}" for c in MARGINS], "m.n_tokens", "p.weight", F.col("p.p").alias("probability"), (uniform(F.col("m.doc_id"), seed) < F.col("p.p")).alias("sampled"))


def sample(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, with all their columns."""
    (key,) = unused(docs, "id")
    drawn = probabilities(docs, doc_id=doc_id, **options).filter("sampled").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(drawn, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)), "left_semi")
