"""Scores texts with a causal self-attention model and a smoothed word model, both trained on the corpus.

A text is its words (A-Z lower-cased) and one end. Documents whose crc32(doc_id as text) mod 10 is not 0
train; the others are held out.

* The word counts cover all training texts: each task adds up its own, one exchange adds the tasks'.
* The model works on subword ids of the words and learns from every word of all training texts. All of
  them give the id and pair counts of its prior; in each of ``ROUNDS`` rounds another part of the texts
  trains the network, in shards of ``SHARD_IDS`` ids side by side, whose weights are averaged. The rounds
  together take each text once.
* Frequent ids are leaves of a two-level softmax; the last leaf stands for all others, which share its
  probability by their smoothed counts. So every id sequence has a probability.
* Scoring takes each text once: overlapping windows, batched over texts, count each id exactly once.
  Counts of the ``TOP`` most frequent words are broadcast (2 MB), like the model (3 MB); the rest are joined by their hashes.

Null and empty texts are one end. A null doc_id counts as the empty text, which is held out. Repeated
rows count and are scored row by row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm_model as net
from .common import U64, cut, doc_chunks, hashed_docs, pick, reuse_memory, small_batches, uncollected, utf8

SHARD_IDS, ROUNDS, BATCH, LEAST_STEPS = 400_000, 9, 64, 200
RATE = 4e-3
TOP, HELD = 1 << 17, 1 << 20
SMOOTH, RARE_SMOOTH = 0.1, 0.1
END_HASH = U64(1)
HIDDEN_WINDOWS, SCORE_WINDOWS = 128, 1024
LONG_WORD, KNOWN_WORDS = 256, 400_000


def held_out(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Ids:
    """Words to subword ids of a tiktoken vocabulary, the end last; recent words are remembered.

    New words are encoded together, each with a space in front, and cut apart by their bytes: the
    pattern ends a token at a space. Words over ``LONG_WORD`` code points are encoded in pieces of that length.
    """

    def __init__(self, vocabulary: tuple[str, str]):
        path, pattern = vocabulary
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(n) for token, n in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        if self.end >= 1 << 16:
            raise ValueError("the vocabulary must have under 65,536 ids")
        self.size = np.zeros(self.end, np.int64)
        self.size[list(ranks.values())] = [len(token) for token in ranks]
        self.known: dict[bytes, bytes] = {}
        self.last = np.array([self.end], "<u2").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        texts = [" " + w.decode("utf-8", "replace") for w in words]
        plain = [(w, t) for w, t in zip(words, texts, strict=True) if len(t) <= LONG_WORD]
        got = self.encoding.encode_to_numpy("".join([t for _, t in plain]), disallowed_special=()).astype("<u2")
        cuts = 2 * (np.searchsorted(np.cumsum(self.size[got]), np.cumsum([len(t.encode()) for _, t in plain])) + 1)
        raw, at = got.tobytes(), 0
        for (w, _), end in zip(plain, cuts.tolist(), strict=True):
            self.known[w] = raw[at:end]
            at = end
        for w, t in zip(words, texts, strict=True):
            if len(t) > LONG_WORD:
                pieces = [self.encoding.encode_ordinary(t[i : i + LONG_WORD]) for i in range(0, len(t), LONG_WORD)]
                self.known[w] = np.array([x for piece in pieces for x in piece], "<u2").tobytes()

    def of(self, words: list[bytes], end: bool = True) -> np.ndarray:
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            if len(known) > KNOWN_WORDS:
                known.clear()
            self._learn(list({words[i] for i in new}))
            for i in new:
                out[i] = known[words[i]]
        return np.frombuffer(b"".join(out) + (self.last if end else b""), "<u2")


@lru_cache(maxsize=2)
def subword_ids(vocabulary: tuple[str, str]) -> Ids:
    """A Python worker's own encoder: its remembered words serve all its tasks."""
    return Ids(vocabulary)


def _gather(vocabulary: tuple[str, str]):
    """Rows of (word hash, count) and of each text's key and ids (h null)."""

    def counts_batch(parts):
        h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, weights=c).astype(np.int64)

    def rows(u, c):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary())], names=["h", "n", "key", "ids"])

    def run(batches):
        ids, parts, held = subword_ids(vocabulary), [], 0
        for batch in batches:
            texts = utf8(batch.column("text"), lower=True)
            for a, b in doc_chunks(texts):
                h = np.concatenate([*hashed_docs(texts[a:b]), np.full(b - a, END_HASH)])
                u, c = np.unique(h, return_counts=True)
                parts.append((u, c))
                held += len(u)
            said = [ids.of(t.split()).tobytes() for t in texts]
            if said:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(said), pa.int64()), pa.array([len(x) // 2 for x in said], pa.int64()), batch.column("key"), pa.array(said, pa.binary())], names=["h", "n", "key", "ids"])
            if held > HELD:
                parts = [counts_batch(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*counts_batch(parts))

    return uncollected(run)


def _id_counts(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            total += np.bincount(np.frombuffer(x, "<u2"), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])


def leaf_table(counts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each id, and the log10 probability of each id within its leaf."""
    c = counts[:vocabulary].astype(np.float64)
    order = np.argsort(-c, kind="stable")
    leaf = np.full(1 << 16, net.LEAVES, np.int32)
    leaf[order[: net.LEAVES]] = np.arange(net.LEAVES)
    rare = order[net.LEAVES :]
    within = np.zeros(1 << 16)
    if len(rare):
        within[rare] = np.log10((c[rare] + RARE_SMOOTH) / (c[rare] + RARE_SMOOTH).sum())
    return leaf, within


def _pair_counts(leaf):
    def run(batches):
        size = (net.LEAVES + 2) * (net.LEAVES + 1)
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                y = leaf[np.frombuffer(raw, "<u2")].astype(np.int64)
                x = np.append(net.BEGIN, y[:-1])
                np.add.at(total, x * (net.LEAVES + 1) + y, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    return run


def train_shard(flat: np.ndarray, prior: tuple, texts: list[np.ndarray], leaf: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """One pass of Adam over the texts' windows, at least LEAST_STEPS steps."""
    reuse_memory()
    flat = flat.copy()
    parts = [net.windows(leaf[t]) for t in texts]
    x, y, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
    rng, adam, steps = np.random.default_rng(seed), net.Adam(rate), 0
    while steps < LEAST_STEPS:
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            _, grad = net.loss_and_gradient(flat, prior, x[at], y[at], w[at])
            adam.step(flat, grad)
            steps += 1
    return flat


def _train(shared, round_no: int):
    def run(batches):
        flat, prior, leaf = shared.value
        texts, shard = [], TaskContext.get().partitionId()
        for batch in batches:
            texts += [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]
        if texts:
            n = sum(map(len, texts))
            out = train_shard(flat, prior, texts, leaf, 1000 * round_no + shard, RATE / (1 + round_no))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n)]), pa.array([out.tobytes()], pa.binary())], names=["shard", "weight", "flat"])

    return run


def _average(batches):
    total, weight = None, 0.0
    for batch in batches:
        for w, raw in zip(batch.column("weight").to_pylist(), batch.column("flat").to_pylist(), strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64) * w
            total, weight = x if total is None else total + x, weight + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["weight", "flat"])


def train(texts: DataFrame, leaf: np.ndarray, prior: tuple, n_ids: int) -> np.ndarray:
    """Weights after ROUNDS rounds of training on shards and averaging; texts has key and ids."""
    spark = texts.sparkSession
    flat, shards = net.start(), max(1, math.ceil(n_ids / ROUNDS / SHARD_IDS))
    if not n_ids:
        return flat
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((flat, prior, leaf))
        # written first, so that a lost executor costs its own shards only
        own = cut(texts.filter(F.pmod("key", F.lit(ROUNDS)) == r).repartition(shards, F.xxhash64("key", F.lit(r))).select("ids").mapInArrow(_train(shared, r), "shard int, weight double, flat binary"), "lm-weights")
        groups = math.isqrt(shards - 1) + 1
        rows = sorted(own.withColumn("g", F.col("shard") % groups).repartition(groups, "g").select("weight", "flat").mapInArrow(_average, "weight double, flat binary").collect())  # the square root of the shards
        if not rows:
            continue
        weight = sum(x["weight"] for x in rows)
        flat = (sum(np.frombuffer(x["flat"], np.float32).astype(np.float64) * x["weight"] for x in rows) / weight).astype(np.float32)
        shared.unpersist()
    return flat


def _score(vocabulary: tuple[str, str], shared):
    def run(batches):
        reuse_memory()
        flat, prior, leaf, within, top, logs = shared.value
        p, ids, task, row = net.views(flat), subword_ids(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = utf8(batch.column("text"), lower=True)
            score = np.zeros(len(texts))
            held, size = [], 0

            def flush():
                x, y, m = (np.concatenate([q[1 + i] for q in held]) for i in range(3))
                doc = np.repeat([q[0] for q in held], [len(q[1]) for q in held])
                h = np.concatenate([net.hidden(p, x[i : i + HIDDEN_WINDOWS], m[i : i + HIDDEN_WINDOWS])[0] for i in range(0, len(x), HIDDEN_WINDOWS)])
                x, y, doc = x[m], y[m], np.repeat(doc, m.sum(axis=1))
                for i in range(0, len(x), SCORE_WINDOWS * net.SPAN):
                    at = slice(i, i + SCORE_WINDOWS * net.SPAN)
                    lp = net.log_probs(p, prior, h[at], x[at], y[at])
                    score[:] += np.bincount(doc[at], weights=lp.astype(np.float64), minlength=len(score))  # noqa: B023

            for i, t in enumerate(texts):
                one = ids.of(t.split())
                held.append((i, *net.windows(leaf[one])))
                score[i] += math.log(10) * within[one].sum()
                size += len(held[-1][1])
                if size >= SCORE_WINDOWS:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            n, known, base, miss, times = [], [], [], [], []
            for h in hashed_docs(texts):
                h = np.append(h, END_HASH)
                at = np.searchsorted(top, h)
                hit = top[np.minimum(at, len(top) - 1)] == h if len(top) else np.zeros(len(h), bool)
                rest, c = np.unique(h[~hit], return_counts=True)
                n.append(len(h))
                known.append(int(hit.sum()))
                base.append(float(logs[at[hit]].sum()))
                miss.append(rest.view(np.int64))
                times.append(c)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in miss]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))) for x in (miss, times)]
            rows = pa.array(np.arange(row, row + len(texts), dtype=np.int64) + (task << 40))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score / math.log(10)), *lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "miss", "times"])

    return uncollected(run)


def score(docs: DataFrame, vocabulary: tuple[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    vocabulary is the path of a tiktoken file and the pattern that it splits texts by.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = pick(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out(F.col("doc_id")))
    got = cut(d.filter("not held_out").select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_gather(vocabulary), "h long, n long, key long, ids binary"), "lm-gathered")
    counts = cut(got.filter("h is not null").groupBy("h").agg(F.sum("n").alias("c")), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, distinct = total["n"] or 0, total["v"]
    texts = got.filter("ids is not null").select("key", "ids")
    used = np.zeros(1 << 16, np.int64)
    for r in texts.select("ids").mapInArrow(_id_counts, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # at most 65,536 rows
        used[r["id"]] = r["c"]
    leaf, within = leaf_table(used, Ids(vocabulary).end + 1)
    pairs = np.zeros((net.LEAVES + 2) * (net.LEAVES + 1))
    seen = texts.select("ids").mapInArrow(_pair_counts(leaf), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # a row for a pair of leaves at most
    pairs[seen["id"].to_numpy()] = seen["c"].to_numpy()
    prior = net.prior(pairs.reshape(net.LEAVES + 2, -1))
    flat = train(texts, leaf, prior, int(used.sum()))
    whole = n_train + SMOOTH * (distinct + 1)
    top = counts.orderBy(F.col("c").desc(), "h").limit(TOP).toArrow()
    h, c = top["h"].to_numpy().astype(np.int64).view(U64), top["c"].to_numpy()
    order = np.argsort(h)
    logs = np.log10((c[order] + SMOOTH) / whole)
    shared = spark.sparkContext.broadcast((flat, prior, leaf, within, h[order], logs))
    kind = dict(d.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, miss array<long>, times array<long>"
    x = cut(d.select("doc_id", "held_out", "text").mapInArrow(_score(vocabulary, shared), schema), "lm-scored")
    rest = x.select("row", F.explode(F.arrays_zip("miss", "times")).alias("e")).select("row", F.col("e.miss").alias("h"), F.col("e.times").alias("n"))
    rest = rest.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((F.col("c") + SMOOTH) / whole)).alias("less"))
    out = x.drop("miss", "times").join(rest, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("less", F.lit(0.0))).alias("base_score"), "score",
    )
