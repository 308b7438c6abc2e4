"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers (code points) are numbered by occurrence, so each (k-mer, occurrence) is unique, and
hashed to points of a circle. Signature i takes the ``TUPLE`` k-mers that follow i/SLOTS of the circle,
puts them back in text order and hashes that tuple: it agrees for two texts only if the same k-mers are
chosen and stand in the same order. Taking the next points of one circle makes every slot defined for
every text, however short. The likeness of two fingerprints is the share of equal slots.

The edited text of a document needs its neighbour in descending doc_id. Ranges of doc_id are cut at
approximate quantiles; the first document of each range also goes to the range before it, so one
exchange of the texts serves, and each task keeps one row back.

Null and empty texts have the empty fingerprint, which is alike (1) only to itself. Texts shorter than
k are one k-mer. Rows with one doc_id are ordered by text, null ids come last; a single row is its own neighbour. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, pick, small_batches

K, TUPLE, SLOTS = 8, 2, 64
_POINTS = (np.arange(SLOTS, dtype=U64) << U64(58)) if SLOTS == 64 else (np.arange(SLOTS) * (2.0**64 / SLOTS)).astype(U64)
_BASE = U64(0x9E3779B97F4A7C15)


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all windows of k code points; a shorter text is one window."""
    k = min(k, len(points))
    out = np.zeros(len(points) - k + 1, U64)
    for i in range(k):
        out = out * _BASE + (points[i : len(out) + i] + U64(1))
    return mix(out)


def number_occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), U64)
    if same.any():
        inside = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        at = np.sort(order[inside])  # text order
        v = h[at]
        o = np.argsort(v, kind="stable")
        v = v[o]
        first = np.concatenate(([True], v[1:] != v[:-1]))
        begin = np.flatnonzero(first)
        out[at[o]] = (np.arange(len(v)) - np.repeat(begin, np.diff(np.append(begin, len(v))))).astype(U64)
    return out


def fingerprint(text: str) -> np.ndarray:
    """SLOTS 16-bit signatures, none for the empty text."""
    if not text:
        return np.empty(0, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    h = kmers(points)
    u = mix(h + number_occurrences(h) * U64(0xD1B54A32D192ED03))
    order = np.argsort(u)
    at = np.searchsorted(u[order], _POINTS)
    chosen = order[(at[:, None] + np.arange(min(TUPLE, len(u)))) % len(u)]
    chosen.sort(axis=1)
    sig = np.full(SLOTS, len(points) < K, U64)
    for i in range(chosen.shape[1]):
        sig = mix(sig * _BASE + u[chosen[:, i]])
    return (sig >> U64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def written(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def edit(text: str, after: str) -> str:
    """The last half of the text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranges(batches):
    """Rows sorted by range and descending id, a guest last in each range."""
    held = None
    out: list[tuple] = []

    def row(a, after):
        text = a["text"]
        changed = edit(text, after["text"])
        f = fingerprint(changed) if changed != text else a["print"]
        return (a["doc_id"], len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(a["print"]), written(f), likeness(a["print"], f), likeness(a["print"], after["print"]))

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for x in batch.to_pylist():
            x["text"] = x["text"] or ""
            x["print"] = fingerprint(x["text"])
            if held is not None and held["part"] == x["part"]:
                out.append(row(held, x))
            held = None if x["guest"] else x
        yield batch_of(out)
        out = []


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16-bit signatures in hex) of each row."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id="doc_id", text="text")

    def run(batches):
        for batch in batches:
            prints = [written(fingerprint(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fingerprint string")


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and the likeness to both that and the next row's."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = 2 * parts
    bounds = d.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))  # a range ends with its bound; as many as there are ranges, whatever the input
    wide = math.isqrt(len(bounds)) + 1  # two short searches instead of a long one
    coarse, fine = F.array(*[F.lit(b) for b in bounds[wide - 1 :: wide]]).cast("array<bigint>"), F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    steps = F.size(F.filter(coarse, lambda b: b < key)) * wide
    number = steps + F.size(F.filter(F.slice(fine, steps + 1, F.lit(wide)), lambda b: b < key))
    number = (F.lit(len(bounds)) - number).cast("int")  # 0: the highest ids
    ranged = d.withColumns({"part": number, "key": key})
    heads = sorted(ranged.groupBy("part").agg(F.max("key").alias("head"), F.min("key")).collect())  # a row for each range
    goes = {(h["part"], h["head"]): heads[i - 1]["part"] for i, h in enumerate(heads)}
    first = spark.createDataFrame([(p, head, to) for (p, head), to in goes.items()], "part int, key long, to int")
    places = F.when(F.col("to").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest")))
    )
    rows = ranged.join(F.broadcast(first), ["part", "key"], "left").select("doc_id", "key", "text", F.explode(places).alias("p")).select("doc_id", "key", "text", "p.part", "p.guest")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("key").desc(), F.coalesce("text", F.lit("")))
    return rows.select("part", "guest", "doc_id", "text").mapInArrow(_ranges, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
