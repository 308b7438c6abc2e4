"""Near-duplicate documents: MinHash bands, odd-sketch screening, exact confirmation, components.

1. Each text becomes its set of hashed word shingles. Equal sets are one class, stood for by its least id.
2. ``BANDS`` x ``ROWS`` MinHash samples per class give band keys; the samples folded into a parity bitmap
   give the odd sketch. With 40 bands of 5, a pair of similarity 0.8 shares no band with probability 1e-7.
3. Each class is tested against one of two representatives of each of its band buckets, the one whose odd sketch
   is nearest. The population count of two sketches' XOR estimates the similarity; candidates far under
   the threshold (five standard errors) are dropped, the others are confirmed on their full shingle sets.
   So a group of g near copies costs about g tests, not g squared.
4. A bucket whose members then lie in several components is searched whole: in buckets of up to ``CROWD``
   classes each pair from two components is screened by the sketches and confirmed; in larger ones
   the classes outside the bucket's largest component are a query set that meets all others in blocks of
   ``BLOCK`` x ``BLOCK``, keyed by the bucket. Only confirmed links leave a block. So no pair that could join two
   components is left out, and the pairs within a large group are never listed.
5. Components of the confirmed links, then every copy gets the component of its class.

Null, empty and blank texts have an empty set and are linked with nothing. Rows that repeat an id
share a component; a null id, or one that is no whole number, is linked with nothing and kept. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, alone, cut, discard, hashed_docs, pick, shingles, small_batches, unused, utf8
from .components import components

BANDS, ROWS, SKETCH_LONGS = 40, 5, 8
SAMPLES, BITS = BANDS * ROWS, 64 * SKETCH_LONGS
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SLOT = np.arange(SAMPLES, dtype=U64) << U64(32)
CROWD, BLOCK = 64, 256


def minhashes(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima of random bijections of the shingles' upper 32 bits."""
    x = (s >> U64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the hashed (sample number, minimum) elements, as SKETCH_LONGS words."""
    from .common import mix

    bit = mix(_SLOT | samples.astype(U64)) % U64(BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differences(threshold: float) -> int:
    """The largest XOR count that a pair at the threshold shows, five standard errors allowed."""
    different = 2 * SAMPLES * (1 - threshold)
    stays = math.exp(-2 * different / BITS)
    sampling = 2 * math.sqrt(SAMPLES * threshold * (1 - threshold)) * stays
    folding = math.sqrt(BITS * (1 - stays * stays) / 4)
    return math.ceil(BITS * (1 - stays) / 2 + 5 * math.hypot(sampling, folding / 2))


def estimate(differences: Column) -> Column:
    """Similarity estimated from the XOR population count."""
    odd = F.least(2 * differences / BITS, F.lit(1 - 1e-9))
    return F.greatest(F.lit(0.0), 1 + BITS / (4 * SAMPLES) * F.log(1 - odd))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id"), []
            for h in hashed_docs(utf8(batch.column("text"), lower=True)):
                s = shingles(h, k)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                m = minhashes(s)
                keys = [xxhash.xxh3_64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]
                rows.append((len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), keys, odd_sketch(m).tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "n_shingles", "h1", "h2", "bands", "odd"])

    return alone(run)


def _confirm(k: int, percent: int):
    def run(batches):
        last = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = utf8(batch.column("text_a"), lower=True), utf8(batch.column("text_b"), lower=True)
            keep = []
            sets = hashed_docs(right)
            for i, h in enumerate(sets):
                if last[0] != a[i]:
                    last = (a[i], shingles(next(hashed_docs([left[i]])), k))
                x, y = last[1], shingles(h, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    return run


def signatures(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    d = pick(docs, id=doc_id, text=text).withColumn("id", F.col("id").try_cast("long"))
    return d.mapInArrow(_signatures(k), "id long, n_shingles long, h1 long, h2 long, bands array<long>, odd array<long>")


def _blocks(k: int, percent: int, limit: int):
    """Of rows sorted by block, the links of its query classes (side 0) with the others (side 1)."""

    def links(rows: list[dict]):
        queries, others = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
        if not queries or not others:
            return
        bands, odd = np.array([r["bands"] for r in others]), np.array([r["odd"] for r in others])
        comp, ids = np.array([r["comp"] for r in others]), np.array([r["id"] for r in others])
        sets: dict[int, np.ndarray] = {}

        def shingles_of(r):
            if r["id"] not in sets:
                sets[r["id"]] = shingles(next(hashed_docs([(r["text"] or "").encode().lower()])), k)
            return sets[r["id"]]

        for q in queries:
            near = (bands == np.array(q["bands"])).any(axis=1) & (comp != q["comp"]) & (ids != q["id"])
            near &= np.bitwise_count(odd ^ np.array(q["odd"])).sum(axis=1) <= limit
            joined: set[int] = set()  # one link to a component is enough
            for i in np.flatnonzero(near):
                if comp[i] not in joined:
                    x, y = shingles_of(q), shingles_of(others[i])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        joined.add(comp[i])
                        yield int(ids[i]), q["id"]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if (r["key"], r["bq"], r["bo"]) != key:
                    found += links(rows)
                    key, rows = (r["key"], r["bq"], r["bo"]), []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
        found = list(links(rows))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def _differences(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return cut(two.mapInArrow(_confirm(k, percent), "a long, b long"), "near-links")


def _crowds(now: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, limit: int) -> DataFrame:
    """Of large buckets (key, id, comp), the links of the classes outside the largest component, in blocks."""
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("comp", "n").alias("main"))
    main = main.select("key", "main", F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("nq"), F.ceil(F.col("m") / BLOCK).cast("int").alias("no"))
    member = cut(now.join(main, "key").withColumn("spread", F.xxhash64("id")), "near-members")  # stored, as ties for the largest are free
    queries = member.filter("comp <> main").select("id", "comp", "key", F.lit(0).alias("side"), F.pmod("spread", "nq").cast("int").alias("bq"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("bo"))
    others = member.select("id", "comp", "key", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"), F.pmod("spread", "no").cast("int").alias("bo"))
    whole = reps.join(member.select("id").distinct(), "id", "left_semi").join(texts, "id")
    rows = queries.union(others).join(whole, "id")
    parts = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "bq", "bo").sortWithinPartitions("key", "bq", "bo")
    found = cut(rows.mapInArrow(_blocks(k, percent, limit), "a long, b long"), "near-links")
    discard(member)
    return found


def link(docs: DataFrame, sigs: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """classes (h1, h2, rep) and components (node, component) of representatives that are linked."""
    limit = most_differences(percent / 100)
    full = sigs.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    reps = cut(full.join(classes.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id", "h1", "h2"]).select("id", "bands", "odd"), "near-reps")
    texts = pick(docs, id=doc_id, text=text).withColumn("id", F.col("id").try_cast("long"))
    rows = reps.select("id", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min_by("id", F.xxhash64("id")).alias("other")).filter("n > 1")
    rows = cut(rows.join(heads, "key"), "near-buckets")
    p = rows.select("id", F.explode(F.array("first", "other")).alias("head")).filter("id <> head").distinct()
    p = p.join(reps.select("id", F.col("odd").alias("ox")), "id").join(reps.select(F.col("id").alias("head"), F.col("odd").alias("oy")), "head")
    near = p.select("id", "head", _differences("ox", "oy").alias("d")).filter(F.col("d") <= limit).groupBy("id").agg(F.min_by("head", "d").alias("a"))
    todo = cut(near.select("a", F.col("id").alias("b")), "near-pairs")  # stored, as ties for the nearest are free
    one = _confirmed(todo, texts, k, percent)
    comp = components(one, "near-components")

    now = rows.join(comp, rows["id"] == comp["node"], "left").select("key", "n", "id", F.coalesce("component", "id").alias("comp"))
    open_keys = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    now = cut(now.join(open_keys, "key", "left_semi"), "near-open")
    few = now.filter(F.col("n") <= CROWD).select("key", "id", "comp").join(reps.select("id", "odd"), "id")
    x, y = (few.select("key", F.col("id").alias(i), F.col("comp").alias(f"c{i}"), F.col("odd").alias(f"o{i}")) for i in ("a", "b"))
    pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (_differences("oa", "ob") <= limit)).select("a", "b").distinct()
    two = _confirmed(pairs, texts, k, percent)
    three = _crowds(now.filter(F.col("n") > CROWD).drop("n"), reps, texts, k, percent, limit)
    comp = components(one.union(two).union(three), "near-components")
    discard(rows, todo, now, one, two, three, reps)
    return classes, comp


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sigs = cut(signatures(docs, k, doc_id, text), "near-signatures")
    classes, comp = link(docs, sigs, k, percent, doc_id, text)
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    rows = sigs.select("id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    mine = F.coalesce("component", "id")
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component."""
    (key,) = unused(docs, "id")
    gone = near_duplicates(docs, k, percent, doc_id, text).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").try_cast("long") == F.col(key), "left_anti")
