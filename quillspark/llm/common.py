"""Helpers shared by the training-data operators: tables, shared storage, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import posixpath
import re
import uuid
from functools import lru_cache, wraps
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Most bytes of text hashed in one numpy pass, so that its arrays stay in a core's cache; longer texts go alone.
CHUNK_BYTES = 1 << 17
#: ASCII white space, the complement of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of whole texts small; never raises a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/quillspark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a short lineage that outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote for these frames, once nothing reads it any more."""
    for f in frames:
        spark = f.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def open_out(uri: str):
    """A binary writer for a file in the shared folder, local path or any store that pyarrow reaches."""
    if is_local(uri):
        import os

        path = urlparse(uri).path or uri
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path)


def uncollected(run):
    """run over batches with Python's cycle collector off: these steps make no cycles, and it would scan the remembered words again and again."""

    def out(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return out


_models = []


def worker_model(make):
    """make's results stay in a Python worker and serve all tasks of their step, until ``let_go``."""
    _models.append(lru_cache(maxsize=2)(make))
    return _models[-1]


def let_go() -> None:
    """Drops the models that earlier steps left in this Python worker and gives their memory back to the system."""
    if any(f.cache_info().currsize for f in _models):
        for f in _models:
            f.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=1)
def reuse_memory() -> None:
    """Lets this Python process keep up to 32 MB that it freed for its next arrays; by itself it asks the system for each array over 128 KB anew."""
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        libc = ctypes.CDLL(None)
        for threshold in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(threshold, 1 << 25)


def alone(run):
    """run over batches, without the models of earlier steps beside it."""

    @wraps(run)
    def out(batches):
        let_go()
        return run(batches)

    return out


class Recent(dict):
    """make(key) of recent keys, looked up by ``[]``: at most twice ``limit`` entries, the older go first.

    Keys longer than ``longest`` are made each time.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes raw[start:end]: a polynomial from one running sum, so the cost does not depend on the number of spans."""
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (bytes) of each run of non-space bytes."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, U64), start, end
    return span_hashes(raw, start, end), start, end


def doc_chunks(texts: list[bytes]):
    """(first, last) slices of texts with about CHUNK_BYTES together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, len(texts)


def hashed_docs(texts: list[bytes]):
    """Yields the word hashes of each text, hashed in chunks of many texts."""
    for a, b in doc_chunks(texts):
        part = texts[a:b]
        h, start, _ = word_hashes(b"\n".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        cuts = np.searchsorted(start, ends)
        at = 0
        for c in cuts:
            yield h[at:c]
            at = c


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k-word shingles; fewer words count as one shingle, none as none."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def utf8(column: pa.Array, lower: bool = False) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty; lower maps A-Z only."""
    if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    out = [x or b"" for x in column.to_pylist()]
    return [x.lower() for x in out] if lower else out


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns asked for, under the operator's own names; extra columns never clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == U64 else a.astype(np.int64))
