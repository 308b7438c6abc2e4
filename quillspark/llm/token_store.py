"""Content-addressed store of token ids.

Layout, all Parquet under one folder of the shared storage:
  chunks   key (16-byte digest), data (ids, little-endian unsigned 16 or 32 bit), each chunk once
  recipes  in ascending doc_id order: part, row, doc_id, n_tokens, local_start, keys, root
  manifest part, n_rows, n_tokens, start, root: the Merkle root of the part's recipe roots

A rolling hash over the last ``SPAN`` ids decides the cuts, so an edit moves only the cuts near it and
copies share their chunks. One scan encodes the texts; chunks met before in the same task are not sent
again, and one exchange by digest leaves each chunk once. Reading back checks every chunk against its
digest and every recipe against the Merkle roots. A document's checksum is combined from those of its
chunks, which needs no second move of the ids; ``documents`` returns the ids themselves.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the string of a special token
in a text is that token's id. Null and empty texts hold the end id only. Rows with one doc_id keep their own recipes, ordered by
content; null ids come first. An empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, doc_chunks, mix, pick, shared_dir, small_batches, span_hashes, uncollected, utf8

SPAN, MASK, MIN_IDS, MAX_IDS = 8, 0xFF, 64, 2048
#: A worker remembers the ids of at most 2 ** CACHE_BITS pieces of texts, of at most MOST_IDS ids each.
CACHE_BITS, MOST_IDS = 19, 15
#: Longer pieces get a hash of their own kind and are not remembered.
LONG_PIECE = 64
#: Chunk digests that a task remembers having sent.
SENT_CACHE = 1_000_000
#: Classes of bytes: 1 a space, 2 other ASCII white space, 3 ASCII letters, 4 other visible ASCII,
#: 5 first bytes of characters of which none is white space; 0 is the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x21, 0x80)]] = 4
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 3
_CLASS[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = 5
_CLASS[[*range(9, 14)]] = 2
_CLASS[0x20] = 1
#: The splitting pattern ends a match between these classes, whatever stands around: white space after a visible
#: character, and what is no letter after a letter.
_ENDS = np.zeros((6, 6), bool)
_ENDS[3:5, 2] = _ENDS[3, 4] = True
#: Byte-level vocabularies write a byte as itself if it is printable in Latin-1, else as 256 and up in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted(set(range(256)).difference(_PRINTABLE))
_BYTE_CHARS = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
_SPACE_CHAR = _BYTE_CHARS[32]
#: Fixed value: the splitting pattern of byte-level vocabularies of this kind.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GEAR = mix(np.arange(1 << 16, dtype=U64) + U64(77))


def public_pattern(tokenizer) -> str:
    """The splitting pattern, if the tokenizer is byte-level and splits by it."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("only byte-level tokenizers without normalizer and prefix space are supported")
    return _PATTERN


class WordEncoder:
    """The tokenizers library over whole texts, remembering the ids of recent pieces of texts.

    The strings of special tokens are cut out first, as the library does. Then texts are cut where the
    vocabulary's pattern ends a match whatever stands around (``_ENDS``, before the last white space before a
    visible character, and after it unless it is a space), so ids of pieces put together are the ids of the text. Pieces are found, hashed and put
    together in numpy; only a piece that is new to the worker goes to the library. Pieces of at most
    ``LONG_PIECE`` bytes are told apart by 63 bits of hash; each has two places in a table, and the least lately
    learned go when both are taken.
    """

    def __init__(self, path: str, wide: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u4" if wide or self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        if sys.byteorder != "little":
            raise ValueError("ids are written as little-endian integers")
        self.pattern = regex.compile(public_pattern(self.tokenizer))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that reach into the text beside them are not supported")
        self.added = {t.content.encode(): np.array([i], self.dtype) for i, t in added.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.model = self.tokenizer.model
        self.pack = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]
        # a row for a piece: its hash, then the number of its ids and the ids
        self.known = np.zeros((1 << CACHE_BITS, 1 + (1 + MOST_IDS) * self.dtype.itemsize // 8), U64)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text.encode()])).tobytes()

    def encode_all(self, texts: list[bytes]):
        """Yields the ids of each UTF-8 text, many texts at a time."""
        for a, b in doc_chunks(texts):
            if self.split is None or not any(map(self.split.search, texts[a:b])):
                yield from self._plain(texts[a:b])
                continue
            for text in texts[a:b]:
                parts = self.split.split(text)  # texts and special tokens by turns
                ids = self._plain(parts[::2])
                yield np.concatenate([self.added[x] if i % 2 else ids[i // 2] for i, x in enumerate(parts)])

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\0".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # of the zero after each text
        kind = np.append(_CLASS[raw], np.uint8(0))
        kind[ends] = 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = _ENDS[kind[:-2], kind[1:-1]]
        last = (kind[:-1] > 0) & (kind[:-1] < 3) & (kind[1:] > 2)  # white space before a visible character
        edge[:-1] |= last
        edge[1:] |= last & (kind[:-1] == 2)
        edge[0] = edge[ends] = edge[ends + 1] = True
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        real = np.ones(len(start), bool)
        real[np.searchsorted(start, ends)] = False
        start, end = start[real], end[real]
        h = span_hashes(raw, start, end)
        for i in np.flatnonzero(end - start > LONG_PIECE).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        h |= U64(1)  # 0 is an empty row
        rows = self.known[self._place(h)]
        miss = np.flatnonzero(rows[:, 0] != h)
        other = self.known[self._place(h[miss], 1)]
        hit = other[:, 0] == h[miss]
        rows[miss[hit]] = other[hit]
        miss = miss[~hit]
        long = np.zeros(len(h), bool)
        if len(miss):
            _, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            learned = [self._learn(data[i:j]) for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            new, short = self._rows(h[first], learned)
            rows[miss] = new[which]
            long[miss] = ~short[which]
            self._remember(new[short & (end[first] - start[first] <= LONG_PIECE)])
        ids = rows[:, 1:].view(self.dtype)
        n = ids[:, 0].astype(np.int64)
        out = ids[:, 1:][np.arange(MOST_IDS) < n[:, None]]
        if long.any():
            rest = [np.frombuffer(learned[i], self.dtype) for i in which[long[miss]].tolist()]
            n[long] = list(map(len, rest))
            whole, far = np.empty(n.sum(), self.dtype), np.repeat(long, n)
            whole[~far], whole[far] = out, np.concatenate(rest)
            out = whole
        cuts = np.append(0, np.cumsum(n))[np.searchsorted(start, ends)]
        return np.split(out, cuts[:-1])

    def _place(self, h: np.ndarray, choice: int = 0) -> np.ndarray:
        return (h << U64(31) if choice else h) >> U64(64 - CACHE_BITS)

    def _rows(self, h: np.ndarray, learned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each hash and its ids, and which have at most MOST_IDS; the others' rows hold none."""
        size = self.dtype.itemsize
        n = np.fromiter(map(len, learned), np.int64, len(learned)) // size
        short = n <= MOST_IDS
        rows = np.zeros((len(h), self.known.shape[1]), U64)
        rows[:, 0] = h
        ids = rows[:, 1:].view(self.dtype)
        ids[:, 0] = np.where(short, n, 0)
        ids[:, 1:][np.arange(MOST_IDS) < ids[:, :1]] = np.frombuffer(b"".join([x for x, few in zip(learned, short.tolist(), strict=True) if few]), self.dtype)
        return rows, short

    def _remember(self, new: np.ndarray) -> None:
        """Puts rows in their first places; what was there moves to its second. Of rows with one place, one stays."""
        at = self._place(new[:, 0])
        before = self.known[at]
        before = before[before[:, 0] != 0]
        self.known[self._place(before[:, 0], 1)] = before
        self.known[at] = new

    def _learn(self, piece: bytes) -> bytes:
        """The tokenizer's own splitting, then its model on each part of the piece."""
        if (piece[1:] if piece[0] == 32 else piece).isalpha():  # ASCII letters only, one match
            ids = [t.id for t in self.model.tokenize(piece.decode().replace(" ", _SPACE_CHAR))]
        else:
            text = piece.decode("utf-8", "replace")
            if (text[1:] if text[0] == " " else text).isalpha():
                ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_BYTE_CHARS))]
            else:
                ids = [t.id for x in self.pattern.findall(text) for t in self.model.tokenize(x.encode().decode("latin-1").translate(_BYTE_CHARS))]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else array(self.code, ids).tobytes()


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of SPAN ids, of powers of one number, has its low bits zero."""
    roll, power, reach = _GEAR[ids & 0xFFFF] + ids.astype(U64), 0x9E3779B97F4A7C15, 1
    while reach < SPAN:  # the sums over reach ids give those over twice as many
        more = roll.copy()
        more[reach:] += roll[:-reach] * U64(power)
        roll, power, reach = more, power * power % (1 << 64), 2 * reach
    return np.flatnonzero((mix(roll) & U64(MASK)) == 0) + 1


def chunk_cuts(ids: np.ndarray) -> list[int]:
    """End positions of the chunks: where the rolling hash of SPAN ids has its low bits zero."""
    return cuts_at(marks(ids).tolist(), len(ids))


def cuts_at(found: list[int], n: int) -> list[int]:
    """End positions of the chunks of n ids, from the marks; those before MIN_IDS, which lies beyond SPAN, play no part."""
    cuts, last = [], 0
    for c in found:
        if c - last < MIN_IDS:
            continue
        while c - last > MAX_IDS:
            last += MAX_IDS
            cuts.append(last)
        if c - last >= MIN_IDS:
            cuts.append(c)
            last = c
    while n - last > MAX_IDS:
        last += MAX_IDS
        cuts.append(last)
    if last < n:
        cuts.append(n)
    return cuts


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd last node moves up; no leaves give the empty digest."""
    level = [xxhash.xxh3_128_digest(b"\0" + x) for x in leaves] or [xxhash.xxh3_128_digest(b"")]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """A Python worker's own encoder: its remembered pieces serve all its tasks."""
    return WordEncoder(path)


def _with_cuts(enc: WordEncoder, texts: list[bytes], end: np.ndarray):
    """Yields the ids of each text, the end's with them, and its chunks' end positions; marks are found over many texts at a time."""
    for a, b in doc_chunks(texts):
        docs = [x for ids in enc.encode_all(texts[a:b]) for x in (ids, end)]
        ids = np.concatenate(docs)
        ends = np.cumsum([len(x) for x in docs])[1::2]
        found = marks(ids)
        upto, lo, start = np.searchsorted(found, ends, "right").tolist(), 0, 0
        for stop, hi in zip(ends.tolist(), upto, strict=True):
            yield ids[start:stop], cuts_at((found[lo:hi] - start).tolist(), stop - start)
            lo, start = hi, stop


def _encode(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        end, size = np.array([end_id], enc.dtype), enc.dtype.itemsize
        sent: set[bytes] = set()
        for batch in batches:
            kind, key, doc, n, data = [], [], [], [], []
            for d, (ids, cuts) in zip(batch.column("doc_id").to_pylist(), _with_cuts(enc, utf8(batch.column("text")), end), strict=True):
                buf = ids.tobytes()
                keys, last = [], 0
                for c in cuts:
                    part = buf[last * size : c * size]
                    last = c
                    digest = xxhash.xxh3_128_digest(part)
                    keys.append(digest)
                    if digest not in sent:
                        if len(sent) >= SENT_CACHE:
                            sent.clear()
                        sent.add(digest)
                        kind.append("chunks"), key.append(digest), doc.append(None), n.append(0), data.append(part)
                kind.append("recipes"), key.append(merkle_root(keys)), doc.append(d), n.append(len(ids)), data.append(b"".join(keys))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "doc_id", "n", "data"])

    return uncollected(run)


def _once(batches):
    """Of sorted rows, each chunk once and every recipe."""
    last = None
    for batch in batches:
        keys, kinds, keep = batch.column("key").to_pylist(), batch.column("kind").to_pylist(), []
        for k, kind in zip(keys, kinds, strict=True):
            keep.append(kind == "recipes" or k != last)
            if kind == "chunks":
                last = k
        yield batch.filter(pa.array(keep, pa.bool_()))


def _number(batches):
    """Adds row and local start to the sorted recipes of a part."""
    row = at = 0
    for batch in batches:
        n = np.array(batch.column("n").to_pylist(), np.int64)
        start = at + np.concatenate(([0], np.cumsum(n)))
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.arange(row, row + len(n))), batch.column("doc_id"), batch.column("n"), pa.array(start[:-1]), batch.column("data"), batch.column("key")], names=["part", "row", "doc_id", "n_tokens", "local_start", "keys", "root"])
        row, at = row + len(n), int(start[-1])


def _part_roots(batches):
    """part, n_rows, n_tokens and Merkle root of recipes sorted by part and row; checks each recipe's root."""
    part, roots, n = None, [], 0
    for batch in batches:
        for p, t, keys, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "keys", "root")), strict=True):
            if merkle_root([keys[i : i + 16] for i in range(0, len(keys), 16)]) != root:
                raise ValueError(f"a recipe in part {p} does not match its root")
            if p != part and part is not None:
                yield _part_row(part, roots, n)
                roots, n = [], 0
            part = p
            roots.append(root)
            n += t
    if part is not None:
        yield _part_row(part, roots, n)


def _part_row(part: int, roots: list[bytes], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([n], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], names=["part", "n_rows", "n_tokens", "root"])


@dataclass(frozen=True)
class Store:
    """Where a store lies, how wide its ids are, and the Merkle root over its parts."""

    path: str
    id_bytes: int
    root: str


RECIPE = "part int, row long, doc_id long, n_tokens long, local_start long, keys binary, root binary"


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> Store:
    """Encodes docs into a store; returns its handle."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "token-store")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = d.mapInArrow(_encode(tokenizer, end_id), "kind string, key binary, doc_id long, n long, data binary")
    # chunks meet by digest; recipes are dealt evenly, so that copies of a document do not pile up
    dealt = F.when(F.col("kind") == "chunks", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key"))
    rows = rows.withColumn("deal", dealt).repartition(parts, "deal").drop("deal").sortWithinPartitions("kind", "key")
    rows.mapInArrow(_once, rows.schema).write.partitionBy("kind").parquet(f"{path}/raw")
    raw = spark.read.schema("key binary, doc_id long, n long, data binary, kind string").parquet(f"{path}/raw")
    recipes = raw.filter("kind = 'recipes'").select("doc_id", "n", "data", "key")
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n", "data", "key")
    ordered.mapInArrow(_number, RECIPE).write.parquet(f"{path}/recipes")
    manifest = part_roots(spark, path).collect()  # a row for each part
    start, out = 0, []
    for m in sorted(manifest):
        out.append((m["part"], m["n_rows"], m["n_tokens"], start, bytes(m["root"])))
        start += m["n_tokens"]
    spark.createDataFrame(out, "part int, n_rows long, n_tokens long, start long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    return Store(path, 4 if wide else 2, merkle_root([x[-1] for x in out]).hex())


def part_roots(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes").select("part", "row", "n_tokens", "keys", "root")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return recipes.repartition(parts, "part").sortWithinPartitions("part", "row").mapInArrow(_part_roots, "part int, n_rows long, n_tokens long, root binary")


def chunks(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n long, data binary, kind string").parquet(f"{store.path}/raw").filter("kind = 'chunks'").select("key", "data")


def recipes(spark: SparkSession, store: Store) -> DataFrame:
    """The recipes with their global start, checked against the manifest."""
    manifest = spark.read.schema("part int, n_rows long, n_tokens long, start long, root binary").parquet(f"{store.path}/manifest")
    stored = sorted(manifest.collect())  # a row for each part
    if merkle_root([bytes(m["root"]) for m in stored]).hex() != store.root or [tuple(m) for m in sorted(part_roots(spark, store.path).collect())] != [(m["part"], m["n_rows"], m["n_tokens"], m["root"]) for m in stored]:
        raise ValueError("the store's recipes do not match its Merkle manifest")
    r = spark.read.schema(RECIPE).parquet(f"{store.path}/recipes")
    starts = F.broadcast(manifest.select(F.col("part").alias("p"), F.col("start").alias("part_start")))
    return r.join(starts, F.col("part") == F.col("p")).withColumn("start", F.col("part_start") + F.col("local_start")).drop("p", "part_start")


@lru_cache(maxsize=4096)
def _shift_table(n_bytes: int) -> tuple[tuple[int, ...], ...]:
    """Lookup tables of the linear map that n zero bytes apply to a CRC-32 register."""
    columns = []
    zero = zlib.crc32(bytes(n_bytes), 0)
    for bit in range(32):
        columns.append(zlib.crc32(bytes(n_bytes), 1 << bit) ^ zero)
    out = []
    for byte in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ columns[8 * byte + low.bit_length() - 1]
        out.append(tuple(t))
    return tuple(out)


def crc_concat(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings put together, from their own and the second's length."""
    t = _shift_table(n_bytes)
    return t[0][first & 255] ^ t[1][first >> 8 & 255] ^ t[2][first >> 16 & 255] ^ t[3][first >> 24] ^ second


def _check_chunks(id_bytes: int):
    def run(batches):
        for batch in batches:
            keys, crc, n = batch.column("key").to_pylist(), [], []
            for k, data in zip(keys, batch.column("data").to_pylist(), strict=True):
                if xxhash.xxh3_128_digest(data) != k:
                    raise ValueError(f"chunk {k.hex()} does not match its digest")
                ids = np.frombuffer(data, f"<u{id_bytes}")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["key", "crc", "n"])

    return run


def _combine(batches):
    for batch in batches:
        out = []
        for want, parts in zip(batch.column("n_tokens").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            crc = n = 0
            for p in parts:
                crc, n = crc_concat(crc, p["crc"], 4 * p["n"]), n + p["n"]
            if n != want:
                raise ValueError(f"a document of {want} ids has chunks of {n}")
            out.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _used(r: DataFrame) -> DataFrame:
    """part, row, i, key of every chunk that the recipes name."""
    places = F.transform(F.sequence(F.lit(0), (F.length("keys") / 16 - 1).cast("int")), lambda i: F.struct(i.alias("i"), F.substring("keys", i * 16 + 1, F.lit(16)).alias("key")))
    return r.select("part", "row", F.explode(places).alias("e")).select("part", "row", "e.i", "e.key")


def read_digests(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files."""
    r = recipes(spark, store)
    found = chunks(spark, store).mapInArrow(_check_chunks(store.id_bytes), "key binary, crc long, n long")
    whole = _used(r).join(found, "key", "left").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("i", "crc", "n"))).alias("chunks"))
    return r.select("part", "row", "doc_id", "start", "n_tokens").join(whole, ["part", "row"]).mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of each document, put together from its chunks."""
    r = recipes(spark, store)
    whole = _used(r).join(chunks(spark, store), "key").groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("c"))
    data = F.aggregate("c", F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    return r.select("part", "row", "doc_id", "start", "n_tokens").join(whole, ["part", "row"]).select("doc_id", "start", "n_tokens", data.alias("ids"))
