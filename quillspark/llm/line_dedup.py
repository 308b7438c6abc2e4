"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its distinct words (A-Z lower-cased), its place is (doc_id, line number). Lines
with equal sets are one class, whose place is its first. A line is removed if an earlier line has a
Jaccard similarity of at least ``percent``/100, which includes every repetition of a class.

The join: the words of a set are ordered from rare to frequent, by counts of all lines folded into a
table of fixed size (any order is exact; a rare-first one is fast). Two sets of that similarity share a
word among their first n - ceil(t n) + 1 (prefix filter), differ in size by at most the factor t (length
filter), and the words left after the first shared one must suffice (positional filter). A parity bitmap
of the words bounds the overlap from above (bitmap filter: an element in one set only flips one bit).
What passes is verified on the whole sets of the lines, at the first word that the prefixes share.

The steps move packed arrays, not a row for each word:

1. A scan writes each line's place, size, set hash, bitmap and prefix. A line that repeats within a
   flush of the scan has no prefix.
2. Lines with one set hash meet; the first place stands for the class, and its prefix words are dealt out.
3. Classes with one prefix word meet, ordered by size. Pairs of up to ``CROWD`` classes are passed on; of a
   larger crowd only its members that have a partner. Words with over ``HOT`` prefix entries skip this step.
4. A second scan takes the sets of the lines concerned. Pairs are verified one by one; the members of a
   crowd meet in blocks of ``BLOCK`` x ``BLOCK``, which put out a count and the first match of each member.

So a group of near copies costs tests in the square of its size, split over tasks, but its pairs are never
listed. Nothing is capped.

Lines without words are kept and match nothing. Null and empty texts have no lines with words. Rows with
the same doc_id share its places: equal rows count as one, and go or stay together. Rows with a null
doc_id, or one that is no whole number, are left as they are. An empty table gives an empty result; extra
columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, alone, cut, discard, doc_chunks, mix, pick, small_batches, unused, utf8, word_hashes

COUNT_BITS, SLICES = 20, 16
#: Rows up to which the needed lines or decisions are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Lines that a task holds before it passes them on, and words or prefix entries that a partition is meant for.
FLUSH, PART_WORDS, PART_ENTRIES = 1 << 16, 20_000_000, 1_000_000
CROWD, HOT, BLOCK, COLUMNS = 64, 1 << 14, 256, 4096
FIRST_SEED, SECOND_SEED, BIT_SEED = U64(0x243F6A8885A308D3), U64(0x13198A2E03707345), U64(0xA4093822299F31D0)
SIGN = U64(1 << 63)
LINE = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("id", "<i8"), ("line", "<i4"), ("n", "<i4")])
HEAD = np.dtype([("b1", "<u8"), ("b2", "<u8"), ("skip", "<i4"), ("k", "<i4")])
ENTRY = np.dtype([("word", "<u8"), ("id", "<i8"), ("b1", "<u8"), ("b2", "<u8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4")])


def packed(records: np.ndarray) -> bytes:
    """The records byte by byte of their fields, so that the many zero bytes lie together and compress."""
    return np.ascontiguousarray(records).view(np.uint8).reshape(len(records), records.dtype.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, len(raw) // kind.itemsize).T).view(kind).ravel()


def least_overlap(n, percent: int):
    """ceil(percent n / 100): what a set of n words must share with any match."""
    return (n * percent + 99) // 100


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - least_overlap(n, percent) + 1


def _words_by_line(texts: list[bytes]):
    """Yields (first text, text of each word, line number of each word, word hash)."""
    for a, b in doc_chunks(texts):
        part = texts[a:b]
        data = b"\n".join(part)
        h, start, _ = word_hashes(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        begins = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
        text = np.searchsorted(begins, start, side="right") - 1
        line = np.searchsorted(breaks, start) - np.searchsorted(breaks, begins)[text]
        yield a, text, line, h


def _slots(parts) -> pa.RecordBatch:
    """How often each slot number occurs in the arrays."""
    total, held, size = np.zeros(1 << COUNT_BITS, np.int64), [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size > 1 << COUNT_BITS:
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["slice", "n"])


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), strict=True):
            x = np.frombuffer(raw, np.int64)
            total[i] = total[i] + x if i in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "n"])


def _table(rows: DataFrame, count) -> np.ndarray:
    """The sums of the tasks' slot tables, of fixed size, added up slice by slice."""
    got = rows.mapInArrow(count, "slice int, n binary").repartition(SLICES, "slice").mapInArrow(_add_up, "slice int, n binary").collect()
    total = np.zeros((SLICES, (1 << COUNT_BITS) // SLICES), np.int64)
    for r in got:
        total[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return total.ravel()


@alone
def _count(batches):
    def slots():
        for batch in batches:
            texts = utf8(batch.column("text"), lower=True)
            for a, b in doc_chunks(texts):
                yield (word_hashes(b"\n".join(texts[a:b]))[0] >> U64(64 - COUNT_BITS)).astype(np.int32)

    yield _slots(slots())


def _rank(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """One number per word that orders rare before frequent and tells words apart."""
    return (ranks[(h >> U64(64 - COUNT_BITS)).astype(np.int64)].astype(U64) << U64(64 - COUNT_BITS)) ^ (mix(h) >> U64(COUNT_BITS))


def _sets(texts: list[bytes], order: np.ndarray):
    """Yields (first text, text and number of each line with words, where its words begin, its distinct ranked words)."""
    for a, text, line, h in _words_by_line(texts):
        if not len(h):
            continue
        r = _rank(h, order)
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])))
        number = np.cumsum(new) - 1
        bits = int(number[-1]).bit_length()
        if bits > 16:
            o = np.lexsort((r, number))
        else:
            o = np.argsort((number.astype(U64) << U64(64 - bits) if bits else U64(0)) | (r >> U64(bits)))
        r = r[o]
        fresh = new | np.concatenate(([True], r[1:] != r[:-1]))
        text, line, r, new = text[fresh], line[fresh], r[fresh], new[fresh]
        begin = np.flatnonzero(new)
        yield a, text[begin], line[begin], begin, r


def _bits(r: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The parity bitmaps of the sets, in two halves."""
    bit = mix(r ^ BIT_SEED) & U64(127)
    flag = U64(1) << (bit & U64(63))
    return [np.bitwise_xor.reduceat(np.where(half, flag, U64(0)), begin) for half in (bit < 64, bit >= 64)]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts, lengths) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _deal(key: np.ndarray, parts: int):
    """(part, rows of it) for rows dealt by their hashed key."""
    part = (mix(key) % U64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), at


def _firsts(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the lines by class and place, and which of them are the first of a class."""
    order = np.argsort(np.ascontiguousarray(rec["s1"]), kind="stable")
    s1 = rec["s1"][order]
    same = s1[1:] == s1[:-1]
    several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    x = rec[order[several]]
    order[several] = order[several][np.lexsort((x["line"], x["id"], x["s2"], x["s1"]))]
    o = rec[order]
    new = np.ones(len(o), bool)
    new[1:] = (o["s1"][1:] != o["s1"][:-1]) | (o["s2"][1:] != o["s2"][:-1])
    return order, new


def _lines(ranks, percent: int, parts: int):
    """Rows of (part, lines, heads, words): what lines of one part of the set hashes are, packed."""

    def pack(held):
        rec, head, words = (np.concatenate([x[i] for x in held]) for i in range(3))
        starts = np.cumsum(head["k"]) - head["k"]
        order, new = _firsts(rec)
        head["k"][order[~new]] = 0
        rows = []
        for part, at in _deal(rec["s1"], parts):
            rows.append((part, packed(rec[at]), packed(head[at]), packed(words[_spans(starts[at], head["k"][at])])))
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "lines", "heads", "words"])

    def run(batches):
        order, once = ranks.value
        held, size = [], 0
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            for a, text, line, begin, r in _sets(utf8(batch.column("text"), lower=True), order):
                n = np.diff(np.append(begin, len(r)))
                rec, head = np.empty(len(begin), LINE), np.empty(len(begin), HEAD)
                rec["id"], rec["line"], rec["n"] = ids[a + text], line, n
                rec["s1"], rec["s2"] = np.add.reduceat(mix(r ^ FIRST_SEED), begin), np.add.reduceat(mix(r ^ SECOND_SEED), begin)
                alone = np.add.reduceat(((r >> U64(64 - COUNT_BITS)) < once).astype(np.int64), begin)  # they come first in their lines
                (head["b1"], head["b2"]), head["skip"], head["k"] = _bits(r, begin), alone, np.maximum(prefix_length(n, percent) - alone, 0)
                held.append((rec, head, r[_spans(begin + alone, head["k"])]))
                size += len(rec)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


def _prefix_counts(batches):
    yield _slots((unpacked(raw, np.dtype("<u8")) >> U64(64 - COUNT_BITS)).astype(np.int32) for batch in batches for raw in batch.column("words").to_pylist())


def _read(batches, *columns: tuple[str, np.dtype]) -> list[np.ndarray]:
    got = [[] for _ in columns]
    for batch in batches:
        for g, (name, kind) in zip(got, columns, strict=True):
            g += [unpacked(x, kind) for x in batch.column(name).to_pylist()]
    return [np.concatenate(g) if g else np.empty(0, kind) for g, (_, kind) in zip(got, columns, strict=True)]


def _entries(hot, parts: int):
    """Of the lines of a part, the prefix entries of each class's first, dealt by word; those of hot words are spread."""

    def run(batches):
        rec, head, words = _read(batches, ("lines", LINE), ("heads", HEAD), ("words", np.dtype("<u8")))
        if not len(rec):
            return
        starts = np.cumsum(head["k"]) - head["k"]
        order, new = _firsts(rec)
        first = order[new]
        for at in np.array_split(first, 1 + len(first) // FLUSH):
            k = head["k"][at]
            e = np.empty(int(k.sum()), ENTRY)
            e["word"] = words[_spans(starts[at], k)]
            for name in ("id", "line", "n"):
                e[name] = np.repeat(rec[name][at], k)
            for name in ("b1", "b2"):
                e[name] = np.repeat(head[name][at], k)
            e["pos"] = _spans(head["skip"][at], k)
            spread = hot.value[(e["word"] >> U64(64 - COUNT_BITS)).astype(np.int64)]
            rows = []
            for crowd in (False, True):
                here = e[spread == crowd]
                # the members of a hot word are only passed on, so any part will do
                for part, x in _deal(here["id"].astype(U64) if crowd else here["word"], parts):
                    rows.append((part, crowd, packed(here[x])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["part", "crowd", "data"])

    return run


MEETING = "crowd boolean, word long, id long, line int, x_id long, x_line int"


def _meetings(percent: int):
    """Of the entries of whole words: pairs, the later class first, and the members of crowds that have a partner."""

    def pack(crowd: bool, word, a, b=None):
        n = len(word)
        x_id, x_line = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())) if b is None else (pa.array(b["id"]), pa.array(b["line"]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, crowd)), pa.array((word ^ SIGN).view(np.int64)), pa.array(a["id"]), pa.array(a["line"]), x_id, x_line], names=["crowd", "word", "id", "line", "x_id", "x_line"])

    def run(batches):
        held = []
        for batch in batches:
            for crowd, raw in zip(batch.column("crowd").to_pylist(), batch.column("data").to_pylist(), strict=True):
                e = unpacked(raw, ENTRY)
                if crowd:
                    yield pack(True, e["word"], e)
                else:
                    held.append(e)
        if not held:
            return
        e = np.concatenate(held)
        held.clear()
        order = np.argsort(e["word"], kind="stable")
        word = e["word"][order]
        same = word[1:] == word[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        e = e[order[several]]
        if not len(e):
            return
        e = e[np.lexsort((e["n"], e["word"]))]
        word, n, pos, b1, b2, ids, line = (np.ascontiguousarray(e[c]) for c in ("word", "n", "pos", "b1", "b2", "id", "line"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(begins, len(word)))
        large = np.repeat(size > CROWD, size)
        active = np.zeros(len(word), bool)
        at, d = np.arange(len(word)), 0
        while len(at):
            d += 1
            at = at[at + d < len(word)]
            # ordered by size, so a class that is too large here has only larger ones behind it
            at = at[(word[at] == word[at + d]) & (100 * n[at] >= percent * n[at + d])]
            to = at + d
            both = n[at] + n[to]
            fits = np.minimum(n[at] - pos[at], n[to] - pos[to]) * (100 + percent) >= percent * both
            apart = np.bitwise_count(b1[at] ^ b1[to]).astype(np.int64) + np.bitwise_count(b2[at] ^ b2[to])
            fits &= (both - apart) * (100 + percent) >= 2 * percent * both
            x, y = at[fits], to[fits]
            crowd = large[x]
            active[x[crowd]] = active[y[crowd]] = True
            x, y = x[~crowd], y[~crowd]
            if len(x):
                later = (ids[x] > ids[y]) | ((ids[x] == ids[y]) & (line[x] > line[y]))
                yield pack(False, word[x], e[np.where(later, x, y)], e[np.where(later, y, x)])
        if active.any():
            yield pack(True, word[active], e[active])

    return run


def _wanted_sets(ranks):
    """id, line, words (ranked, packed) of the wanted lines of each text."""

    def run(batches):
        order, _ = ranks.value
        for batch in batches:
            ids, lines, texts = [], [], []
            for d, wanted, t in zip(batch.column("id").to_pylist(), batch.column("wanted").to_pylist(), utf8(batch.column("text"), lower=True), strict=True):
                parts = t.split(b"\n")
                wanted = [w for w in wanted if w < len(parts)]
                ids += [d] * len(wanted)
                lines += wanted
                texts += [parts[w] for w in wanted]
            for a, text, _, begin, r in _sets(texts, order):
                ends = np.append(begin[1:], len(r))
                got = [r[x:y].tobytes() for x, y in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in text.tolist()], pa.int64()), pa.array([lines[a + i] for i in text.tolist()], pa.int32()), pa.array(got, pa.binary())], names=["id", "line", "words"])

    return run


def _verify(percent: int):
    """Pairs whose sets are similar and whose prefixes share no word before the one at which they met."""

    def run(batches):
        for batch in batches:
            keep = []
            for word, a, b in zip(batch.column("word").to_pylist(), batch.column("words").to_pylist(), batch.column("x_words").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = np.intersect1d(x, y, assume_unique=True)
                keep.append(len(both) > 0 and 100 * len(both) >= percent * (len(x) + len(y) - len(both)) and int(both[0]) ^ 1 << 63 == word % (1 << 64))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("id", "line", "x_id", "x_line")], names=["id", "line", "x_id", "x_line"])

    return run


def _matrix(members: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(members), len(columns)), np.float32)
    row = np.repeat(np.arange(len(members)), [len(m) for m in members])
    flat = np.concatenate(members)
    at = np.searchsorted(columns, flat)
    hit = np.flatnonzero((at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == flat))
    out[row[hit], at[hit]] = 1
    return out


def block_matches(word: int, left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets left and right are similar and have ``word`` as the first that they share."""
    if not left or not right:
        return np.zeros((len(left), len(right)), bool)
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.int64)
    early = np.zeros(both.shape, bool)
    for i in range(0, len(common), COLUMNS):
        part = common[i : i + COLUMNS]
        a, b = _matrix(left, part), _matrix(right, part)
        both += (a @ b.T).astype(np.int64)
        k = int(np.searchsorted(part, U64(word)))
        if k:
            early |= (a[:, :k] @ b[:, :k].T) > 0
    return ~early & (100 * both >= percent * (n[:, None] + m[None, :] - both))


def _blocks(percent: int):
    """Of rows sorted by (word, bi, bj): for each class its links and its first match there. Rows of one block have side 0 or 1."""

    def meet(stored: int, bi: int, bj: int, rows: list[tuple]):
        word = (stored ^ -1 << 63) % (1 << 64)
        a = [r for r in rows if r[0] == 0]
        b = a if bi == bj else [r for r in rows if r[0] == 1]
        left = [np.frombuffer(r[3], "<u8") for r in a]
        right = left if b is a else [np.frombuffer(r[3], "<u8") for r in b]
        hit = block_matches(word, left, right, percent)
        if b is a:
            np.fill_diagonal(hit, False)
        for one, other, h in ((a, b, hit), (b, a, hit.T)):
            for i in np.flatnonzero(h.any(axis=1)):
                places = [other[j][1:3] for j in np.flatnonzero(h[i])]
                first = min(places)
                yield one[i][1], one[i][2], len(places), *(first if first < one[i][1:3] else (None, None))
            if b is a:
                break

    def run(batches):
        key, rows, out = None, [], []

        def batch_of():
            cols = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["id", "line", "c", "x_id", "x_line"])

        for batch in batches:
            for *k, side, d, line, words in zip(*(batch.column(c).to_pylist() for c in ("word", "bi", "bj", "side", "id", "line", "words")), strict=True):
                if k != key:
                    if rows:
                        out += meet(*key, rows)
                    key, rows = k, []
                rows.append((side, d, line, words))
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if rows:
            out += meet(*key, rows)
        yield batch_of()

    return run


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its rows were counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ranks(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """The place of each slot of the count table from rare to frequent, how many slots count at most one word, and the words."""
    counts = _table(docs.select("text"), _count)
    place = np.empty(len(counts), np.int32)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return place, int((counts <= 1).sum()), int(counts.sum())


def _all_lines(batches):
    rec = _read(batches, ("lines", LINE))[0]
    if not len(rec):
        return
    order, new = _firsts(rec)
    o = rec[order]
    first = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for i in range(0, len(o), FLUSH):
        a, b = o[i : i + FLUSH], first[i : i + FLUSH]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a["id"], a["line"], a["s1"].view(np.int64), b["id"], b["line"])], names=["id", "line", "s1", "first_id", "first_line"])


def matches(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (id, line, s1, first_id, first_line); for classes with links (first_id, first_line) their number c and first earlier match, if any; the stored scan that the lines are read from.

    docs has id (long, not null) and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, once, words = _ranks(docs)
    ranks = spark.sparkContext.broadcast((place, once))  # 4 MB, whatever the input
    parts = max(least, math.ceil(words / PART_WORDS))
    scan = cut(docs.mapInArrow(_lines(ranks, percent, 4 * parts), "part int, lines binary, heads binary, words binary"), "line-scan")
    counts = _table(scan.select("words"), _prefix_counts)
    entries, hot = int(counts.sum()), spark.sparkContext.broadcast(counts > HOT)
    dealt = max(least, math.ceil(entries / PART_ENTRIES))
    first = scan.repartition(parts, "part").mapInArrow(_entries(hot, 4 * dealt), "part int, crowd boolean, data binary")
    met = cut(first.repartition(dealt, "part").mapInArrow(_meetings(percent), MEETING), "line-meetings")

    pairs = met.filter("not crowd").groupBy("id", "line", "x_id", "x_line").agg(F.min("word").alias("word"))
    crowds = met.filter("crowd").select("word", "id", "line")
    places = met.select("id", "line").union(met.filter("not crowd").select("x_id", "x_line")).distinct()
    wanted = cut(places.groupBy("id").agg(F.collect_list("line").alias("wanted")), "line-wanted")
    sets = cut(docs.join(_small(wanted), "id").select("id", "wanted", "text").mapInArrow(_wanted_sets(ranks), "id long, line int, words binary").dropDuplicates(["id", "line"]), "line-wanted-sets")

    x_sets = sets.select(F.col("id").alias("x_id"), F.col("line").alias("x_line"), F.col("words").alias("x_words"))
    links = pairs.join(sets, ["id", "line"]).join(x_sets, ["x_id", "x_line"]).select("word", "id", "line", "x_id", "x_line", "words", "x_words")
    links = cut(links.mapInArrow(_verify(percent), "id long, line int, x_id long, x_line int"), "line-links")
    later = links.select("id", "line", F.lit(1).cast("long").alias("c"), "x_id", "x_line")
    earlier = links.select(F.col("x_id").alias("id"), F.col("x_line").alias("line"), F.lit(1).cast("long").alias("c"), F.lit(None).cast("long").alias("x_id"), F.lit(None).cast("int").alias("x_line"))

    blocks = crowds.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b"))
    member = crowds.join(blocks, "word").withColumn("i", F.pmod(F.xxhash64("id", "line"), "b").cast("int"))
    cells = member.select("word", "id", "line", "i", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
    cells = cells.select("word", "id", "line", F.least("i", "j").alias("bi"), F.greatest("i", "j").alias("bj"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    cells = cells.join(sets, ["id", "line"]).repartition(dealt, "word", "bi", "bj").sortWithinPartitions("word", "bi", "bj")
    crowded = cut(cells.select("word", "bi", "bj", "side", "id", "line", "words").mapInArrow(_blocks(percent), "id long, line int, c long, x_id long, x_line int"), "line-crowds")

    found = later.union(earlier).union(crowded).groupBy(F.col("id").alias("first_id"), F.col("line").alias("first_line"))
    found = cut(found.agg(F.sum("c").alias("c"), F.min(F.when(F.col("x_id").isNotNull(), F.struct("x_id", "x_line"))).alias("match")), "line-found")
    discard(met, wanted, sets, links, crowded)
    lines = scan.select("part", "lines").repartition(parts, "part").mapInArrow(_all_lines, "id long, line int, s1 long, first_id long, first_line int")
    return lines, found, scan


def removals(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_lines (lines with words), n_links, n_matches, class_id and the removed line numbers of each document with words.

    n_links counts the document's lines that go because they match an earlier line, n_matches the links of its
    lines to other line classes, earlier and later; class_id is the least doc_id of a document with the
    same sequence of line classes.
    """
    d = pick(docs, id=doc_id, text=text).withColumn("id", F.col("id").try_cast("long")).filter("id is not null and text is not null")
    lines, found, scan = matches(d, percent)
    x = lines.join(_small(found), ["first_id", "first_line"], "left")
    gone = (F.col("first_id") != F.col("id")) | (F.col("first_line") != F.col("line")) | F.col("match").isNotNull()
    rows = x.groupBy("id").agg(F.collect_set(F.struct("line", "s1", gone.alias("gone"), F.coalesce("c", F.lit(0)).alias("c"))).alias("r"))
    removed = F.array_sort(F.array_distinct(F.transform(F.filter("r", lambda e: e["gone"]), lambda e: e["line"])))
    per = rows.select(
        "id", F.size(F.array_distinct(F.col("r.line"))).cast("long").alias("n_lines"), removed.alias("removed"), F.size(removed).cast("long").alias("n_links"),
        F.aggregate("r", F.lit(0).cast("long"), lambda n, e: n + e["c"]).alias("n_matches"), F.xxhash64(F.array_sort(F.transform("r", lambda e: F.struct(e["line"], e["s1"])))).alias("seq"),
    )
    per = cut(per, "line-documents")
    discard(scan, found)
    ids = per.groupBy("seq").agg(F.min("id").alias("class_id"))
    return per.join(ids, "seq").drop("seq")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for t, r in zip(text, removed, strict=True):
        gone = set() if r is None else set(r.tolist())
        out.append(t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def line_report(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_lines, n_links, n_kept, n_matches, removed_lines."""
    r = removals(docs, percent, doc_id, text)
    d = docs.select(F.col(f"`{doc_id}`").try_cast("long").alias("doc_id"))
    x = d.join(r, d["doc_id"] == r["id"], "left")
    return x.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("n_lines", F.lit(0)) - F.coalesce("n_links", F.lit(0))).alias("n_kept"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))


def drop_later_lines(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed lines taken out of the text; documents left without a line with words go.

    Documents that had no such line at the start stay as they are. n_chars, if there, is counted anew.
    """
    key, gone, stays = unused(docs, "id", "removed", "stays")
    r = removals(docs, percent, doc_id, text).filter("n_links > 0").select(F.col("id").alias(key), F.col("removed").alias(gone), (F.col("n_links") < F.col("n_lines")).alias(stays))
    x = docs.join(r, F.col(f"`{doc_id}`").try_cast("long") == F.col(key), "left")
    x = x.filter(F.col(key).isNull() | F.col(stays)).withColumn(text, F.when(F.col(key).isNull(), F.col(text)).otherwise(_without(F.col(text), F.col(gone))))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(F.col(key).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(dict(docs.dtypes)["n_chars"])))
    return x.select(*docs.columns)
