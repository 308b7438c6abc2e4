"""SentencePiece encoding and decoding by a streaming Viterbi search over the model's pieces.

The search walks the text once. For each position it keeps one backpointer: the last piece of the best
encoding of the text up to there. Only positions from which some piece may still reach ahead survive,
so the window is bounded by the longest piece; as soon as the paths of all survivors meet in one
boundary, everything before it is final and is handed out.

The model is a merge (BPE) model, whose best path is not the one with the highest sum of scores but
the one that merging in score order gives. That path has the same optimal substructure: a piece may
follow another exactly if the two, merged on their own, stay as they are, and for each prefix exactly
one last piece qualifies. So the search yields the library's ids, without its quadratic merge queue
over long texts. ``kind="unigram"`` keeps the highest sum of scores instead.

Null and empty texts give no ids. U+2581 in a text is read as a space, as the library does, and is the
one case where decoding does not give the text back (``round_trip`` is then false). Rows are handled
one by one: repeated rows repeat, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, pick, small_batches, uncollected, utf8, worker_model

SPACE = "▁"
#: Entries that a task remembers: words, parts of words, pairs of pieces.
WORD_CACHE, PART_CACHE, PAIR_CACHE, BEGUN_CACHE = 300_000, 200_000, 600_000, 20_000
#: Lengths after which the state of a search is kept for parts that begin alike.
STARTS = (6,)


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        self.kind = {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type]
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in m.pieces]
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.id = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.control = {i for i, p in enumerate(m.pieces) if p.type in (2, 3)}
        self.longest = max(map(len, self.score))
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        #: Numbers of pieces; characters that are no piece get numbers as they come.
        self.number = dict(self.id)
        self.text_of = {i: p for p, i in self.id.items()}
        #: character -> (the nodes that follow, or None; the piece's number, or -1)
        self.trie: dict = {}
        for p, i in self.id.items():
            here = self.trie
            for c in p[:-1]:
                node = here.get(c)
                if node is None or node[0] is None:
                    node = here[c] = ({}, -1 if node is None else node[1])
                here = node[0]
            node = here.get(p[-1])
            here[p[-1]] = (None if node is None else node[0], i)
        self.known: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging in score order, the leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging piece a and piece b leaves exactly the two; for START, whether b is ever made at all."""
        if len(self.known) >= PAIR_CACHE:
            self.known.clear()
        left, right = self.text_of.get(a, ""), self.text_of[b]
        made = self.merge(right) == [right]
        out = self.known[a << 32 | b] = made and (not left or self.merge(left + right) == [left, right])
        return out

    def no_piece(self, c: str) -> int:
        """The number of a character that is no piece."""
        i = self.number.get(c)
        if i is None:
            i = self.number[c] = len(self.pieces) + 1 + len(self.number)
            self.text_of[i] = c
        return i

    def ids_of(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        if self.byte:
            return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]


class Stream:
    """Feeds characters, hands out pieces as soon as they are final."""

    def __init__(self, model: Model, kind: str | None = None):
        self.m, self.kind = model, kind or model.kind
        self.start = len(model.pieces)  # stands before the first piece
        self.last: list[int] = [self.start]  # the last piece of the best path to each position of the window
        self.size: list[int] = [0]  # its length
        self.total = [0.0]
        self.buffer = ""  # characters from the last committed boundary on
        self.alive: list[tuple[int, dict]] = []  # where pieces that may reach ahead begin, ascending, with their nodes

    def feed(self, text: str) -> list[str]:
        return [self.m.text_of[i] for i in self.advance(text)]

    def close(self) -> list[str]:
        return [self.m.text_of[i] for i in self.finish()]

    def advance(self, text: str) -> list[int]:
        """Extends the best paths by each character: the longest piece that may follow, or the highest sum.

        The numbers of the pieces that became final.
        """
        m, out, merging, window = self.m, [], self.kind == "bpe", 4 * self.m.longest
        trie, known, last, size, total, alive = m.trie, m.known, self.last, self.size, self.total, self.alive
        end = len(last) - 1
        for c in text:
            found, length, best, ahead = -1, 1, 0.0, []
            alive.append((end, trie))
            end += 1
            for begin, nodes in alive:
                node = nodes.get(c)
                if node is None:
                    continue
                more, piece = node
                if more is not None:
                    ahead.append((begin, more))
                if piece < 0:
                    continue
                if merging:
                    if found < 0:
                        ok = known.get(last[begin] << 32 | piece)
                        if m.follows(last[begin], piece) if ok is None else ok:
                            found, length = piece, end - begin
                else:
                    sum_here = total[begin] + m.score[m.pieces[piece]]
                    if found < 0 or sum_here > best:
                        found, length, best = piece, end - begin, sum_here
            if not merging and c not in trie:
                sum_here = total[end - 1] - 1e6
                if found < 0 or sum_here > best:
                    found, length, best = m.no_piece(c), 1, sum_here
            elif found < 0:
                found = m.no_piece(c)
            last.append(found)
            size.append(length)
            total.append(best)
            alive = ahead
            if not ahead:
                out += self._commit(end)
                end = 0
            elif end >= window:
                paths = [self._path(b) for b in (*(b for b, _ in ahead), end)]
                boundary = max(set(paths[0]).intersection(*paths[1:]))
                out += self._commit(boundary)
                alive = [(b - boundary, nodes) for b, nodes in ahead]
                end -= boundary
        self.alive = alive
        self.buffer = (self.buffer + text)[-end:] if end else ""
        return out

    def _path(self, end: int) -> list[int]:
        out = [end]
        while end:
            end -= self.size[end]
            out.append(end)
        return out

    def _commit(self, boundary: int) -> list[int]:
        """The pieces up to a boundary that all surviving paths share; the window then begins there."""
        last, size, at, out = self.last, self.size, boundary, []
        while at:
            out.append(last[at])
            at -= size[at]
        # with nothing behind the boundary no piece crosses it, so nothing after it depends on what was before
        whole = boundary == len(last) - 1 and self.kind == "bpe"
        del last[:boundary], size[:boundary], self.total[:boundary]
        if whole:
            last[0] = self.start
        return out[::-1]

    def state(self) -> tuple:
        return self.last[:], self.size[:], self.total[:], self.alive[:], self.buffer

    def resume(self, state: tuple) -> None:
        """Goes on from a state of this stream."""
        last, size, total, alive, self.buffer = state
        self.last, self.size, self.total, self.alive = last[:], size[:], total[:], alive[:]

    def finish(self) -> list[int]:
        out = self._commit(len(self.last) - 1)
        self.last[0], self.alive, self.buffer = self.start, [], ""
        return out


class Encoder:
    """Whole texts to ids. No piece has a space after its start, so ids of recent words are remembered."""

    def __init__(self, path: str, kind: str | None = None):
        self.m = Model(path)
        self.kind = kind or self.m.kind
        self.stream = Stream(self.m, self.kind)
        self.begun: dict[str, tuple] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.known = Recent(self._run, WORD_CACHE)
        self.parts = Recent(self._part, PART_CACHE, 32)
        if any(SPACE in p.lstrip(SPACE) for p in self.m.score):
            raise ValueError("pieces that hold a space after their start are not supported")

    def _part(self, part: str) -> bytes:
        """The search over a part of a text; what it found after the first few characters is taken up again."""
        m, stream, out, at = self.m, self.stream, [], 0
        for n in STARTS:
            if n >= len(part):
                break
            if (state := self.begun.get(part[:n])) is None:
                out += stream.advance(part[at:n])
                if len(self.begun) >= BEGUN_CACHE:
                    self.begun.clear()
                self.begun[part[:n]] = out[:], stream.state()
            else:
                out = state[0][:]
                stream.resume(state[1])
            at = n
        ids = []
        for i in out + stream.advance(part[at:]) + stream.finish():
            if i < len(m.pieces):
                ids.append(i)
            else:
                ids += m.ids_of(m.text_of[i])
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A run of spaces with what follows, cut where no piece of the model can cross."""
        text, pairs, out, begin = word.replace(" ", SPACE), self.m.pairs, [], 0
        if all(map(pairs.__contains__, map(add, text, text[1:]))):
            return self.parts[text]
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(self.parts[text[begin:i]])
                begin = i
        out.append(self.parts[text[begin:]])
        return b"".join(out)

    def _run(self, word: str) -> bytes:
        """A word of ``words``; one without its single space, if the model puts a space before every text."""
        return self._word(" " + word if self.m.prefix and word[0] != " " else word)

    def words(self, text: str) -> list[str]:
        """Runs of spaces, each with the characters up to the next run; single spaces are left out if the model puts a space before every text."""
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        if self.m.prefix and "" not in words:
            return words
        out, gap = [], 1 if self.m.prefix else 0
        for i, w in enumerate(words):
            gap += i > 0
            if w:
                out.append(" " * gap + w)
                gap = 0
        return out + [" " * gap] if gap else out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(text))), "<u4")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, put together, with the space before the text; control pieces are nothing."""
        if self.table is None:
            m = self.m
            of = [m.byte_of.get(i) for i in range(len(m.pieces))]
            raw = [bytes([b]) if b is not None else b"" if i in m.control else m.pieces[i].replace(SPACE, " ").encode() for i, b in enumerate(of)]
            size = np.array([len(x) for x in raw])
            self.table = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size
        data, start, size = self.table
        n = size[ids]
        ends = np.cumsum(n)
        return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - ends + n, n)].tobytes()

    def decode(self, ids) -> str:
        m, out, raw = self.m, [], bytearray()
        for i in ids:
            b = m.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in m.control:
                out.append(m.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if m.prefix and text[:1] == " " else text


@worker_model
def encoder(path: str, kind: str | None) -> Encoder:
    """A Python worker's own encoder: its remembered words serve all its tasks."""
    return Encoder(path, kind)


def _encode(path: str, kind: str | None):
    def run(batches):
        enc = encoder(path, kind)
        skip = 1 if enc.m.prefix else 0
        for batch in batches:
            values, n, same = [], [], []
            for raw in utf8(batch.column("text")):
                ids = enc.encode(raw.decode("utf-8", "replace"))
                values.append(ids)
                n.append(len(ids))
                same.append(enc.bytes_of(ids)[skip:] == raw)
            flat = np.concatenate(values) if values else np.empty(0, "<u4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    return uncollected(run)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids and round_trip (the ids decode to the text) of each row."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=doc_id, text=text)
    return d.mapInArrow(_encode(model, kind), f"doc_id {dict(d.dtypes)['doc_id']}, n_ids long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give null."""

    def run(batches):
        enc = Encoder(model)
        for batch in batches:
            out = [None if x is None else enc.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    d = pick(rows, doc_id=doc_id, ids=ids)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, text string")
