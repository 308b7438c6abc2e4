"""Each training-data operator against a brute-force version, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, line_dedup, lm_score, mixing, near_dedup, order_minhash, quality, sentencepiece_stream, token_store, warc
from quillspark.llm.common import hashed_docs
from quillspark.llm.components import components
from quillspark.llm.queries import QUERIES, subwords, tokenizer

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, h1 string, topic string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again\nand a second line of some words here", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again\nand a second line of some words here", "en", "a"),
    (3, "The quick brown fox jumps over the lazy dog again and AGAIN\nand a second line of some words there", "en", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t\n ", "en", "b"),
    (7, "one", "fr", "b"),
    (8, "one", "fr", "b"),
    (8, "one", "fr", "b"),
    (9, LONG, "en", "b"),
    (10, LONG + " tail", "en", "b"),
    (11, "é日本 x▁y  double  space <s> \x00 😀", "fr", "c"),
    (12, "and a second line of some words here\nunlike the others entirely", "en", "c"),
    (None, "the quick brown fox", "en", "c"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def words(text):
    return WORDS.findall((text or "").encode())


def linked(a, b, percent=80):
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# line dedup


def brute_lines(rows, percent=80):
    seen, out = [], defaultdict(list)
    for doc, line, s in sorted({(d, i, frozenset(w.lower() for w in WORDS.findall(x.encode()))) for d, t in rows if d is not None and t for i, x in enumerate(t.split("\n"))}, key=lambda x: x[:2]):
        if s:
            if any(linked(s, o, percent) for o in seen):
                out[doc].append(line)
            seen.append(s)
    return out


@pytest.mark.parametrize("which", ["docs", "real"])
def test_line_dedup(which, request):
    d = request.getfixturevalue(which)
    want = brute_lines([(r["doc_id"], r["text"]) for r in d.collect()])
    rows = line_dedup.line_report(d).collect()
    assert len(rows) == d.count()
    assert {r["doc_id"]: sorted(r["removed_lines"]) for r in rows if r["removed_lines"]} == want
    assert all(r["n_kept"] + r["n_links"] == r["n_lines"] for r in rows)


def test_line_dedup_texts(spark, docs):
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_later_lines(docs).collect()}
    assert out[1] == ROWS[0][1] and 2 not in out and out[3] == "and a second line of some words there"
    assert out[12] == "unlike the others entirely" and out[4] is None and out[5] == "" and out[6] == ROWS[5][1]
    assert line_dedup.drop_later_lines(docs).columns == docs.columns
    assert line_dedup.line_report(frame(spark, [])).count() == 0


def test_line_dedup_large_group_of_near_copies(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(30)) + f" own{i}", "en", "a") for i in range(300)]
    out = line_dedup.line_report(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out if r["n_kept"]) == [0]


def test_line_dedup_counts_all_links(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(30)) + f" own{i}\nnothing like it {i} at all{i}", "en", "a") for i in range(12)]
    rows += [(50, rows[3][1], "en", "a"), (51, "quite another line", "en", "a"), (52, "", "en", "a")]
    out = {r["doc_id"]: r for r in line_dedup.line_report(frame(spark, rows)).collect()}
    assert all(out[i]["n_matches"] == 11 for i in [*range(12), 50]) and out[51]["n_matches"] == out[52]["n_matches"] == 0


def test_line_dedup_links_match_brute_force(spark, docs):
    sets = {r["doc_id"]: [frozenset(x.lower() for x in words(t)) for t in (r["text"] or "").split("\n")] for r in docs.collect() if r["doc_id"] is not None}
    classes = {s for x in sets.values() for s in x if s}
    degree = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in classes) for a in classes}
    for r in line_dedup.line_report(docs).collect():
        assert r["n_matches"] == sum(degree[s] for s in sets.get(r["doc_id"], []) if s)


# LM scoring


def test_lm_scoring(spark, real):
    extra = [(100_000 + i, t, "en", "a", 0) for i, t in enumerate([None, "", "  ", "zzqx yyqx"])] + [(None, "the", "en", "a", 0)]
    d = real.unionByName(spark.createDataFrame(extra, real.schema)).withColumn("h", F.lit("clash"))
    rows = d.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 if r["doc_id"] is not None else True for r in rows}
    tokens = {r["doc_id"]: [w.lower() for w in words(r["text"])] + [None] for r in rows}
    c = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    out = lm_score.score(d, subwords("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == len(rows)
    for r in out:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert r["score"] < 0
    assert lm_score.score(real.limit(0), subwords("byte_bpe_50k.tiktoken")).count() == 0


def test_lm_ids_of_words():
    ids = lm_score.Ids(subwords("byte_bpe_50k.tiktoken"))
    said = [w.encode() for w in ("the", "don't", "x\u00a0", "\u00a0", "\u00a0y", "'s", "a1b", "caf\u00e9", "\U0001f600", "z" * 1000, "the")] + [b"\xff\xfe"]
    one = [ids.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in said]
    one[9] = [x for t in (" " + "z" * 255, "z" * 256, "z" * 256, "z" * 233) for x in ids.encoding.encode_ordinary(t)]
    assert ids.of(said).tolist() == [x for part in one for x in part] + [ids.end]
    assert ids.of([]).tolist() == [ids.end] and ids.of([], False).tolist() == []


def test_lm_gathers_every_word():
    import pyarrow as pa

    vocabulary = subwords("byte_bpe_50k.tiktoken")
    texts = ["one", "", "two three", LONG] + [f"short text {i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])
    rows = [r for out in lm_score._gather(vocabulary)([batch]) for r in out.to_pylist() if r["ids"] is not None]
    ids = lm_score.Ids(vocabulary)
    assert {r["key"]: r["ids"] for r in rows} == {i: ids.of([w.encode() for w in t.split()]).tobytes() for i, t in enumerate(texts)}


@pytest.mark.parametrize("key", [0, 8])
def test_lm_trains_on_all_parts(spark, key):
    from quillspark.llm import lm_model as net

    ids = np.arange(200, dtype="<u2") % 7
    leaf = np.arange(1 << 16, dtype=np.int32) % (net.LEAVES + 1)
    prior = net.prior(np.ones((net.LEAVES + 2, net.LEAVES + 1)))
    texts = spark.createDataFrame([(key, ids.tobytes())], "key long, ids binary")
    assert not np.array_equal(lm_score.train(texts, leaf, prior, len(ids)), net.start())


def test_lm_probabilities_add_up_and_gradient():
    from quillspark.llm import lm_model as net

    rng = np.random.default_rng(0)
    prior = net.prior(rng.integers(0, 3, (net.LEAVES + 2, net.LEAVES + 1)).astype(float))
    flat = net.start() + rng.normal(0, 0.1, net.SIZE).astype(np.float32)
    x = rng.integers(0, net.LEAVES, (1, net.SPAN))
    h, _ = net.hidden(net.views(flat), x)
    every = np.arange(net.LEAVES + 1)
    p = np.exp(net.log_probs(net.views(flat), prior, np.repeat(h[5:6], len(every), axis=0), np.repeat(x[0, 5:6], len(every)), every))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    y, w = rng.integers(0, net.LEAVES, (1, net.SPAN)), np.ones((1, net.SPAN), bool)
    _, g = net.loss_and_gradient(flat, prior, x, y, w)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 12, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (net.loss_and_gradient(up, prior, x, y, w)[0] - net.loss_and_gradient(down, prior, x, y, w)[0]) / 2e-2
        assert g[i] == pytest.approx(slope, rel=0.1, abs=2e-3)


def test_lm_causal_and_windows_count_once():
    from quillspark.llm import lm_model as net

    p = net.views(net.start())
    x = np.random.default_rng(0).integers(0, net.LEAVES, (1, net.SPAN))
    a = net.hidden(p, x)[0]
    x2 = x.copy()
    x2[0, 10:] = 3
    assert np.allclose(a[:10], net.hidden(p, x2)[0][:10], atol=1e-5)
    for n in (1, 5, net.SPAN - 1, net.SPAN, net.SPAN + 1, 500):
        leaves = np.arange(n) % net.LEAVES
        _, y, m = net.windows(leaves)
        assert np.array_equal(y[m], leaves)


# chat formatting

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a # b \\ </turn>\n### user: x"), (1, 2, "user", None), (1, 3, "assistant", "é日😀"),
    (2, 0, "assistant", ""), (3, 0, "us: er#\\</turn>", "x</turn>y\\"), (4, None, None, "null turn"), (4, 1, "user", "t"), (4, 1, "user", "t"), (None, 0, "assistant", "lost"),
]


def test_chat_formatting(spark):
    c = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, i string")
    f = chat.format_conversations(c)
    for r in f.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), "examples").collect():
        mine = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["t"]] == [m[1:] for m in mine]
        replies = [re.sub(r"(?s)\\(.)", r"\1", r["formatted"][e["reply_start"] : e["reply_end"]]) for e in r["examples"]]
        assert replies == [m[2] for m in mine if m[1] == "assistant"]
        assert all(e["reply"] == r["formatted"][e["reply_start"] : e["reply_end"]] for e in r["examples"])
    for e in chat.with_context(f).filter("conv_id = 1").collect():
        assert e["context"].startswith("### user: hi</turn>\n") and e["context"].endswith("### assistant: ")
    assert chat.format_conversations(c.limit(0)).count() == 0


def test_chat_examples_are_prefix_and_target(spark):
    f = chat.format_conversations(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    whole = {r["conv_id"]: r["formatted"] for r in f.collect()}
    got = chat.examples(f).collect()
    assert len(got) == sum(t[2] == "assistant" for t in TURNS)
    for e in got:
        assert whole[e["conv_id"]].startswith(e["context"] + e["target"] + "</turn>\n") and e["context"].endswith("### assistant: ")
        assert (len(e["context"]), len(e["context"] + e["target"])) == (e["reply_start"], e["reply_end"])
    said = {(r["conv_id"], r["i"]): r["text"] for r in chat.trained_text(chat.examples(f)).collect()}
    assert said == {(1, 2): TURNS[1][3], (1, 4): "é日😀", (2, 1): "", (None, 1): "lost"}
    moved = chat.examples(f).withColumn("reply_start", F.col("reply_start") - 2)  # a wrong mask must be seen
    assert {r["text"] for r in chat.trained_text(moved).filter("conv_id is null").collect()} == {": lost"}


# token store


@pytest.mark.parametrize("which", ["docs", "real"])
def test_token_store(spark, which, request):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    d = request.getfixturevalue(which)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in d.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array(x.ids + [0], "<u4") for x in t.encode_batch([r[1] for r in rows], add_special_tokens=False)]
    start = np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1])).tolist()
    want = [(r[0], s, len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(rows, start, ids, strict=True)]
    store = token_store.write_store(d, path)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, token_store.read_digests(spark, store).collect()), key=key) == want
    whole = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u2").tolist() for r in token_store.documents(spark, store).collect()}
    assert whole == {(w[0], w[1]): x.tolist() for w, x in zip(want, ids, strict=True)}
    chunks = token_store.chunks(spark, store)
    assert chunks.count() == chunks.select("key").distinct().count()


def test_token_store_empty_and_crc(spark):
    store = token_store.write_store(frame(spark, []), tokenizer("byte_bpe_50k.json"))
    assert token_store.read_digests(spark, store).count() == 0
    a, b = b"some bytes", bytes(range(200)) * 7
    assert token_store.crc_concat(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_store_cuts():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    cuts = token_store.chunk_cuts(ids)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(ids) and sizes.max() <= token_store.MAX_IDS and sizes[:-1].min() >= token_store.MIN_IDS
    other = token_store.chunk_cuts(np.concatenate([ids[:9000], rng.integers(0, 50_000, 3).astype("<u2"), ids[9000:]]))
    ends = {c + 3 for c in cuts if c > 9000 + 2 * token_store.MAX_IDS}
    assert len(ends & set(other)) > 0.9 * len(ends)
    assert token_store.chunk_cuts(np.zeros(10_000, "<u2"))[-1] == 10_000


def test_token_store_notices_damage(spark, docs):
    import glob
    import os

    store = token_store.write_store(docs, tokenizer("byte_bpe_50k.json"))
    for f in glob.glob(store.path.removeprefix("file://") + "/raw/kind=chunks/*.parquet"):
        if spark.read.parquet(f"file://{f}").count():
            bad = spark.read.parquet(f"file://{f}").withColumn("data", F.concat("data", F.lit(b"\0\0"))).select("key", "doc_id", "n", "data").collect()
            os.remove(f)
            spark.createDataFrame(bad, "key binary, doc_id long, n long, data binary").coalesce(1).write.mode("append").parquet(store.path + "/raw/kind=chunks")
            break
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.read_digests(spark, store).collect()


# WARC


def test_warc(spark, sf_dir):
    long = "x" * 150
    rows = [(1, "http://a/ b\r\n", long, "c"), (3, None, long, "c"), (2, "u", long, "c"), (5, "u", None, "c"), (6, "u", "", "c"), (7, "u", "y" * 99, "c"), (8, "u", "y" * 99, "c"), (9, "u", "é" * 50, "c"), (10, "u", "é" * 50, "c"), (10, "v", "é" * 50, "c"), (None, "u", long, "c"), (11, "u", "z" * 3_000_000, "c")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder, manifest = warc.write_archives(p)
    out = warc.read_archives(spark, folder, manifest).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", first[h]) if i is not None and first.get(h, i) != i else ("response", None))) for i, _, h, _ in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == want
    assert all(r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in out)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    folder, manifest = warc.write_archives(p.limit(0))
    assert manifest.count() == 0


def test_warc_archives():
    payloads = [(f"<html>{i} some page text " + "word " * 40).encode() for i in range(300)]
    records = [warc.make_record(i, "http://x", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data = warc.make_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_frames(data)) == records
    assert warc.read_record(records[7])["page_id"] == 7
    with pytest.raises(ValueError):
        list(warc.read_frames(data[:-3]))
    broken = bytearray(data)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        list(warc.read_frames(bytes(broken)))
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"HTTP/1.1"), records[0].replace(b"WARC-Date", b"WARC-Dato"), records[0].replace(b"page text", b"page tixt", 1)):
        with pytest.raises(ValueError):
            warc.read_record(bad)


# mixing


@pytest.mark.parametrize("driver_cells", [mixing.DRIVER_CELLS, 0])
def test_mixing(real, driver_cells, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", driver_cells)
    d = real.unionByName(real.limit(5).withColumn("source", F.lit(None).cast("string"))).withColumn("weight", F.lit("clash"))
    out = mixing.probabilities(d, share=0.4).toPandas()
    assert len(out) == d.count()
    tokens = {r["doc_id"]: len(words(r["text"])) for r in real.collect()}
    assert (out["n_tokens"] == out["doc_id"].map(tokens)).all()
    assert out["probability"].mul(out["n_tokens"]).sum() == pytest.approx(0.4 * out["n_tokens"].sum(), rel=1e-3)
    total = out["n_tokens"].sum()
    out = out.fillna({"source": "none"})
    for m in mixing.MARGINS:
        now = out.groupby(m)["n_tokens"].sum() / total
        goal = now**0.5 / (now**0.5).sum()
        raked = (out["weight"] * out["n_tokens"]).groupby(out[m]).sum() / total
        assert np.allclose(raked[goal.index], goal, atol=0.02)
    s = mixing.sample(d, share=0.4)
    assert s.columns == d.columns and s.count() == out["sampled"].sum()


def test_mixing_awkward(spark, docs):
    assert mixing.probabilities(docs).count() == len(ROWS)
    assert mixing.probabilities(frame(spark, [])).count() == 0
    none = mixing.probabilities(frame(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).collect()
    assert [r["n_tokens"] for r in none] == [0, 0]


def test_topics_see_every_document(spark):
    rows = [(i, f"common words in all of these {i % 7}", "en", "a") for i in range(20_000)] + [(90_000, "zebra quagga okapi", "fr", "b")]
    d = frame(spark, rows)
    one, two = ({r["doc_id"]: r["topic"] for r in mixing.measure(x).collect()} for x in (d, d.repartition(5)))
    assert one == two and one[90_000] not in {one[i] for i in range(20_000)}


def test_scale():
    t, w = np.array([10.0, 20.0, 70.0]), np.array([4.0, 1.0, 0.5])
    for share in (0.05, 0.3, 0.9, 1.0):
        s = mixing.scale_for(t, w, share)
        assert (t * np.minimum(1, s * w)).sum() == pytest.approx(share * 100)


# SentencePiece


def test_sentencepiece_ids(spark, docs, real):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for d in (docs, real):
        rows = sentencepiece_stream.encode(d, path)
        texts = defaultdict(set)
        for r in d.collect():
            texts[r["doc_id"]].add(r["text"] or "")
        for r in rows.collect():
            (t,) = texts[r["doc_id"]]
            assert r["ids"] == sp.encode(t) and r["n_ids"] == len(r["ids"]) and r["round_trip"] == ("▁" not in t)
        back = {r["doc_id"]: r["text"] for r in sentencepiece_stream.decode(rows, path).collect()}
        assert all(back[k] == t.replace("▁", " ") for k, (t,) in texts.items())
    assert sentencepiece_stream.encode(docs.limit(0), path).count() == 0


def test_streaming_viterbi_is_the_best_sum():
    m = sentencepiece_stream.Model(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    for _ in range(150):
        text = "".join(rng.choice(list("theraniongs"), rng.integers(1, 40)))
        best = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - m.longest), j):
                if text[i:j] in m.score or j - i == 1:
                    best[j] = max(best[j], best[i] + m.score.get(text[i:j], -1e6))
        s = sentencepiece_stream.Stream(m, "unigram")
        out = s.feed(text) + s.close()
        assert "".join(out) == text and sum(m.score.get(p, -1e6) for p in out) == pytest.approx(best[-1])


def test_stream_window_is_bounded():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    m, sp = sentencepiece_stream.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    text = "▁" + "".join(rng.choice(list("theraniongs"), 20_000))
    s, out, most = sentencepiece_stream.Stream(m), [], 0
    for c in text:
        out += s.feed(c)
        most = max(most, len(s.buffer))
    out += s.close()
    assert most <= 8 * m.longest and [i for p in out for i in m.ids_of(p)] == sp.encode(text[1:])


# order MinHash


def test_order_minhash(spark, real):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in real.collect()), reverse=True)
    out = {r["doc_id"]: r for r in order_minhash.with_neighbours(real.withColumn("key", F.lit(1))).collect()}
    assert len(out) == len(rows)
    far, near = [], []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = out[d]
        f, e, a = (order_minhash.fingerprint(x) for x in (t, changed, after))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (order_minhash.written(f), order_minhash.written(e))
        assert (r["near_edited"], r["near_next"]) == (order_minhash.likeness(f, e), order_minhash.likeness(f, a))
        far.append(r["near_next"])
        near.append(r["near_edited"])
    assert np.mean(near) > np.mean(far) + 0.1


def test_order_minhash_awkward(spark, docs):
    out = order_minhash.with_neighbours(docs)
    assert out.count() == len(ROWS)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] == "" and by[5]["near_next"] == 1.0 and by[6]["near_next"] == 0.0
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[2]["near_next"] == 1.0
    assert by[10]["near_next"] > 0.8 and order_minhash.with_neighbours(frame(spark, [])).count() == 0
    one = order_minhash.with_neighbours(frame(spark, ROWS[:1])).first()
    assert one["near_next"] == 1.0


def test_order_minhash_sees_order():
    a, b = "abcdefghijklmnop" * 1 + "qrstuvwxyz0123456789", "qrstuvwxyz0123456789" + "abcdefghijklmnop"
    assert order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)) < 0.7
    h = np.array([3, 5, 3, 3, 5], np.uint64)
    assert order_minhash.number_occurrences(h).tolist() == [0, 0, 1, 2, 1]


# near-duplicates


def brute_near(rows, k):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in words(t)]
        if d is not None:
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and linked(sets[a], sets[b])]
    return {d: len(s) for d, s in sets.items()}, closure(ids, edges)


@pytest.mark.parametrize("which", ["docs", "real"])
@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(which, k, request):
    d = request.getfixturevalue(which)
    sizes, comp = brute_near([(r["doc_id"], r["text"]) for r in d.collect()], k)
    out = near_dedup.near_duplicates(d, k).collect()
    assert len(out) == d.count()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_large_groups(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = rng.integers(0, 5000, 120)
        for i in range(120):
            w = base.copy()
            w[rng.integers(0, 120, 3 * g)] = rng.integers(5000, 9000, 3 * g)
            rows.append((1000 * g + i, " ".join(f"w{x}" for x in w), "en", "a"))
    sizes, comp = brute_near([r[:2] for r in rows], 2)
    out = near_dedup.near_duplicates(frame(spark, rows), 2)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == comp
    kept = near_dedup.keep_first(frame(spark, rows), 2)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for j in (0.95, 0.8, 0.6):
        shared = int(2000 * 2 * j / (1 + j))
        a, b = x[:2000], np.concatenate([x[:shared], x[2000 : 4000 - shared]])
        s, t = (near_dedup.odd_sketch(near_dedup.minhashes(v)) for v in (a, b))
        diff = sum(int(int(p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(s, t, strict=True))
        n, k = near_dedup.BITS, near_dedup.SAMPLES
        assert 1 + n / (4 * k) * np.log(1 - 2 * diff / n) == pytest.approx(j, abs=0.12)


# quality rules


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    rep = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_quality(which, request):
    d = request.getfixturevalue(which)
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = quality.judge(d).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_quality(text[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(d.limit(0)).count() == 0


def test_quality_sketches(spark, real):
    m = quality.with_metrics(quality.measure(real))
    s = quality.sketch(m, ["lang"], ["word_length"])
    got = {r["lang"]: r for r in quality.quantiles(s, ["lang"], {"q1": 0.25, "q3": 0.75}).collect()}
    values = m.select("lang", "word_length").toPandas()
    for lang, v in values.groupby("lang")["word_length"]:
        for c, q in (("q1", 25), ("q3", 75)):
            assert got[lang][c] == pytest.approx(np.percentile(v, q, method="inverted_cdf"), rel=0.011)
    parts = quality.sketch(m, ["lang", "source"], ["word_length"])
    assert sorted(map(tuple, quality.merge(parts, ["lang"]).select("lang", "metric", F.coalesce("bucket", F.lit(-9999)), "n").collect())) == sorted(map(tuple, s.select("lang", "metric", F.coalesce("bucket", F.lit(-9999)), "n").collect()))


def test_quality_verdicts_follow_labels(spark, sf_dir, real):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = quality.judge(real).filter("n_words >= 20").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in x}
    assert share[1] > 0.95 and share[0] < 0.3


# pipeline and queries


def test_pipeline_stages(spark, sf_dir, real):
    import corpus_pipeline

    docs = real
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) <= set(before)
        if name == "quality rules":
            want = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
            assert set(got) == want
        elif name == "line dedup":
            gone = brute_lines([(k, r["text"]) for k, r in before.items()])
            for k, r in before.items():
                left = [x for i, x in enumerate(r["text"].split("\n")) if i not in gone[k]]
                assert (k in got) == any(words(x) for x in left)
                assert k not in got or got[k]["text"] == "\n".join(left)
        elif name == "MinHash near-dedup":
            _, comp = brute_near([(k, r["text"]) for k, r in before.items()], 5)
            assert set(got) == set(comp.values())
        docs, before = out, got
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(before) and all(r["round_trip"] for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ("op3_chat_formatting", "op5_warc")))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    from quillspark.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_word_hashes():
    texts = [b"a bb  a\n\x0bccc", b"", b" ", "é a".encode()]
    h = list(hashed_docs(texts))
    assert [len(x) for x in h] == [4, 0, 0, 2] and h[0][0] == h[0][2] == h[3][1] and len(set(np.concatenate(h).tolist())) == 4


AWKWARD = [
    "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a²2 ²a ٣3 café! it's 'll x.y. ..a  b \n\n c d　 e!? ſ ǅ ab́c", "日本語、テスト。 word,,word .word", "a b\nc, d e",
    "a  b\tc\x1cd", "\n", " ", "one\ntwo", "x\u0085y z", "a- b", "don't I'll we'd, \"x\" (y).", "",
]


def test_token_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(AWKWARD, add_special_tokens=False)]
    e = token_store.WordEncoder(path)
    assert [np.frombuffer(e.encode(x), e.dtype).tolist() for x in AWKWARD] == want and want[0] == [87, 220, 50256, 331]


def test_token_ids_of_mixed_texts():
    """Texts put together from awkward parts, encoded many at a time, have the library's ids."""
    from tokenizers import Tokenizer

    parts = ["a", "the", *" " * 4, "\n", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "'s", "'", "'ll", ".", ",", "!?", "1", "23", "é", "ß", "中", "🙂", "\0", "<|endoftext|>", "<|", "_", "\x7f", "а", "ab" * 40]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(8_000)]
    path = tokenizer("byte_bpe_50k.json")
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in token_store.WordEncoder(path).encode_all([t.encode() for t in texts])] == want


def test_quality_cutoffs_follow_the_groups(spark):
    """With little weight on the language, one symbol ratio is kept in one source and not in the other."""
    rng = np.random.default_rng(6)

    def prose(share):
        w = ["".join(rng.choice(list("aeinorst"), rng.integers(3, 8))) + ("#" if rng.random() < share else "") for _ in range(rng.integers(100, 160))]
        return " ".join(w)

    rows = [(i, prose(0.0), "en", "plain") for i in range(150)] + [(1000 + i, prose(0.3), "en", "tables") for i in range(150)] + [(1, prose(0.3), "en", "plain"), (2, prose(0.3), "en", "tables")]
    rows[-2], rows[-1] = (9001, *rows[-2][1:]), (9002, *rows[-1][1:])
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, rows), prior=2.0).collect()}
    assert not kept[9001] and kept[9002]


def test_reserved_names_do_not_clash(spark, docs):
    d = docs.withColumns({"_id": F.lit(2), "removed": F.lit("x"), "stays": F.lit(True), "__id": F.lit(3), "__removed": F.lit("y")})
    for stage in (line_dedup.drop_later_lines, near_dedup.keep_first, quality.keep_good, mixing.sample):
        assert stage(d).columns == d.columns
        stage(d).collect()


def test_mixing_against_plain_fitting():
    """Raked cells have the targets as their sums over every margin, where cells can meet them."""
    rng = np.random.default_rng(9)
    cells = rng.integers(1, 1000, 60).astype(float)
    codes = [np.arange(60) % 3, np.arange(60) // 3 % 4, np.arange(60) // 12]
    targets = [cells.sum() * x / x.sum() for x in (rng.random(k) + 0.1 for k in (3, 4, 5))]
    w = mixing.rake(cells, codes, targets)
    for c, t in zip(codes, targets, strict=True):
        assert np.bincount(c, weights=w) == pytest.approx(t, rel=1e-6)


def test_pipeline_of_an_empty_table(spark, sf_dir, real):
    import corpus_pipeline

    docs = real.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "empty")
        assert docs.columns == real.columns and docs.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).isEmpty()


@pytest.mark.parametrize("step", [quality._measure, line_dedup._count, near_dedup._signatures(5), mixing._vectors])
def test_pipeline_stages_let_go_of_the_encoder(step):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"some words"])], names=["doc_id", "text"])
    encode = sentencepiece_stream._encode(tokenizer("piece_bpe_32k.model"), None)
    before = [x.to_pydict() for x in encode([batch])]
    assert sentencepiece_stream.encoder.cache_info().currsize
    list(step([]))
    assert not sentencepiece_stream.encoder.cache_info().currsize
    assert [x.to_pydict() for x in encode([batch])] == before


def test_lm_gradient_of_counted_positions_by_plain_sums():
    """Windows of which only some positions count, against one-by-one softmaxes; states only where asked for."""
    from quillspark.llm import lm_model as net

    rng = np.random.default_rng(4)
    flat = (net.start() + rng.normal(0, 0.1, net.SIZE)).astype(np.float32)
    prior = net.prior(rng.integers(0, 9, (net.LEAVES + 2, net.LEAVES + 1)).astype(float))
    x, y, counts = net.windows(rng.integers(0, net.LEAVES + 1, 70).astype(np.int32))
    p = net.views(flat)
    h = net.hidden(p, x, counts)[0]
    assert h.shape == (70, net.WIDTH)
    assert np.allclose(h, net.hidden(p, x)[0][counts.ravel()], atol=1e-6)
    dh_cls, loss = np.zeros_like(p["cls"]), 0.0
    mem_b = np.zeros_like(p["mem_b"])
    for state, before, after in zip(h, x[counts], y[counts], strict=True):
        c, m = divmod(int(after), net.MEMBERS)
        for logits, own, add in ((state @ p["cls"] + p["cls_b"] + prior[0][before], c, 0), (state @ p["mem"][c] + p["mem_b"][c] + prior[1][before, c], m, 1)):
            share = np.exp(logits - logits.max())
            share /= share.sum()
            loss -= np.log(share[own]) / 70
            share[own] -= 1
            if add:
                mem_b[c] += share / 70
            else:
                dh_cls += np.outer(state, share) / 70
    got, grad = net.loss_and_gradient(flat, prior, x, y, counts)
    g = net.views(grad)
    assert abs(got - loss) < 1e-4
    assert np.allclose(g["cls"], dh_cls, atol=1e-5)
    assert np.allclose(g["mem_b"], mem_b, atol=1e-5)
    assert net.loss_and_gradient(flat, prior, x, y, np.zeros_like(counts))[0] == 0


def test_lm_windows_ask_only_where_they_count(monkeypatch):
    """Places that are only looked back at get no queries, in texts of any length; scores of any size stay finite."""
    from quillspark.llm import lm_model as net

    rng = np.random.default_rng(6)
    p = net.views(net.start())
    prior = net.prior(rng.integers(0, 9, (net.LEAVES + 2, net.LEAVES + 1)).astype(float))
    parts = [net.windows(rng.integers(0, net.LEAVES + 1, n).astype(np.int32)) for n in (1, net.STEP, net.STEP + 1, net.SPAN, 200)]
    assert [len(m) for _, _, m in parts] == [1, 1, 2, 2, 11]
    x, y, counts = (np.concatenate([w[i] for w in parts]) for i in range(3))
    assert not counts[:, : net.SPAN - net.STEP].any()
    whole = net.attended(p, x)[0].reshape(len(x), net.SPAN, net.WIDTH)
    rows = []
    monkeypatch.setattr(net, "fed", lambda p, h1, fed=net.fed: rows.append(h1) or fed(p, h1))
    h = net.hidden(p, x, counts)[0]
    assert np.allclose(rows[0], whole[counts], atol=1e-6)
    assert len(net.attended(p, x, net.first_counted(counts))[0]) == len(x) * net.STEP
    for size in (1, 3000):
        at = x[counts], y[counts]
        got = net.log_probs(p, prior, h * np.float32(size), *at)
        assert np.isfinite(got).all() and (got <= 1e-4).all()
    flat = (net.start() * 40).astype(np.float32)
    loss, grad = net.loss_and_gradient(flat, prior, x, y, counts)
    assert np.isfinite(loss) and np.isfinite(grad).all()


def test_lm_ids_learn_each_missing_word_once(monkeypatch):
    ids = lm_score.Ids(subwords("byte_bpe_50k.tiktoken"))
    asked, learn = [], ids._learn
    monkeypatch.setattr(ids, "_learn", lambda new: (asked.append(sorted(new)), learn(new)))
    monkeypatch.setattr(lm_score, "KNOWN_WORDS", 2)
    first = ids.of([b"one", b"two", b"three"])
    assert asked == [[b"one", b"three", b"two"]]
    assert ids.of([b"two", b"four", b"two", b"four"]).tolist() == [*ids.of([b"two"], end=False), *ids.of([b"four"], end=False)] * 2 + [ids.end]
    # words that were at hand when others were forgotten are not encoded again
    assert asked[1] == [b"four"]
    assert ids.of([b"one", b"two", b"three"]).tolist() == first.tolist()
