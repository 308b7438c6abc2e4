"""WARC archives, Zstandard compressed record by record, with a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself
a Zstandard frame; then each record is one frame. The dictionary is trained on the first
``DICT_RECORDS`` records of the archive (the bound of that sample). Archives end at ``ARCHIVE_BYTES`` of
records, so a reader's task holds one archive at a time.

Payloads that occur before are revisits: of records with equal payloads of at least ``min_revisit``
bytes, the one with the least page_id is the response. Digests are aggregated, so a payload that a third
of the pages share costs one row per task.

The reader takes the dictionary from the leading frame, decodes one frame per record and checks the
version line, the mandatory headers, Content-Length, the digest of whole payloads and the frame's end; a
broken archive raises ValueError.

Null texts are empty payloads; null urls are written without a target; control characters and spaces in
urls are percent-encoded. Pages with a null page_id are always responses. Rows that repeat a page_id are
records of their own; if that page_id holds the response of its payload, each of its rows is one. An empty table
gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, open_out, pick, shared_dir, small_batches

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DICT_BYTES, DICT_RECORDS, ARCHIVE_BYTES = 16_384, 200, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    name = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}")
    return f"<urn:uuid:{name}>"


def quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quoted(url)))
    if page_id is not None:
        head.append(("WARC-Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    """The dictionary frame, if the records are enough to train one, then a frame for each record."""
    out, trained = io.BytesIO(), None
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, records[:DICT_RECORDS])
    except zstandard.ZstdError:
        pass  # too few or too small records for a dictionary
    if trained is not None:
        body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        out.write(struct.pack("<II", DICT_MAGIC, len(body)) + body)
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def _write(folder: str):
    def run(batches):
        held, size = [], 0

        def close():
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            with open_out(name) as f:
                f.write(make_archive(held))
            return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([len(held)], pa.int64())], names=["name", "records"])

        for batch in batches:
            for x in batch.to_pylist():
                payload = (x["html"] or "").encode()
                r = make_record(x["page_id"], x["url"], payload, x["digest"], x["refers_to"])
                if held and size + len(r) > ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield close()

    return run


def decide(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to."""
    p = pages.withColumns({"digest": F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), "bytes": F.coalesce(F.octet_length("html"), F.lit(0))})
    long = p.filter(F.col("bytes") >= min_revisit).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    later = long.join(first, "digest").filter("page_id <> first").select("page_id", F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    return p.drop("bytes").alias("p").join(later.alias("l"), (F.col("p.page_id") == F.col("l.page_id")) & (F.col("p.digest") == F.col("l.d")), "left").select("p.page_id", "p.url", "p.html", "p.digest", "l.refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """Writes the archives; returns their folder and the manifest (name, records) of those that count.

    A task that is run again writes archives under new names; the manifest names the archives of the attempt
    that succeeded, and the reader takes no others.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    p = pick(pages, page_id=page_id, url=url, html=html).withColumn("page_id", F.col("page_id").cast("long"))
    return folder, cut(decide(p, min_revisit).mapInArrow(_write(folder), "name string, records long"), "warc-manifest")


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[name.decode("ascii")] = value.strip().decode()
    return out


def read_record(raw: bytes) -> dict:
    """A checked record."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not end or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    h = headers(lines)
    if missing := [k for k in MANDATORY if k not in h]:
        raise ValueError(f"headers missing: {missing}")
    length = h["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    http, end, payload = block.partition(b"\r\n\r\n")
    if not end or not http.startswith(b"HTTP/"):
        raise ValueError("the block is no HTTP message")
    n = int(headers(http.partition(b"\r\n")[2])["Content-Length"])
    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind not in ("response", "revisit") or kind == "revisit" and payload:
        raise ValueError(f"a {kind} record with {len(payload)} bytes of payload")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("WARC-Page-ID"), "url": h.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def read_frames(data: bytes):
    """The decoded frames of an archive after its leading dictionary."""
    view, at, words = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= (magic := struct.unpack_from("<I", data, at)[0]) <= 0x184D2A5F and magic != DICT_MAGIC:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one, out, step = unpacker.decompressobj(), [], 1 << 14
        try:
            while not one.eof:
                if at >= len(data):
                    raise ValueError("the last frame is cut off")
                part = view[at : at + step]
                out.append(one.decompress(part))
                at += len(part)
        except zstandard.ZstdError as e:
            raise ValueError(f"a broken frame before byte {at}: {e}") from e
        at -= len(one.unused_data)
        yield b"".join(out)


def _read(payloads: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = [read_record(x) for x in read_frames(data.as_py())]
                keep = names if payloads else names[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(keep, kinds, strict=False)], names=keep)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of all *.warc.zst files in a folder, or of those that a manifest names."""
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        name = manifest.select(F.col("name").alias("__name"))
        files = files.join(F.broadcast(name) if name.count() <= 100_000 else name, F.substring_index("path", "/", -1) == F.col("__name"), "left_semi")
    schema = SCHEMA if payloads else SCHEMA.rpartition(", ")[0]
    return files.select("content").mapInArrow(_read(payloads), schema)
