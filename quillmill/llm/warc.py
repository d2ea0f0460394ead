"""WARC archives compressed with Zstandard: a writer, and a reader that checks what it reads.

An archive is a series of Zstandard frames, one for each record, so that a record can be read alone. It may begin with a skippable frame (magic number
``DICTIONARY``) that holds the dictionary the records are compressed with, itself compressed or not; a leading frame of another skippable kind, or none,
means no dictionary. Other skippable frames are passed over wherever they stand.

``write_archives`` trains the dictionary on a bounded sample (``SAMPLE_ROWS`` rows, ``SAMPLE_BYTES`` bytes of each; if they are too few, there is none) and
writes with Spark's own text sink, on any file system that Spark writes to and under its commit protocol: a row is a block of frames, and the line
separator is the eight bytes of an empty skippable frame, which any reader passes over. An archive holds at most ``BLOCKS`` blocks of about ``BLOCK_BYTES`` bytes.
Among rows with equal payloads of at least ``least`` bytes, the one with the largest id is written as a response; the others are revisits of it, without
the payload. The rows of payloads that repeat are few bytes each and are sent to the pages behind a count of them; beyond ``SENT`` they are joined, the most common ones
still sent (at most ``HOT``), so that no common page gathers in one task.

``read_archives`` takes an archive as one task's work, a frame at a time, and checks of each record that the frame is whole and holds that record and nothing
else, its version line and named fields, the block's length against Content-Length, and for responses the payload's length and digest. A record that fails is a row
with ``error`` set, or ends the job if ``strict``; what follows a broken frame cannot be told apart and is one error.

Defined cases: a null payload is an empty one; null urls have no target field; a null id is written as an empty one, ranks least and comes back null; rows that repeat an id and a
payload of ``least`` bytes are all responses where the id is the largest; control characters and spaces in urls are written percent-encoded (and so come back); an
empty table writes no record; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import drop, materialize, pieces

# Magic numbers of the Zstandard format, and of the frame that holds a dictionary in WARC files.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x5d\x2a\x4d\x18"
SKIPPED = [bytes([0x50 + k]) + b"\x2a\x4d\x18" for k in range(16)]
#: An empty skippable frame: what stands between rows of the text sink.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"

LEAST = 1000
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 65536
BLOCK_BYTES, BLOCKS = 2_000_000, 16
STEP = 1 << 14
SENT, HOT, SPREAD = 1_000_000, 1000, 1024
VERSION = b"WARC/1.1\r\n"
#: Of records by type, the fields that must be there.
NEEDED = (b"warc-record-id", b"warc-date", b"warc-type", b"content-length")


def train(samples: list[bytes]) -> bytes:
    """A dictionary, empty if there is too little to train one on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY + len(packed).to_bytes(4, "little") + packed


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(id_: str, url: str | None, payload: bytes, digest: bytes, n_bytes: int, refers_to: str | None, date: str) -> bytes:
    """One response or revisit: named fields, an HTTP head and, for a response, the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{id_}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields.append(("WARC-Payload-Digest", sha1_label(digest)))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all rows in a new folder; payload_col is text, written in UTF-8."""
    spark = rows.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    pages = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha1("payload"))})
    groups = pages.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("first")).where("n > 1 AND first IS NOT NULL")
    sent = materialize(groups, "repeated-payloads")
    # The sample: the rows of least hash, so that the dictionary, too, is the same in another run. Hashes are ordered without payloads, of which the drawn ones alone are read, cut short.
    h = F.xxhash64("id", "url")
    last = pages.select(h.alias("h")).orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    drawn = pages.where(h <= F.lit(last)).select(F.substring("payload", 1, SAMPLE_BYTES).alias("start"), h.alias("h")).orderBy("h", "start").limit(SAMPLE_ROWS)
    dictionary = train([bytes(r["start"]) for r in drawn.collect() if r["start"]])
    n_groups, n_rows = sent.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_groups <= SENT:
        met = pages.join(F.broadcast(sent.select("digest", "first")), "digest", "left")
    else:
        hot = sent.where(F.col("n") > n_rows / HOT).select("digest", F.col("first").alias("hot"))
        rest = sent.where(F.col("n") <= n_rows / HOT).select("digest", F.lit(0).alias("part"), "first")
        alone = F.col("hot").isNotNull() | (F.col("n_bytes") < least)
        dealt = pages.join(F.broadcast(hot), "digest", "left").withColumn("part", F.when(alone, 1 + F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)))
        met = dealt.join(rest, ["digest", "part"], "left").withColumn("first", F.coalesce("hot", "first"))
    first = F.when((F.col("n_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    met = met.select("id", "url", F.when(first.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "n_bytes", "digest", first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
        # The sink begins a new archive after every BLOCKS rows of a task, so that those begin with the dictionary.
        head = dictionary_frame(dictionary) if dictionary else b""
        block, made = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(b"" if made % BLOCKS else head) + b"".join(block)], pa.binary())], ["value"])

        size = 0
        for batch in pieces(batches, "payload"):
            for id_, url, data, n, digest, ref in zip(*(c.to_pylist() for c in batch.columns)):
                block.append(packer.compress(record("" if id_ is None else str(id_), url, data, digest, n, None if ref is None else str(ref), date)))
                size += len(block[-1])
                if size >= BLOCK_BYTES:
                    yield out()
                    block, made, size = [], made + 1, 0
        if block:
            yield out()

    # The sink writes a string's bytes as they are.
    blocks = met.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    blocks.write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", BLOCKS).text(folder)
    drop(sent)


def _frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each frame of an archive; the dictionary of its leading frame is applied."""
    at, dictionary = 0, None
    while at < len(data):
        magic, start = bytes(data[at : at + 4]), at
        if magic in SKIPPED:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            at += 8 + size
            if len(data) < start + 8 or at > len(data):
                yield start, None, "a skippable frame is cut off"
            elif not start and magic == DICTIONARY:
                held = bytes(data[8:at])
                try:
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == FRAME else held)
                except zstandard.ZstdError as e:
                    yield start, None, f"the dictionary cannot be read: {e}"
                    return
            continue
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        try:
            while not unpacker.eof and at < len(data):
                parts.append(unpacker.decompress(data[at : at + STEP]))
                at += STEP
        except zstandard.ZstdError as e:
            yield start, None, f"a frame cannot be read: {e}"
            return
        if not unpacker.eof:
            yield start, None, "a frame is cut off"
            return
        at = min(at, len(data)) - len(unpacker.unused_data)
        yield start, b"".join(parts), None


def _fields(lines: bytes) -> dict[bytes, bytes]:
    """Named fields, names in lower case; a line that begins with white space goes on with the field before it."""
    out: dict[bytes, bytes] = {}
    name = None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += b" " + line.strip()
        elif line:
            name, colon, value = line.partition(b":")
            name = name.strip().lower()
            if not colon or not name:
                raise ValueError("a header line has no name")
            out[name] = value.strip()
    return out


def parse(held: bytes) -> dict:
    """A record's fields and payload; ValueError says what is wrong with it."""
    if not held.startswith(b"WARC/1.") or b"\r\n" not in held:
        raise ValueError("no version line")
    line = held.index(b"\r\n") + 2
    end = held.find(b"\r\n\r\n", line - 2)
    if end < 0:
        raise ValueError("the header does not end")
    fields = _fields(held[line:end])
    for name in NEEDED:
        if name not in fields:
            raise ValueError(f"no {name.decode()}")
    if not fields[b"content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    length, block = int(fields[b"content-length"]), held[end + 4 :]
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(block) - 4} bytes, Content-Length is {length}")
    block, kind, digest = block[:length], fields[b"warc-type"].decode(), fields.get(b"warc-payload-digest", b"").decode()
    payload, n = block, length
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        told = _fields(head.partition(b"\r\n")[2]).get(b"content-length")
        n = len(payload) if told is None and kind != "revisit" else int(told) if told and told.isdigit() else None
        if kind != "revisit" and n != len(payload):
            raise ValueError(f"the payload has {len(payload)} bytes, its head says {n}")
    hexed = None
    if digest.startswith("sha1:"):
        value = digest[5:]
        hexed = (base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)).hex()
        if kind != "revisit" and hashlib.sha1(payload).hexdigest() != hexed:
            raise ValueError("the payload does not have its digest")
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    return {"record_id": text(b"warc-record-id"), "record_type": kind, "target_uri": text(b"warc-target-uri"), "date": text(b"warc-date"), "refers_to": text(b"warc-refers-to"), "payload_bytes": n, "payload_digest": hexed, "payload": payload}


_TEXTS = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest")
SCHEMA = "archive string, offset long, record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, error string"


def read_archives(spark: SparkSession, folder: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """One row for each record of all archives of a folder, in the columns of SCHEMA, and its payload if wanted."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            col = lambda name, kind: pa.array([r.get(name) for r in rows], kind)
            arrays = [col("archive", pa.string()), col("offset", pa.int64()), *(col(n, pa.string()) for n in _TEXTS), col("payload_bytes", pa.int64()), col("error", pa.string())]
            names = ["archive", "offset", *_TEXTS, "payload_bytes", "error"]
            if payload:
                arrays.append(col("payload", pa.binary()))
                names.append("payload")
            return pa.RecordBatch.from_arrays(arrays, names)

        for got in pieces(batches, "content"):
            for path, content in zip(got.column(0).to_pylist(), got.column(1)):
                rows, size = [], 0
                for offset, held, error in _frames(memoryview(content.as_buffer())) if content.as_buffer() is not None else ():
                    row = {"archive": path, "offset": offset, "error": error}
                    if held is not None:
                        try:
                            row |= parse(held)
                        except ValueError as e:
                            row["error"] = str(e)
                    if strict and row["error"]:
                        raise ValueError(f"{path}, record at byte {offset}: {row['error']}")
                    size += len(row["payload"]) if payload and row.get("payload") else 200
                    rows.append(row)
                    if size >= 4 * BLOCK_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, SCHEMA + (", payload binary" if payload else ""))


def page_of(name: str):
    """The page's id out of a record's."""
    return F.nullif(F.regexp_extract(name, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")


def pages_read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``write_archives``."""
    found = read_archives(spark, folder, payload=False)
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
