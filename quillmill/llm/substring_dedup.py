"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text's UTF-8 bytes run through a gear hash: shift left by one and add a random number for the byte, in 16 bits, so
that a value depends on the last 16 bytes only. Where its upper five bits are zero a chunk ends (one place in
32, moved to the end of a character), and after ``LONGEST`` bytes at the latest. Chunk ends follow from what
stands before them, so text that is inserted or removed elsewhere does not shift them, and a passage that repeats
has the same chunks wherever it stands, but for those its ends cut.

Chunks are told by a 64-bit digest and counted over the whole corpus; the first occurrence (least doc_id, then
place) stays. Later occurrences that follow each other in a document are merged into spans, and a span of at
least ``LEAST`` characters is a repeat and is taken out; shorter ones (a common phrase or line, or two chunks that
share a digest by chance) stay.

Defined cases: null text has no repeats and stays null; an empty text stays; rows that repeat a (doc_id, text)
are one occurrence and are treated alike; rows of equal doc_id are told apart, and come in the order of, their text's 64-bit hash; a row without doc_id is named by its text's hash and stands where that falls in the order of
ids; an empty table gives an empty table; other columns pass through untouched, and where one is named as one
that the result adds, the added one has an underscore behind its name. A digest with more than one in ``HOT`` of all repeated chunks (there are at most ``HOT``) is sent to the
chunks instead of the chunks to it, so that no common line gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.llm.common import free_name, materialize, mix, pieces, private_prefix, scratch

LEAST = 130
LONGEST = 160
#: A span begins and ends with chunks of at least so many characters; shorter ones repeat by chance.
SHORT = 16
#: Upper bits of the 16-bit gear hash that are zero where a chunk ends.
BITS = 5
HOT = 1000
#: Added to the key of a hot digest's rows, which need no partner, so that they spread.
SPREAD = 1024
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint16)


def chunk_ends(data: bytes) -> np.ndarray:
    """Byte offsets at which the chunks of a text end, the last one its length."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    h = _GEAR[raw]
    for s in (1, 2, 4, 8):
        grown = h.copy()
        grown[s:] += h[:-s] << np.uint16(s)
        h = grown
    lead = np.append((raw[1:] & 0xC0) != 0x80, True)  # what follows does not continue a character
    free = np.flatnonzero(lead)
    ends = free[np.searchsorted(free, np.flatnonzero(h >> np.uint16(16 - BITS) == 0))] + 1
    ends = np.unique(np.append(ends, len(raw)))
    long = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(long):
        more = []
        for k in long:
            start = ends[k - 1] if k else 0
            while ends[k] - start > LONGEST:
                start = free[np.searchsorted(free, start + LONGEST - 1, side="right") - 1] + 1
                more.append(start)
        ends = np.unique(np.concatenate([ends, more]))
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, number of characters, digest) of each chunk of a whole text."""
    data = text.encode("utf-8", "replace")
    ends = chunk_ends(data)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digest = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64).view(np.int64)
    if len(data) == len(text):
        return starts, ends - starts, digest
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    return upto[starts], upto[ends] - upto[starts], digest


def _identity(id_: Column, text: Column) -> tuple[Column, Column, Column]:
    """(the id, or for null the text's hash; whether the id is null; the text's hash, null for a null text): what tells rows apart."""
    hashed = F.when(text.isNotNull(), F.xxhash64(text))
    return F.coalesce(id_.cast("long"), hashed), id_.isNull(), hashed


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, none, text) -> one row for each chunk: its digest, the id, the text's hash, and whether the id is null, place, whether the text had it before, and length in one number."""
    for batch in pieces(batches, "text", 2_000_000):
        ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        none = np.array(batch.column(2).to_pylist(), dtype=np.int64)
        out = [chunks(t) for t in batch.column(3).to_pylist()]
        n = [len(o[0]) for o in out]
        place = []
        for start, length, digest in out:
            again = np.ones(len(digest), dtype=np.int64)
            again[np.unique(digest, return_index=True)[1]] = 0
            place.append(start << 16 | again << 15 | length)
        packed = np.concatenate(place) | np.repeat(none, n) << 48
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[2] for o in out])), pa.array(np.repeat(ids, n)), pa.array(np.repeat(tags, n)), pa.array(packed.astype(np.int64))], ["digest", "id", "tag", "place"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, tag, none, spans, first_ids): for each document with repeats, told by ``_identity``, their (start, end) in characters and where they first stand."""
    id_, none, tag = _identity(F.col(id_col), F.col(text_col))
    slim = docs.where(F.length(text_col) > 0).select(id_.alias("id"), tag.alias("tag"), none.alias("none"), F.col(text_col).alias("text"))
    rows = slim.mapInArrow(_chunk_rows, "digest long, id long, tag long, place long")
    none = F.shiftrightunsigned("place", 48) > 0
    # What tells a first occurrence are the least id and tag and, within that document, the chunker's mark.
    with scratch() as kept:
        counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", none.alias("none"), "tag")).alias("first"))
        repeated = kept.keep(materialize(counted.where("n > 1").select("digest", "n", "first"), "repeated-chunks"))
    most = (repeated.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = repeated.where(F.col("n") > most).select("digest", F.col("first").alias("hot"))
    rest = repeated.where(F.col("n") <= most).select("digest", F.lit(0).alias("part"), "first")
    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn("part", F.when(F.col("hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("id", "tag", "place"), F.lit(SPREAD)).cast("int")))
    met = dealt.join(rest, ["digest", "part"], "left").withColumn("first", F.coalesce("hot", "first")).where("first IS NOT NULL")
    again = F.col("place").bitwiseAND(F.lit(0x8000)) != 0
    other = (F.col("id") != F.col("first.id")) | (F.col("tag") != F.col("first.tag")) | (none != F.col("first.none"))
    later = met.where(other | again).select("id", "tag", "place", F.col("first.id").alias("first"))
    start = F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFFFFFF))
    # Runs of chunks that touch, within each document; rows repeated as a whole repeat their chunks. Only packed rows are shuffled.
    later = later.repartition("id", "tag").dropDuplicates(["id", "tag", "place"]).select("id", "tag", none.alias("none"), start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(0x7FFF))).alias("end"), "first")
    order = W.partitionBy("id", "tag", "none").orderBy("start")
    runs = later.withColumn("new", F.coalesce((F.lag("end").over(order) < F.col("start")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    solid = F.col("end") - F.col("start") >= SHORT
    spans = runs.groupBy("id", "tag", "none", "run").agg(*[f(F.when(solid, F.col(c))).alias(name) for f, c, name in ((F.min, "start", "start"), (F.max, "end", "end"), (F.collect_set, "first", "firsts"))]).where(F.col("end") - F.col("start") >= least)
    return spans.groupBy("id", "tag", "none").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_ids"))


def _cut(text: str, spans: list) -> str:
    at, out = 0, []
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, only_changed: bool = False) -> DataFrame:
    """docs with ``text_col`` cleaned and repeat_spans, first_ids (null where nothing repeats); ``only_changed``: just the documents with repeats."""
    names = docs.columns
    own = private_prefix(names, "__sd_")
    keys = dict(zip(("id", "none", "tag"), _identity(F.col(id_col), F.col(text_col))))
    found = repeats(docs, id_col, text_col, least).select(*[F.col(k).alias(f"{own}{k}") for k in keys], F.col("spans").alias(free_name(names, "repeat_spans")), F.col("first_ids").alias(free_name(names, "first_ids")))
    # A null text's hash is null and meets nothing.
    joined = docs.withColumns({f"{own}{k}": c for k, c in keys.items()}).join(found, [f"{own}{k}" for k in keys], "inner" if only_changed else "left").drop(*[f"{own}{k}" for k in keys])
    at, spans_at = names.index(text_col), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts, spans = batch.column(at).to_pylist(), batch.column(spans_at).to_pylist()
            cut = [t if s is None else _cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, batch.column(k).type) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return joined.mapInArrow(run, joined.schema)
