"""Document fingerprints: threshold-scaled sketches of word shingles.

A document's shingles are its runs of five words (runs of anything but ASCII white space; a text of fewer words
is one shingle). The sketch keeps every shingle hash below a fixed fraction of the hash range, so it is a sample
of the shingle set at one rate for all documents: two sketches merge by union into the sketch of both texts, and
the share of one sketch that lies in another estimates containment however unequal the documents are. A short text
may have no shingle below the threshold; its sketch is empty, as merging wants it.

A fingerprint is the sorted kept hashes, sixteen hex digits each, in one string. Likeness is the share of the
smaller sketch that lies in the larger one. Where one of two texts has an empty sketch, ``compare_with_next``, which has both texts at hand, takes all their
shingles instead: 1 for two texts without words, 0 when only one has none.

Neighbours (the next document by ascending id) are found without a global window: ids are cut into ranges at
approximate quantiles, rows go to their range, and the first row of each range also goes to the range before it.

Defined cases: null text counts as empty; null ids sort first; rows with equal ids are ordered by text; the only
document of a table is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import pieces, shingles, word_hashes

WORDS = 5
FRACTION = 1 / 16


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct kept hashes of a whole text; none where no shingle's hash is below the threshold."""
    return _kept(all_hashes(text), fraction)


def all_hashes(text: str) -> np.ndarray:
    """The hashes of a whole text's shingles."""
    return shingles(word_hashes(text.encode("utf-8", "replace"))[2], WORDS)


def _kept(hashes: np.ndarray, fraction: float) -> np.ndarray:
    return np.unique(hashes[hashes < np.uint64(int(fraction * float(1 << 53)) << 11)] if fraction < 1 else hashes)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts, each with the hashes of its shingles and its sketch: containment by the sketches, or, where one has kept nothing, by all shingles."""
    if len(a[1]) and len(b[1]):
        return containment(a[1], b[1])
    return containment(np.unique(a[0]), np.unique(b[0]))


def to_string(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the shingles of both."""
    return _kept(np.union1d(a, b), fraction)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that lies in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(id, fingerprint) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            prints = [to_string(sketch(t or "", fraction)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _range_of(id_: Column, splits: list) -> Column:
    """How many of the sorted splits are not above the id: a binary search over a literal array."""
    steps = [1 << k for k in reversed(range(max(1, len(splits)).bit_length()))]
    literal = F.array(*[F.lit(s) for s in splits])
    found = F.lit(0)
    if splits:
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(splits)) & (F.get(literal, at + s - 1) <= id_), at + s).otherwise(at))
    return F.when(id_.isNull(), F.lit(0)).otherwise(found).cast("int")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, head, id, text): partitioned and sorted by id; head rows repeat the first row of the next range at a range's end."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    quantiles = slim.select("id").approxQuantile("id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = sorted({int(q) for q in quantiles})
    slim = slim.withColumn("range", _range_of(F.col("id"), splits))
    # One row for each range, as many as there are partitions at most.
    heads = sorted((r["range"], None if r["nulls"] else r["least"]) for r in slim.select("id", "range").groupBy("range").agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).collect())
    known = {r: k for k, (r, _) in enumerate(heads)}
    least = F.array(*[F.lit(heads[known[r]][1] if r in known else None).cast("long") for r in range(len(splits) + 1)])
    before = F.array(*[F.lit(heads[known[r] - 1][0] if r in known else None).cast("int") for r in range(len(splits) + 1)])
    here = F.struct(F.col("range"), F.lit(False).alias("head"))
    there = F.struct(F.get(before, F.col("range")).alias("range"), F.lit(True).alias("head"))
    targets = F.when(F.col("id").eqNullSafe(F.get(least, F.col("range"))), F.array(here, there)).otherwise(F.array(here))
    dealt = slim.withColumn("to", F.explode(targets)).select("to.range", "to.head", "id", "text")
    return dealt.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions("head", F.col("id").asc_nulls_first(), "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last quarter replaced by the start of the next document), and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # the last row whose next one has not been seen: id, text, hashes and sketch
        done = False

        def row(own: tuple, after: tuple) -> tuple:
            id_, text, kept = own
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + after[1][:quarter]
            other = both(edited) if edited != text else kept
            return id_, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), to_string(kept[1]), to_string(other[1]), likeness(kept, other), likeness(kept, after[2])

        def both(text: str) -> tuple[np.ndarray, np.ndarray]:
            hashes = all_hashes(text)
            return hashes, _kept(hashes, fraction)

        for batch in pieces(batches, "text"):
            rows = []
            for head, id_, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if done:
                    break
                text = text or ""
                now = (id_, text, both(text))
                if held is not None:
                    rows.append(row(held, now))
                held, done = now, head
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
