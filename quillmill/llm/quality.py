"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: hashed lower-case words with weights log(1 + count), scaled to unit length;
hashed letter classes of words (their shape); and statistics of its structure and size (shares of letters,
upper case, digits, symbols, repeated words and lines, lengths of words and lines, the number of characters), each
both as a number and in a few one-hot bins. The machine scores

    b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose pairwise part is computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), and a logistic
function makes it a score from 0 to 1. It is fitted by minibatch AdaGrad to a sample of the labelled documents that
are not held out: at most ``SAMPLE`` rows, chosen by hash of the id. Features are made and all documents scored in
Spark tasks; the weights (``WORDS`` + statistics, times rank + 1) are of fixed size and are broadcast.

Defined cases: null and empty texts have no words and statistics of 0 and get the score of that vector; labels that
are null or belong to no document teach nothing; a document labelled more than once counts with its least
label; if all training labels are equal, or there are none, all scores are their mean (or one half);
repeated rows are scored alike; an empty table gives an empty table; labels, lang, source and doc_id are not read as
features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import NOT_LETTER, held_out, joined, mix, pieces, word_hashes

WORD_BITS = 12
WORDS = 1 << WORD_BITS
RANK = 8
SAMPLE = 12_000
EPOCHS = 6
THRESHOLD = 0.7
BINS = 8
#: Numbers of a text; see ``statistics``.
STATS = 18
FEATURES = WORDS + STATS + STATS * BINS
_LOW, _HIGH, _DIGIT, _BLANK, _LINE = (np.zeros(256, dtype=bool) for _ in range(5))
_LOW[97:123] = _LOW[128:] = True
_HIGH[65:91] = True
_DIGIT[48:58] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LINE[10] = True


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(STATS numbers of each text, all in about 0 to 1; its words' hashes in a row; where each text's words end)."""
    data, ends = joined(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(ends)
    starts = ends - np.diff(ends, prepend=0)
    size = np.maximum(ends - starts - 1, 0).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (upto[ends] - upto[starts]).astype(float)

    chars = np.maximum(size, 1)
    start, end, word = word_hashes(data)
    until = np.searchsorted(start, ends)
    count = np.diff(until, prepend=0).astype(float)
    words = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count.astype(int))
    length = (end - start).astype(float)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    key = mix(word + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kinds, back, times = np.unique(key, return_inverse=True, return_counts=True)
    kind_doc = np.zeros(len(kinds), dtype=np.int64)
    kind_doc[back] = doc
    distinct = np.bincount(kind_doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, kind_doc, times)
    line_start, line_end, line = word_hashes(data, _LINE)
    line_doc = np.searchsorted(ends, line_start, side="right")
    lines = np.bincount(line_doc, minlength=n).astype(float)
    line_kinds = np.unique(mix(line + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    line_distinct = np.bincount(line_doc[line_kinds], minlength=n)
    low, high, digit, blank = (total(m[raw]) for m in (_LOW, _HIGH, _DIGIT, _BLANK))
    blank = blank - 1 if n else blank  # the line feed after each text
    symbols = np.maximum(size - low - high - digit - blank, 0)
    last = raw[end - 1] if len(end) else raw[:0]
    first = raw[start] if len(start) else raw[:0]
    stats = np.stack(
        [
            np.log1p(size) / 12,
            np.log1p(count) / 10,
            low / chars,
            np.minimum(1, high / chars * 4),
            np.minimum(1, digit / chars * 4),
            np.minimum(1, symbols / chars * 4),
            np.minimum(1, blank / chars * 2),
            np.minimum(1, by_doc(length) / words / 20),
            np.minimum(1, np.sqrt(np.maximum(by_doc(length * length) / words - (by_doc(length) / words) ** 2, 0)) / 10),
            distinct / words,
            most / words,
            by_doc(again) / words,
            np.minimum(1, lines / words * 4),
            line_distinct / np.maximum(lines, 1),
            by_doc(~_LOW[last] & ~_HIGH[last] & ~_DIGIT[last]) / words,
            by_doc(_HIGH[first]) / words,
            by_doc(length == 1) / words,
            by_doc(~_LOW[first] & ~_HIGH[first] & ~_DIGIT[first]) / words,
        ],
        axis=1,
    )
    return np.nan_to_num(np.clip(stats, 0, 1.5)), kinds, kind_doc


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse vectors of all texts: feature numbers and values in a row, and how many belong to each text."""
    n = len(texts)
    stats, _, _ = statistics(texts)
    data, ends = joined([(t or "").lower() for t in texts])
    start, _, word = word_hashes(data, NOT_LETTER)
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(start, ends), prepend=0))
    pair, times = np.unique((doc.astype(np.int64) << WORD_BITS) | (word >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    doc, weight = pair >> WORD_BITS, np.log1p(times)
    weight = weight / np.sqrt(np.bincount(doc, weights=weight * weight, minlength=n))[doc] if len(doc) else weight
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    number = np.arange(STATS)
    docs = np.concatenate([doc, np.repeat(np.arange(n), 2 * STATS)])
    columns = np.concatenate([pair & (WORDS - 1), np.concatenate([np.broadcast_to(WORDS + number, (n, STATS)), WORDS + STATS + number * BINS + bins], axis=1).ravel()])
    values = np.concatenate([weight, np.concatenate([stats, np.full((n, STATS), 0.5)], axis=1).ravel()])
    order = np.argsort(docs, kind="stable")
    return columns[order], values[order].astype(np.float32), np.bincount(docs, minlength=n)


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; every text has features, so no run is empty."""
    return np.add.reduceat(x, np.cumsum(counts) - counts, axis=0)


def machine(weights: dict, columns: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic function, sums of v x): linear in the number of features."""
    vx = weights["v"][columns] * values[:, None]
    inner = _sums(vx, counts)
    return weights["b"] + _sums(weights["w"][columns] * values, counts) + 0.5 * (inner * inner - _sums(vx * vx, counts)).sum(axis=1), inner


def train(columns: np.ndarray, values: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.1, seed: int = 7) -> dict:
    """Minibatch AdaGrad on the logistic loss, with a little shrinking of what a batch touches."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    weights = {"b": float(np.log(share / (1 - share))), "w": np.zeros(FEATURES, np.float32), "v": rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)}
    gw, gv, gb = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32), 1e-2
    begin = np.cumsum(counts) - counts
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            size = counts[at]
            take = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            c, x = columns[take], values[take]
            z, inner = machine(weights, c, x, size)
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)).astype(np.float32)
            e = np.repeat(error, size) * x
            touched, place = np.unique(c, return_inverse=True)
            dw = np.bincount(place, weights=e, minlength=len(touched)).astype(np.float32) + 1e-5 * weights["w"][touched]
            each = e[:, None] * (np.repeat(inner, size, axis=0) - weights["v"][c] * x[:, None])
            dv = np.stack([np.bincount(place, weights=each[:, f], minlength=len(touched)) for f in range(RANK)], axis=1).astype(np.float32) + 1e-5 * weights["v"][touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            gb += error.sum() ** 2
            weights["w"][touched] -= rate * dw / np.sqrt(gw[touched])
            weights["v"][touched] -= rate * dv / np.sqrt(gv[touched])
            weights["b"] -= float(rate * error.sum() / np.sqrt(gb))
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Weights from at most ``sample`` labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    # The sample is drawn from ids alone; texts are fetched for it afterwards.
    ids = docs.select(F.col(id_col).alias("id")).where(~held_out(F.col("id")) & F.col("id").isNotNull()).distinct()
    chosen = ids.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000):
            columns, values, counts = vectors(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a)) for a in (columns.astype(np.int32), values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["id", "label", "c", "x"])

    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, c array<int>, x array<float>").toArrow().sort_by("id")
    y = got["label"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return {"b": float(np.log(p / (1 - p))), "w": np.zeros(FEATURES, np.float32), "v": np.zeros((FEATURES, RANK), np.float32)}
    c, x = got["c"].combine_chunks(), got["x"].combine_chunks()
    return train(c.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy(), np.asarray(c.value_lengths()).astype(np.int64), y)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row for each document; no shuffle of texts."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = fitted.value
        for batch in pieces(batches, "text", 2_000_000):
            z, _ = machine(weights, *vectors(batch.column(2).to_pylist()))
            p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
