"""Toxicity: two Kneser-Ney models of letters, one of toxic and one of ordinary documents, that share their backoff.

A text is read as words of lower-case letters; each word is a row of symbols, one for each letter and one for its
end. The model of class c gives each symbol w after the (up to six) symbols h before it in its word

    P_c(w | h) = max(n_c(h w) - D, 0) / n_c(h) + m_c(h) / n_c(h) * P(w | last 3 of h)
    P(w | h)   = max(k(h w) - d, 0) / k(h) + d * t(h) / k(h) * P(w | last 1 of h),  and so on to a uniform one,

with n_c the counts in class c, m_c(h) the sum of min(n_c(h w), D) over w, t the number of kinds of symbol seen after
h, and k the Kneser-Ney continuation counts: of how many different longer rows h w is the end, in both classes
together. The counts of ordinary documents are scaled to the total of the toxic ones, so that a discount weighs
the same in both. A rare expression, one of about D occurrences at that scale, thus gets its
probability from counts that the classes share and speaks for neither. What is stored is, for each row,
log P_toxic - log P_ordinary, and for each context the same of the backoff weights (for rows not seen, where the shared
P cancels out).

All counts are Spark aggregations over every labelled document that is not held out, and so are the
differences. A model is two tables without a bound: the rows with more than D occurrences in either class
(every other row has exactly its context's value) and the contexts whose value is not 0. They are counted; up to ``SENT`` of
them are broadcast whole and every word is looked up where its text stands, without a shuffle. A larger model stays in Spark and
the different words of the documents are joined with it, which gives each word the sum of its rows' values; the
``ROWS`` most frequent words' values are then broadcast, those of all other words joined to the documents that have them. The bounds
decide how values travel, not what they are. Words are told by 64-bit hashes.

The sum of the differences over a text divided by its number of symbols is the length-normalised comparison of
the whole; beside it stand, also by length, the shares of words whose own comparison exceeds a few levels, since a
long ordinary text may hold few toxic words. A logistic curve over these and the number of words turns them into a
score from 0 to 1; it is fitted to one fold of the labelled documents (remainder 3) compared by models of the
other two (remainders 0 and 1), of which it takes at most ``CURVE_ROWS`` rows, chosen by hash.

Defined cases: null and empty texts and texts without letters have all comparisons 0 and get the score of
the curve there; labels that are null or belong to no document teach nothing; a document labelled more than once
counts as toxic if it ever is; without any toxic or any ordinary training document all scores are
the training share of toxic documents (with 0.1 toxic and 1 ordinary document added: 1/11 without any label); repeated rows are scored alike; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import drop, held_out, materialize, mix, pieces, private_prefix, scratch, word_hashes

#: Symbols of the longest row; eight bits each, so that a row is one long.
ORDER = 7
SHARED = (4, 2)
#: D, of the classes, and d, of the shared counts.
DISCOUNT, SHARED_DISCOUNT = 5.0, 0.75
#: So many rows and contexts of a model are broadcast; a larger one is joined.
SENT = 1 << 22
#: Of a larger one, so many words' values are broadcast; the others' are joined.
ROWS = 1 << 19
#: Different rows, and words, that a task counts before it hands them on.
HELD = 1_000_000
WORDS_HELD = 250_000
CURVE_ROWS = 20_000
#: So many labels, or toxic texts (two numbers each), are broadcast; beyond it the join shuffles texts.
LABELS_SENT = 2_000_000
THRESHOLD = 0.3
#: Log-likelihood differences of single words.
LEVELS = (1, 2, 3, 4)
FEATURES = 3 + 2 * (len(LEVELS) + 1)
#: Values are summed as whole numbers of this many to one, so that no sum depends on the order of its terms.
UNITS = 1 << 20
_SYMBOLS = np.empty(0, dtype=np.uint8)


def symbol_table() -> np.ndarray:
    """UTF-16 unit -> symbol: a to z are themselves, other letters fall on 128 to 254, all else is 32."""
    global _SYMBOLS
    if not len(_SYMBOLS):
        _SYMBOLS = np.array([32 if not chr(c).isalpha() and not 0xD800 <= c < 0xE000 else c if c < 128 else 128 + c * 31 % 127 for c in range(1 << 16)], dtype=np.uint8)
    return _SYMBOLS


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, a gap (32) after each, and where each ends."""
    coded = [(t or "").lower().encode("utf-16-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) // 2 + 1 for c in coded])
    return symbol_table()[np.frombuffer(b" \0".join([*coded, b""]), dtype=np.uint16)], ends


def _rows(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row at each letter and word end, and its place."""
    gap = symbols == 32
    index = np.arange(len(symbols), dtype=np.int32)
    last_gap = np.maximum.accumulate(np.where(gap, index, np.int32(-1)))
    before = np.empty_like(last_gap)
    before[:1], before[1:] = -1, last_gap[:-1]
    place = index - before - 1  # in its word; 0 for a gap that follows no letter
    at = np.flatnonzero(~gap | (place > 0))
    row = np.zeros(len(at), dtype=np.uint64)
    for k in range(ORDER):
        row |= symbols[np.maximum(at - k, 0)].astype(np.uint64) << np.uint64(8 * k)
    held = np.minimum(place[at] + 1, ORDER).astype(np.uint64)
    row &= (np.uint64(1) << (held * np.uint64(8))) - np.uint64(1)
    return row.astype(np.int64), at


def rows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The row (up to ORDER symbols, the last one lowest) at each letter and word end of all texts, and the number in each text."""
    symbols, ends = _symbols(texts)
    row, at = _rows(symbols)
    return row, np.diff(np.searchsorted(at, ends), prepend=0)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of symbols; no hash is 0."""
    start, end, word = word_hashes(data)
    return start, end, np.where(word == 0, np.uint64(1), word).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column text -> (word, symbols, n), summed within a task as far as ``WORDS_HELD`` different words go."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        word = _words(b" ".join([*held, b""]))[2]
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "symbols", "n"])

    for batch in pieces(batches, "text", 1_000_000):
        held.update(_symbols(batch.column(0).to_pylist())[0].tobytes().split())
        if len(held) > WORDS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, symbols) -> (word, row), one for each row of the word."""
    for batch in pieces(batches, "symbols", 1_000_000):
        words = batch.column(1).to_pylist()
        rows, at = _rows(np.frombuffer(b" ".join([*words, b""]), dtype=np.uint8))
        counts = np.diff(np.searchsorted(at, np.cumsum([len(w) + 1 for w in words])), prepend=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(rows)], ["word", "row"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, grp (fold of two, then class) -> (row, grp, n), summed within a task as far as ``HELD`` different rows go."""
    held, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held >> 2), pa.array((held & 3).astype(np.int32)), pa.array(times)], ["row", "grp", "n"])

    for batch in pieces(batches, "text", 1_000_000):
        rows, counts = rows_of(batch.column(0).to_pylist())
        key, n = np.unique((rows << 2) | np.repeat(batch.column(1).to_numpy().astype(np.int64), counts), return_counts=True)
        held, place = np.unique(np.concatenate([held, key]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([times, n])).astype(np.int64)
        if len(held) > HELD:
            yield out()
            held, times = held[:0], times[:0]
    if len(held):
        yield out()


def count_rows(labelled: DataFrame) -> DataFrame:
    """(row, a0, a1, b0, b1): counts by fold (a, b) and class (0 ordinary, 1 toxic), over all labelled documents."""
    counted = labelled.select("text", (F.col("fold") * 2 + F.col("label")).cast("int").alias("grp")).mapInArrow(_count_rows, "row long, grp int, n long")
    return counted.groupBy("row").agg(*[F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(name) for g, name in enumerate(("a0", "a1", "b0", "b1"))])


def _end(row: Column, symbols: int) -> Column:
    return row.bitwiseAND(F.lit((1 << (8 * symbols)) - 1))


def shared_chances(rows: DataFrame) -> DataFrame:
    """rows: row, each one once -> (end, shared), a written table: P(w | h) of all different ends, of ``SHARED[0]`` symbols, that rows have.

    It depends on the end alone, so ends meet their contexts and not the rows. Each level is written: a plan of all of them at once is
    planned anew after each of its stages, which takes memory of the driver.
    """
    longer, levels = rows, []
    for m in SHARED:
        kinds = materialize(longer.groupBy(_end(F.col("row"), m).alias("row")).agg(F.count(F.lit(1)).alias("k")), "toxic-kinds")
        around = kinds.groupBy(F.shiftright("row", 8).alias("context")).agg(F.sum("k").alias("s"), F.count(F.lit(1)).alias("t"))
        levels.append(kinds.withColumn("context", F.shiftright("row", 8)).join(_sent_if_short(around, m - 1), "context"))
        longer = kinds.select("row")
    own, rest = F.greatest(F.col("k") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("s"), F.lit(SHARED_DISCOUNT) * F.col("t") / F.col("s")
    shared = levels[-1].select(F.col("row").alias("end"), (own + rest * F.lit(1.0 / 256)).alias("shared"))
    for level, m in zip(levels[-2::-1], SHARED[:0:-1]):
        shorter = _sent_if_short(materialize(shared, "toxic-shared"), m)
        shared = level.withColumn("end", _end(F.col("row"), m)).join(shorter, "end").select(F.col("row").alias("end"), (own + rest * F.col("shared")).alias("shared"))
    return materialize(shared, "toxic-shared")


def _sent_if_short(table: DataFrame, symbols: int) -> DataFrame:
    """A table with a line for each of some rows of so many symbols; for two symbols there are 65,536 at most, which are broadcast."""
    return F.broadcast(table) if symbols <= 2 else table


def differences(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts: row, n0, n1 -> (row, n, value, whether above D in a class) and (context, n, value) as the module's text says."""
    totals = counts.agg(F.sum("n0"), F.sum("n1")).first()
    scale = [float((totals[1] or 0) / max(totals[0] or 0, 1)), 1.0]
    seen = counts.where("n0 + n1 > 0").withColumn("context", F.shiftright("row", 8)).withColumn("n", F.col("n0") + F.col("n1"))
    seen = seen.withColumns({f"n{c}": F.col(f"n{c}") * scale[c] for c in (0, 1)})
    least = [F.least(F.col(f"n{c}"), F.lit(DISCOUNT)) for c in (0, 1)]
    by_context = seen.groupBy("context").agg(F.sum("n").alias("s"), *[F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)], *[F.sum(least[c]).alias(f"m{c}") for c in (0, 1)])
    back = [F.when(F.col(f"s{c}") > 0, F.col(f"m{c}") / F.col(f"s{c}")).otherwise(F.lit(1.0)) for c in (0, 1)]
    frame = seen.join(by_context, "context").withColumn("end", _end(F.col("row"), SHARED[0])).join(shared_chances(seen.select("row")), "end")
    p = [F.when(F.col(f"s{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{c}")).otherwise(F.lit(0.0)) + back[c] * F.col("shared") for c in (0, 1)]
    above = F.greatest("n0", "n1") > DISCOUNT
    rows = frame.select("row", "n", (F.log(p[1]) - F.log(p[0])).alias("value"), above.alias("above"))
    contexts = by_context.select(F.col("context").alias("row"), F.col("s").alias("n"), (F.log(back[1]) - F.log(back[0])).alias("value"))
    return rows, contexts


class Table:
    """Long -> number by open addressing in plain arrays, looked up for whole arrays at once; 0 for what it does not hold. No key is 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=np.int64), np.zeros(1 << self.bits, dtype=values.dtype)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left = left[~put]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether held)."""
        home = self._slot(keys, 0)
        values, held = np.zeros(len(keys), dtype=self.values.dtype), np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            slot = (home[left] + probe) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            values[left[hit]], held[left[hit]] = self.values[slot[hit]], True
            left = left[~hit & (there != 0)]
            if not len(left):
                break
        return values, held


def features(sums: np.ndarray) -> np.ndarray:
    """What the curve reads, one line for each text, from its sums as ``compare`` gives them."""
    symbols, words, total, *above = sums.T
    return np.stack([np.ones(len(sums)), total / np.maximum(symbols, 1), np.log1p(words), *map(np.log1p, above), *(x / (words + 5) for x in above)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps, on scaled columns."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (y - p) - ridge * beta)
        beta = beta + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _model(counts: DataFrame, folds: str) -> tuple[DataFrame, DataFrame]:
    """(row, units) and (row, units) of contexts, of the given folds: all whose value is not another's."""
    summed = counts.select("row", *[sum(F.col(f"{f}{c}") for f in folds).alias(f"n{c}") for c in (0, 1)])
    rows, contexts = differences(summed)
    units = F.round(F.col("value") * UNITS).cast("int").alias("units")
    return materialize(rows.where("above").select("row", units), "toxic-values"), materialize(contexts.select("row", units).where("units <> 0"), "toxic-values")


def word_values(texts: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(word, n, value): each different word of the texts, how often it occurs, and the sum of its rows' values."""
    counted = texts.select("text").mapInArrow(_count_words, "word long, symbols binary, n long")
    words = materialize(counted.groupBy("word").agg(F.first("symbols").alias("symbols"), F.sum("n").alias("n")), "toxic-words")
    spread = words.select("word", "symbols").mapInArrow(_word_rows, "word long, row long")
    rows, contexts = (m.withColumnsRenamed({"row": k, "units": u}) for m, k, u in zip(model, ("row", "context"), ("own", "back")))
    # Different rows meet the contexts, not all rows: most words share their first ones.
    kinds = spread.select("row").distinct().join(rows, "row", "left").withColumn("context", F.shiftright("row", 8)).join(contexts, "context", "left")
    valued = kinds.select("row", F.coalesce("own", "back").alias("units")).where("units <> 0")
    sums = spread.join(valued, "row").groupBy("word").agg((F.sum("units") / UNITS).cast("float").alias("value"))
    out = materialize(words.select("word", "n").join(sums, "word", "left").withColumn("value", F.coalesce("value", F.lit(0.0).cast("float"))), "toxic-words")
    drop(words)
    return out


def _most_frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and values of the ``ROWS`` most frequent words at most."""
    words = words.withColumn("level", F.floor(F.log2("n") * 64).cast("int"))
    # The least count whose words still fit, from one number for each of some thousand levels; nothing is sorted.
    total, least = 0, 1 << 20
    for level, n in sorted(map(tuple, words.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > ROWS:
            break
        least = level
    got = words.where(F.col("level") >= least).select("word", "value").toArrow()
    return got["word"].to_numpy().astype(np.int64), got["value"].to_numpy().astype(np.float32)


def _model_table(model: tuple[DataFrame, DataFrame]) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys (a row doubled, a context doubled and one more) and units of a model of at most ``SENT`` rows and contexts; None for a larger one."""
    rows, contexts = model
    if rows.count() + contexts.count() > SENT:
        return None
    got = rows.select((F.col("row") * 2).alias("key"), "units").union(contexts.select((F.col("row") * 2 + 1).alias("key"), "units")).toArrow()
    return got["key"].to_numpy().astype(np.int64), got["units"].to_numpy().astype(np.int32)


def _values_of(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, model: Table) -> np.ndarray:
    """The value of each word of a slice of texts; each different one is looked up once."""
    _, first, which = np.unique(word, return_index=True, return_inverse=True)
    n = end[first] - start[first] + 1  # with the gap behind it
    rows, _ = _rows(symbols[np.repeat(start[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    units, held = model.find(rows << 1)
    other = np.flatnonzero(~held)
    units[other] = model.find((rows[other] >> 8 << 1) | 1)[0]
    sums = np.bincount(np.repeat(np.arange(len(first)), n), weights=units, minlength=len(first))
    return (sums / UNITS).astype(np.float32)[which]


def _text_sums(of: np.ndarray, n: int, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of n texts the numbers of symbols and words, and over its words the sum of values, how many exceed each level, and what exceeds the first level."""
    over = [value > level for level in LEVELS] + [np.maximum(value.astype(np.float64) - LEVELS[0], 0)]
    return np.stack([np.bincount(of, weights=w, minlength=n) for w in (length, np.ones(len(of)), value, *over)], axis=1).astype(np.float64)


def _chance(sums: np.ndarray, curve: np.ndarray) -> pa.Array:
    return pa.array(1 / (1 + np.exp(-np.clip(features(sums) @ curve, -30, 30))))


def _lists(sums: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32()), pa.array(sums.ravel()))


def compare(docs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The columns of docs but ``text``, the last, and ``sums`` as ``_text_sums`` has them."""
    table = _model_table(model)
    return _compare_by_join(docs, model) if table is None else _compare_in_place(docs, table)


def _compare_in_place(docs: DataFrame, table: tuple[np.ndarray, np.ndarray], curve: np.ndarray | None = None) -> DataFrame:
    """As ``compare``; with a curve, its score in place of the sums, in the same worker."""
    sent, names = docs.sparkSession.sparkContext.broadcast(table), docs.columns[:-1]
    last, kind = ("sums", T.ArrayType(T.DoubleType())) if curve is None else ("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Table(*sent.value)
        for batch in pieces(batches, "text", 1_000_000):
            symbols, ends = _symbols(batch.column(len(names)).to_pylist())
            start, end, word = _words(symbols.tobytes())
            value = _values_of(symbols, start, end, word, held) if len(word) else np.empty(0, dtype=np.float32)
            sums = _text_sums(np.searchsorted(ends, start, side="right"), batch.num_rows, end - start + 1, value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), _lists(sums) if curve is None else _chance(sums, curve)], [*names, last])

    return docs.mapInArrow(run, docs.drop("text").schema.add(last, kind))


def _compare_by_join(docs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    words = word_values(docs, model)
    sent = docs.sparkSession.sparkContext.broadcast(_most_frequent(words))
    names = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*sent.value)
        for batch in pieces(batches, "text", 1_000_000):
            symbols, ends = _symbols(batch.column(len(names)).to_pylist())
            start, end, word = _words(symbols.tobytes())
            n, of = batch.num_rows, np.searchsorted(ends, start, side="right")
            value, held = table.find(word)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of[~held], minlength=n))])
            others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(word[~held]))
            sums = _text_sums(of, n, end - start + 1, value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), _lists(sums), others], [*names, "sums", "others"])

    schema = docs.drop("text").schema.add("sums", T.ArrayType(T.DoubleType())).add("others", T.ArrayType(T.LongType()))
    here = materialize(docs.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id()), "toxic-sums")
    value = F.col("value").cast("double")
    more = [F.sum(value), *[F.sum((F.col("value") > level).cast("double")) for level in LEVELS], F.sum(F.greatest(value - LEVELS[0], F.lit(0.0)))]
    joined = here.select("key", F.explode("others").alias("word")).join(words.where("value <> 0").select("word", "value"), "word")
    added = joined.groupBy("key").agg(F.array(F.lit(0.0), F.lit(0.0), *more).alias("more"))
    sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    return materialize(here.drop("others").join(added, "key", "left").select(*names, sums.alias("sums")), "toxic-sums")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[tuple[np.ndarray, ...] | None, np.ndarray]:
    """The scoring tables and the curve, from all labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 3).cast("int").alias("fold")
    known = materialize(known.select("id", "label", fold), "toxic-labels")
    # Labels are sent to the texts as long as they are few enough to be held by every task; more than that are joined by a shuffle.
    few = known.count() <= LABELS_SENT
    labelled = rows.join(F.broadcast(known) if few else known, "id")
    shares = {r["fold"]: r for r in labelled.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    toxic, n = sum(r["toxic"] for r in shares.values()), sum(r["n"] for r in shares.values())
    flat = np.zeros(FEATURES)
    flat[0] = np.log((toxic + 0.1) / (n - toxic + 1.0))
    if not 0 < toxic < n:
        return None, flat
    counts = materialize(count_rows(labelled), "toxic-rows")
    both = _model(counts, "ab")
    if not all(r["n"] > r["toxic"] > 0 for r in shares.values()) or len(shares) < 2:
        flat[-1] = 10.0
        return both, flat
    first = _model(counts, "a")
    # Drawn from ids alone; CURVE_ROWS rows at most are sent to the texts.
    drawn = rows.select("id").join(F.broadcast(known) if few else known, "id").where("fold = 1").distinct().orderBy(F.xxhash64("id"), "id").limit(CURVE_ROWS)
    sample = rows.join(F.broadcast(drawn), "id").select("label", "text")
    scored = compare(sample, first).toPandas()
    return both, fit_curve(features(np.stack(scored["sums"].to_list())), scored["label"].to_numpy().astype(float))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, columns: list[Column]) -> DataFrame:
    """The given columns of docs and score."""
    with scratch() as kept:
        model, curve = fit(docs, labels, id_col, text_col, label_col)
        if model is None:
            return docs.select(*columns, F.lit(float(1 / (1 + np.exp(-curve[0])))).alias("score"))
        texts, table = docs.select(*columns, F.col(text_col).alias("text")), _model_table(model)
        if table is not None:
            return _compare_in_place(texts, table, curve)
        sums = kept.keep(_compare_by_join(texts, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.stack(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _chance(sums, curve)], [*batch.schema.names[:-1], "score"])

    return sums.mapInArrow(run, sums.drop("sums").schema.add("score", "double"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row for each document."""
    id_ = F.col(id_col)
    out = _scored(docs, labels, id_col, text_col, label_col, [id_.alias("id"), held_out(id_).alias("held_out")])
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents predicted toxic, which are told by two hashes of their texts."""
    own = private_prefix(docs.columns, "__tx_")
    hashes = [F.xxhash64(F.col(text_col)), F.xxhash64(F.lit("second"), F.col(text_col))]
    out = _scored(docs, labels, id_col, text_col, label_col, [h.alias(c) for h, c in zip(hashes, (f"{own}a", f"{own}b"))])
    toxic = materialize(out.where(F.col("score") >= threshold).select(f"{own}a", f"{own}b").distinct(), "toxic-texts")
    if toxic.count() <= LABELS_SENT:
        toxic = F.broadcast(toxic)
    return docs.join(toxic, (hashes[0] == F.col(f"{own}a")) & (hashes[1] == F.col(f"{own}b")), "left_anti")
