"""Tokens, stems, postings and the statistics that ranking needs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Latin letters with marks, each with the letter it is folded to: those that lower() leaves of Latin-1 and Latin Extended-A.
_FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
FIELDS = ("name", "content", "file_type")


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, marks folded; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.lower(text), _FOLDED, _PLAIN), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def spaced(text: Column) -> Column:
    """The same tokens as one text, with a space between them; empty for null."""
    return F.coalesce(F.regexp_replace(F.translate(F.lower(text), _FOLDED, _PLAIN), r"[^\p{L}\p{N}\p{Co}]+", " "), F.lit(""))


def porter_stem(word: str) -> str:
    """M. F. Porter's suffix stripping, 1980, as published."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word

    def cons(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and cons(w, i - 1))

    def measure(w: str) -> int:
        kinds = [cons(w, i) for i in range(len(w))]
        return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)

    vowel = lambda w: any(not cons(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, table: list[tuple[str, str]], least: int) -> str:
        for end, new in table:
            if w.endswith(end):
                return w[: -len(end)] + new if measure(w[: -len(end)]) > least else w
        return w

    w = swap_s(word)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, STEP_2, 0)
    w = swap(w, STEP_3, 0)
    for end in STEP_4:
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or measure(base) == 1 and not cvc(base):
            w = base
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def swap_s(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


# The published suffix tables.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def stem_terms(vocabulary: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) for each different term; join it back on the term, so that each word is stemmed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"term": frame["term"], "stem": [porter_stem(t) for t in frame["term"]]})

    return vocabulary.select(F.col(term_col).alias("term")).where("term IS NOT NULL").distinct().mapInPandas(run, "term string, stem string")


def build_postings(files: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS, stems: bool = False) -> DataFrame:
    """(term, doc_id, field, tf, positions, lead): one row for each term of each field of each file; lead marks the first one of a file's term.

    A file's tokens are gathered in a Python worker, out of texts that Spark has folded and cut: nothing is shuffled, and no group grows with the corpus.
    """
    if stems:
        return _stemmed_postings(files, id_col, fields)
    rows = files.select(F.col(id_col).alias("doc_id"), F.array(*[spaced(F.col(f)) for f in fields]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _Rows(batch.schema.field("doc_id").type, fields)
            for doc, texts in zip(batch.column("doc_id").to_pylist(), batch.column("texts")):
                held.add(doc, texts.as_py())
                if len(held.terms) >= ROWS:
                    yield held.batch()
            yield held.batch()

    return rows.mapInArrow(run, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, field string, tf int, positions array<int>, lead boolean")


#: Postings of a batch that a worker hands over.
ROWS = 100_000


class _Rows:
    """Postings, gathered for a batch."""

    def __init__(self, kind: pa.DataType, fields: tuple[str, ...]):
        self.kind, self.fields = kind, fields
        self._new()

    def _new(self) -> None:
        self.terms: list[str] = []
        self.docs, self.of, self.ends, self.positions, self.leads = [], [], [0], [], []

    def add(self, doc: object, texts: Sequence[str]) -> None:
        before: set[str] = set()
        for k, text in enumerate(texts):
            found: dict[str, list[int]] = {}
            for at, token in enumerate(text.split()):
                if token in found:
                    found[token].append(at)
                else:
                    found[token] = [at]
            self.terms += found
            self.docs += [doc] * len(found)
            self.of += [k] * len(found)
            self.leads += [t not in before for t in found] if before else [True] * len(found)
            for places in found.values():
                self.positions += places
                self.ends.append(len(self.positions))
            before.update(found)

    def batch(self) -> pa.RecordBatch:
        ends = np.array(self.ends, dtype=np.int32)
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(self.positions, dtype=np.int32)))
        field = pa.array(self.fields, pa.string()).take(pa.array(self.of, pa.int32()))
        columns = [pa.array(self.terms, pa.string()), pa.array(self.docs, self.kind), field, pa.array(np.diff(ends)), positions, pa.array(self.leads, pa.bool_())]
        self._new()
        return pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "field", "tf", "positions", "lead"])


def _stemmed_postings(files: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """The same of stems: rows of words are joined with the stems of the different words and grouped again."""
    plain = build_postings(files, id_col, fields)
    rows = plain.join(stem_terms(plain), "term").groupBy("stem", "doc_id", "field").agg(F.sum("tf").cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    # The least field's row leads; a file has as many rows of a term as fields at most.
    least = F.min("field").over(W.partitionBy("stem", "doc_id"))
    return rows.select(F.col("stem").alias("term"), "doc_id", "field", "tf", "positions", (F.col("field") == least).alias("lead"))


def doc_stats(files: DataFrame, id_col: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, n_tokens) over all indexed fields; no shuffle."""
    return files.select(F.col(id_col).alias("doc_id"), n_tokens(fields).alias("n_tokens"))


def n_tokens(fields: tuple[str, ...] = FIELDS) -> Column:
    """Tokens of all fields; folding marks, a letter for a letter, changes no number of them."""
    return sum(F.coalesce(F.regexp_count(F.lower(F.col(f)), F.lit(TOKEN)), F.lit(0)) for f in fields).cast("long")


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, n_docs, n_occurrences): how many files hold the term in any field; this is the vocabulary of an index."""
    return postings.groupBy("term").agg(F.count_if("lead").alias("n_docs"), F.sum("tf").alias("n_occurrences"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, avg_tokens."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_tokens"))
