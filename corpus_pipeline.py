"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents, other ones than the usual too, whatever their names. An empty table gives an empty one in every stage; very
long texts are worked on whole. ``run`` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, line_dedup, minhash_dedup, mixing, toxicity
from quillmill.llm.common import drop, free_name, materialize, scratch, table
from quillmill.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator predicts toxic go.

    Null and empty texts get the score of a text without words; equal texts go or stay together; without labels nothing goes.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are taken out of the texts; a document of which no line is left goes.

    Null texts, empty ones and those of fewer than three lines stay as they are. n_chars, if there is such a column, is counted anew.
    """
    found = line_dedup.line_dedup(docs)
    left = found.where((F.col(free_name(docs.columns, "n_lines_removed")) == 0) | (F.trim("text") != "")).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least doc_id.

    Null and empty texts and those of white space are no copies of each other and all stay; rows repeated as a whole are one document.
    """
    return minhash_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as many times as the mix takes it.

    Null and empty texts have no words and stand once for each whole epoch of their source; a null source is one of its own, the last.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each document of the mix; null text is encoded as the empty one."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The toxicity model, ProbMinHash and BPE cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as kept:  # a stage's own tables go once its rows are written
            docs = kept.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop(before)
        before = docs
    return docs
