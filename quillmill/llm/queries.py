"""The queries opN_<name> and pipeline: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe, embedding_dedup, fingerprints, html_text, line_dedup, minhash_dedup, mixing, prefix_trie, quality, spelling, substring_dedup, toxicity, warc
from quillmill.llm.common import materialize, new_path, scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their text without repeats, and the documents where those first stand (null where nothing repeats)."""
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "repeat_spans", "first_ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines_seen", "n_lines_removed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say, read back; the archives go when that is written."""
    with scratch() as kept:
        folder = new_path(spark, "archives")
        warc.write_archives(table(spark, sf_dir, "pages"), folder)
        return kept.keep(materialize(warc.pages_read(spark, folder), "records"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_substring_dedup, op3_line_dedup, op4_toxicity, op5_mixing, op6_bpe, op7_html_extraction, op8_quality, op9_fingerprints, op10_minhash_dedup, op11_warc, op12_prefix_trie, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op11_warc": warc.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_spelling_variants": spelling.SQL}
