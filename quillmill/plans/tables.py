"""The library's tables as views of the given ones, in Spark and as DuckDB text (for comparison)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.paths import file_type
from quillmill.sources.written import shared_folder  # noqa: F401

EXTENSIONS = ("txt", "md", "json", "csv", "html", "log", "pdf", "xyz")
FIRST_SECOND = 1_704_067_200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that comes in fewer pieces than there are cores (a file of one row group is one piece) is dealt out first; a large one is not."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("ext", ext).withColumn("name", F.concat(F.lit("doc_"), "doc_id", F.lit("."), "ext"))
    when = F.timestamp_seconds(FIRST_SECOND + F.col("doc_id") * 60)
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "name").alias("path"),
        "name",
        F.octet_length("text").cast("long").alias("size"),
        F.md5("text").alias("hash"),
        file_type(F.col("ext")).alias("file_type"),
        F.col("text").alias("content"),
        (F.col("ext") != "xyz").alias("is_supported"),
        when.alias("created_at"),
        when.alias("updated_at"),
    )


FILES = """files AS (
  SELECT doc_id AS id, '/' || source || '/' || lang || '/doc_' || doc_id || '.' || ext AS path, 'doc_' || doc_id || '.' || ext AS name,
         strlen(text)::BIGINT AS size, md5(text) AS hash,
         CASE WHEN ext IN ('txt', 'md', 'json', 'csv', 'log') THEN 'text' WHEN ext = 'html' THEN 'html' WHEN ext = 'pdf' THEN 'pdf' ELSE 'unsupported' END AS file_type,
         text AS content, ext <> 'xyz' AS is_supported, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated_at, ext, source, lang, doc_id
  FROM (SELECT *, (['txt', 'md', 'json', 'csv', 'html', 'log', 'pdf', 'xyz'])[doc_id % 8 + 1] AS ext FROM documents))"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, and the languages within them."""
    d = table(spark, sf_dir, "documents")
    one, two = F.concat(F.lit("/"), "source"), F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    return d.select(F.explode(F.array(one, two)).alias("path")).distinct()


def zipped(docs: DataFrame, ext: str) -> DataFrame:
    """(path, content): each document as the bytes of a zipped file, an office text with a paragraph for each line or an archive of two files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, text in zip(frame["doc_id"], frame["text"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    if ext == "odt":
                        z.writestr("content.xml", "".join(f"<text:p>{line}</text:p>" for line in (text or "").replace("<", "").split("\n")))
                    else:
                        z.writestr("a/one.txt", text or "")
                        z.writestr("two.md", f"document {id_}")
                out.append(held.getvalue())
            yield pd.DataFrame({"path": [f"/zipped/{i}.{ext}" for i in frame["doc_id"]], "content": out})

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


def id_of(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


FOLDERS = "folders AS (SELECT DISTINCT '/' || source AS path FROM documents UNION SELECT DISTINCT '/' || source || '/' || lang FROM documents)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    """events, as a batch or a stream, as file changes."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "renamed").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    path = lambda n: F.concat(F.lit("/u"), F.col("user_id"), F.lit("/f"), n % 50, F.lit(".txt"))
    return events.select(
        F.col("event_id").alias("seq"),
        kind.alias("event"),
        path(F.col("event_id")).alias("path"),
        F.when(kind == "renamed", path(F.col("event_id") + 1)).alias("old_path"),
        F.concat(F.lit("/u"), F.col("user_id")).alias("volume"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 10 == 0).alias("is_dir"),
    )


CHANGES = """changes AS (
  SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'renamed' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event,
         '/u' || user_id || '/f' || event_id % 50 || '.txt' AS path,
         CASE WHEN event_type = 'purchase' THEN '/u' || user_id || '/f' || (event_id + 1) % 50 || '.txt' END AS old_path,
         '/u' || user_id AS volume, ts, event_id % 10 = 0 AS is_dir
  FROM events)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_journal(table(spark, sf_dir, "events"))


def as_journal(events: DataFrame) -> DataFrame:
    """events, as a batch or a stream, as records of a change journal."""
    kinds = {"signup": 0x1000000, "error": 0x2000000, "purchase": 0x4000000, "view": 0x8000000, "click": 0x5}
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    return events.select(
        F.col("user_id").alias("file_id"),
        (F.col("user_id") % 10).alias("parent_id"),
        F.col("event_id").alias("usn"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) + 11_644_473_600_000_000) * 10).alias("filetime"),
        reason.cast("long").alias("reason"),
        F.when(F.col("event_id") % 10 == 0, 16).otherwise(0).cast("long").alias("attributes"),
        F.concat(F.lit("f"), F.col("event_id") % 50, F.lit(".txt")).alias("file_name"),
    )


JOURNAL = """journal AS (
  SELECT user_id AS file_id, user_id % 10 AS parent_id, event_id AS usn, (epoch_us(ts) + 11644473600000000) * 10 AS filetime,
         CASE event_type WHEN 'signup' THEN 16777216 WHEN 'error' THEN 33554432 WHEN 'purchase' THEN 67108864 WHEN 'view' THEN 134217728 WHEN 'click' THEN 5 END AS reason,
         CASE WHEN event_id % 10 = 0 THEN 16 ELSE 0 END AS attributes, 'f' || event_id % 50 || '.txt' AS file_name, ts
  FROM events)"""


def tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tags quality and toxic, and the files that carry them, out of the labels."""
    labels, paths = table(spark, sf_dir, "labels"), files(spark, sf_dir).select("id", "path")
    names = labels.select(F.explode(F.array(F.struct(F.lit(1).alias("id"), F.lit("quality").alias("name"), F.lit("green").alias("color")), F.struct(F.lit(2).alias("id"), F.lit("toxic").alias("name"), F.lit("red").alias("color")))).alias("t")).distinct().select("t.*")
    marked = labels.select(F.col("doc_id").alias("id"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 1, 2)))).alias("tag_id"))
    return names, marked.join(paths, "id").select(F.col("path").alias("file_path"), "tag_id")


TAGS = """tags AS (SELECT 1 AS id, 'quality' AS name, 'green' AS color UNION ALL SELECT 2, 'toxic', 'red'),
file_tags AS (SELECT f.path AS file_path, t.tag_id FROM (SELECT doc_id, 1 AS tag_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 1) t JOIN files f ON f.id = t.doc_id)"""


def words(spark: SparkSession, sf_dir: str, n: int, first: int = 1) -> DataFrame:
    """(query_id, query): n words of each benchmark passage, from the first-th on; none that is an operator of queries."""
    tokens = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: (w != "") & ~F.lower(w).isin("and", "or", "not"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tokens, first, n), " ").alias("query"))


def words_sql(n: int, first: int = 1) -> str:
    return rf"queries AS (SELECT item_id AS query_id, array_to_string(list_slice(list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda w: lower(w) NOT IN ('and', 'or', 'not')), {first}, {first + n - 1}), ' ') AS query FROM benchmark)"


#: Tokens of all fields of all files, without stems.
TOKENS = r"""tokens AS (
  SELECT id AS doc_id, field, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
    SELECT id, f.field AS field, regexp_extract_all(strip_accents(lower(f.text)), '[\p{L}\p{N}\p{Co}]+') AS t
    FROM (SELECT id, unnest([{'field': 'name', 'text': name}, {'field': 'content', 'text': content}, {'field': 'file_type', 'text': file_type}]) AS f FROM files)))"""
