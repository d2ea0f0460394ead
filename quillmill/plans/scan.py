"""The scan of a folder as one job: list, filter, hash and extract, upsert, index, count by folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.containers import file_text
from quillmill.functions.paths import normalized
from quillmill.operators import filters, maintain
from quillmill.plans.search import Index
from quillmill.sources import readers
from quillmill.sources.written import scratch, written


def listed(files: DataFrame) -> DataFrame:
    """(path, size, modified) of files as the binary reader gives them, their paths without a scheme; no content is read."""
    path = normalized(F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", ""))
    return files.select(path.alias("path"), F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def to_read(files: DataFrame, known: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Of listed files those that are to be read: neither hidden nor of the system nor skipped by a rule, of a supported kind, and new,
    of another size or changed since they were read."""
    out = filters.filter_supported(filters.with_file_fields(filters.filter_hidden_system(files)))
    if rules is not None:
        out = filters.apply_skip_rules(out, rules)
    before = known.select("path", F.col("size").alias("__size"), F.col("updated_at").alias("__read"))
    seen = out.join(before, "path", "left")
    return seen.where(F.col("__read").isNull() | (F.col("modified") > F.col("__read")) | ~F.col("size").eqNullSafe(F.col("__size"))).drop("__size", "__read")


#: Files to be read whose paths are given to the reader one by one; of more, most of the folder is new and is read as a whole.
NAMED = 50_000


def opened(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted's columns, text, hash) of the wanted ones of files, their content read once: text and hash come out of the same row.

    files: (path, length, content), which may be all of a folder; only rows, not contents, are sent for the join as long as few are wanted.
    """
    about = wanted.withColumnRenamed("source", "__source")
    few = F.broadcast(about) if wanted.count() <= NAMED else about
    rows = files.select("path", "length", "content").withColumnRenamed("path", "__file").join(few, F.col("__file") == F.col("__source"))
    return rows.select(*wanted.drop("source").columns, file_text(F.col("path"), F.col("content")).alias("text"), filters.content_hash(F.col("content"), F.col("length")).alias("hash"))


def scan_rows(files: DataFrame, known: DataFrame, now: Column, rules: DataFrame | None = None, root: str | None = None, folder: str | None = None) -> DataFrame:
    """The files table after a scan. files: (path, modificationTime, length, content); known: the table before it.

    What is to be read is found without any content, and written; the content of those files alone is read, once. ``folder``: where files come from; if few are to be read, it
    is read again by their names, so that no other file is opened. ``root``: known files below it that are no longer there go; without it they stay, as a watcher or a
    comparison of snapshots removes them.
    """
    here = listed(files)
    wanted = written(to_read(here, known, rules), "to-read")
    if folder is not None and (n := wanted.count()) <= NAMED:
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["source"]) for r in wanted.select("source").collect()]
        files = files.sparkSession.read.format("binaryFile").load(names) if n else files.limit(0)
    batch = opened(files, wanted).withColumn("content", filters.limited_content(F.col("text"), F.col("size"), F.col("ext")))
    batch = written(batch.withColumn("seq", F.lit(1)), "scanned")
    if root is not None:
        below = F.startswith("path", F.lit(root.rstrip("/") + "/"))
        gone = known.where(below).select("id", "path").join(here.select("path"), "path", "left_anti").select("id")
        known = known.join(gone, "id", "left_anti")
    return maintain.upsert_files(known, batch, now)


def scan(folder: str, known: DataFrame, out: str, now: Column, rules: DataFrame | None = None, folders: DataFrame | None = None) -> Index:
    """Scan a folder of files into ``out``: the files table, its index, and the counts of the given folders. Files that are no longer there go."""
    spark = known.sparkSession
    files = readers.read_files(spark, folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    with scratch():
        scan_rows(files, known, now, rules, root, folder).write.parquet(f"{out}/files")
    files = spark.read.schema(known.schema).parquet(f"{out}/files")
    if folders is not None:
        maintain.upsert_folder_stats(folders, files, now).write.parquet(f"{out}/folders")
    return Index.build(files, f"{out}/index")
