"""Aggregations over files, folders, formats and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions.paths import dirname, extension
from quillmill.operators.joins import assign_to_folders


def folder_stats(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, file_count, total_size) of each folder, nested folders counting in all above them."""
    counted = assign_to_folders(files, folders).groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    out = folders.select("path").join(counted.withColumnRenamed("folder_path", "path"), "path", "left")
    return out.select("path", F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("bytes", F.lit(0)).alias("total_size"))


def total_file_count(folders: DataFrame) -> DataFrame:
    """The sum of the folders' counts; files of nested folders count in each."""
    return folders.agg(F.sum(F.coalesce("file_count", F.lit(0))).alias("total_files"))


def extension_distribution(files: DataFrame) -> DataFrame:
    """(ext, n, total_size) by extension."""
    return files.groupBy(F.substr(extension(F.col("path")), F.lit(2)).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def format_support_summary(files: DataFrame, formats: DataFrame) -> DataFrame:
    """(status, n_formats, n_files, bytes): formats that are supported, unsupported, or without any file. formats: (ext, supported)."""
    joined = formats.join(extension_distribution(files), "ext", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("supported"), "supported").otherwise("unsupported")
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_formats"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("bytes"))


def files_by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(dirname(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(hash, n, wasted, first_id): groups of files with the same hash; all but the first are waste."""
    grouped = files.where("hash IS NOT NULL AND hash <> ''").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("id", "size")).alias("first"))
    return grouped.where("n > 1").select("hash", "n", (F.col("bytes") - F.col("first.size")).alias("wasted"), F.col("first.id").alias("first_id"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    """One row: processed, skipped, errors, bytes. scanned: (status, size)."""
    of = lambda s: F.count_if(F.col("status") == s)
    return scanned.agg(of("processed").alias("processed"), of("skipped").alias("skipped"), of("error").alias("errors"), F.coalesce(F.sum(F.when(F.col("status") == "processed", F.col("size"))), F.lit(0)).alias("bytes"))


def moving_avg_eta(durations: DataFrame, group: str, order: str, total: str, value: str = "ms", window: int = 20, least: int = 5) -> DataFrame:
    """durations with eta_s: the mean of the last ``window`` durations times what remains, in seconds; null until there are ``least``."""
    w = W.partitionBy(group).orderBy(order)
    last = w.rowsBetween(1 - window, 0)
    remaining = F.col(total) - F.row_number().over(w)
    eta = F.floor(F.avg(value).over(last) * remaining / 1000 + 0.5).cast("long")
    return durations.withColumn("eta_s", F.when(F.count(value).over(last) >= least, eta))
