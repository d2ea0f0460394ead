"""Files, text, change events and index shards as DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.functions.extract import PLAIN


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of every file below a folder; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def read_modified_since(spark: SparkSession, folder: str, since: datetime) -> DataFrame:
    """The files changed after a time; older ones are never opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S")).load(folder)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the plain-text types, UTF-8, one row for each file; .gz files are unpacked."""
    wanted = "{" + ",".join([*PLAIN, *(f"{e}.gz" for e in PLAIN)]) + "}"
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{wanted}")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def change_events(lines: DataFrame) -> DataFrame:
    """The table of change events out of parsed lines; lines that are no change events go."""
    return lines.where("event IS NOT NULL AND path IS NOT NULL").select(
        "event", "path", F.col("oldPath").alias("old_path"), "volume", F.timestamp_millis("timestamp").alias("ts"), F.coalesce("isDirectory", F.lit(False)).alias("is_dir")
    )


def read_change_feed(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """JSON lines of change events, as a stream or a batch."""
    reader = spark.readStream if stream else spark.read
    return change_events(reader.schema(schemas.CHANGE_LINES).json(folder))


def read_shards(spark: SparkSession, folders: list[str]) -> DataFrame:
    """All slices of the files table as one; a slice may lack newer columns."""
    slices = [spark.read.schema(schemas.FILES).parquet(f) for f in folders]
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
