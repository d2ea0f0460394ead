"""Files and bytes below every folder, kept by differences.

A batch of changes takes the former rows of the files it touches out of all folders above them and puts their new ones in; what is written for it is one small table of differences,
and nothing that it does not touch is counted again. Differences are summed when they are read, and merged by size as the segments of an index are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.paths import ancestors, normalized
from quillmill.plans.live_index import first_to_merge
from quillmill.sources.manifest import Manifest

COUNTS = "path string, file_count long, total_size long"


def _below(files: DataFrame, sign: int) -> DataFrame:
    """A file in each folder above it."""
    size: Column = F.coalesce(F.col("size"), F.lit(0))
    return files.select(F.explode(ancestors(F.col("path"))).alias("path"), F.lit(sign).cast("long").alias("file_count"), (sign * size).cast("long").alias("total_size"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.sum("file_count").alias("file_count"), F.sum("total_size").alias("total_size"))


def count_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, file_count, total_size): what the folders gain, or lose, when the files of ``before`` become those of ``after``; folders that stay as they are go."""
    return _summed(_below(before, -1).unionByName(_below(after, 1))).where("file_count <> 0 OR total_size <> 0")


class FolderCounts:
    """Counts in a folder. State: the last batch and the tables of differences from old to new. A batch that comes again is skipped, one that breaks off leaves the former state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.held = spark, Manifest(spark, folder)
        self.folder = self.held.folder

    def create(self, files: DataFrame, batch: int = -1) -> None:
        self.held.put({"batch": batch, "segments": [self._segment(_summed(_below(files, 1)))]})
        self._sweep()

    def _segment(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex[:12]
        rows.write.parquet(f"{self.folder}/counts/{name}")
        return {"name": name, "rows": self.spark.read.schema(COUNTS).parquet(f"{self.folder}/counts/{name}").count()}

    def _sweep(self) -> None:
        self.held.sweep("counts", lambda state: [s["name"] for s in state["segments"]])

    def update(self, before: DataFrame, after: DataFrame, batch: int) -> None:
        """One batch: the files it touched as they were and as they are (path and size)."""
        state = self.held.state()
        if batch <= state["batch"]:
            return
        self.held.put({"batch": batch, "segments": [*state["segments"], self._segment(count_differences(before, after))]})
        self._sweep()
        while (first := first_to_merge(self.held.state()["segments"])) is not None:
            self.merge(first)

    def _read(self, segments: list[dict]) -> DataFrame:
        return _summed(self.spark.read.schema(COUNTS).parquet(*[f"{self.folder}/counts/{s['name']}" for s in segments])).where("file_count <> 0 OR total_size <> 0")

    def merge(self, first: int = 0) -> None:
        """The tables from ``first`` on as one."""
        state = self.held.state()
        kept, merged = state["segments"][:first], state["segments"][first:]
        self.held.put(state | {"segments": [*kept, self._segment(self._read(merged))]})
        self._sweep()

    def read(self) -> DataFrame:
        """(path, file_count, total_size) of all folders with files below them."""
        return self._read(self.held.state()["segments"])

    def of(self, folders: DataFrame) -> DataFrame:
        """The counts of the given folders, as ``folder_stats`` gives them."""
        wanted = folders.select("path", F.regexp_replace(normalized(F.col("path")), "/+$", "").alias("__dir"))
        found = wanted.join(self.read().withColumnRenamed("path", "__dir"), "__dir", "left")
        return found.select("path", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("total_size", F.lit(0)).alias("total_size"))
