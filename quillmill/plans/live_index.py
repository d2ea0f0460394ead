"""An index that follows its files: a base, smaller segments for each batch of changes, and merges by size.

A batch writes a segment: the postings, vocabulary and lengths of the files it adds or changes, and the ids of those it changes or deletes. Postings
of a file in segments before the last one that names it do not count; a search drops them from what its words have met, so no segment is rewritten. Vocabularies add up with
signs: a segment's has the counts of the new texts minus those of the former ones. Segments of about the same size are merged as soon as there are ``FAN``
of them in a row, so that an index has a number of segments in the order of the logarithm of its size, and a posting is rewritten as often.

All segments share the bounds of the base's parts, so that a search opens the same parts in each of them. A batch that comes again is skipped; one that breaks off leaves the former state.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.operators.index import build_postings, doc_stats, term_stats
from quillmill.plans.search import Index
from quillmill.sources.manifest import Manifest
from quillmill.sources.writers import PART_ROWS, drawn_bounds, write_index

FAN = 4
#: Ids of changed files that are sent to all tasks; more are joined.
SENT = 1_000_000
_GONE = "doc_id long"


def first_to_merge(segments: list[dict]) -> int | None:
    """From which segment on those at the end are to be one: there are ``FAN`` and more that are not above the last one's tier; None if there are not."""
    tier = lambda s: int(math.log(max(s["rows"], 1), FAN))
    last = [k for k in range(len(segments)) if all(tier(s) <= tier(segments[-1]) for s in segments[k:])]
    return last[0] if last and len(segments) - last[0] >= FAN else None


class LiveIndex:
    """An index in a folder. State: the last batch and the segments from old to new, each with its folder, postings, changed ids and first batch."""

    def __init__(self, spark: SparkSession, folder: str, stems: bool = False):
        self.spark, self.stems, self.held = spark, stems, Manifest(spark, folder)
        self.folder = self.held.folder

    def _at(self, name: str, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{name}/{table}")

    def create(self, files: DataFrame, part_rows: int = PART_ROWS, batch: int = -1) -> None:
        """The base, of all files."""
        name = f"base-{uuid.uuid4().hex[:8]}"
        at = f"{self.folder}/segments/{name}"
        bounds = drawn_bounds(files, lambda some: build_postings(some, stems=self.stems), part_rows)
        write_index(None, build_postings(files, stems=self.stems), doc_stats(files), at, part_rows, bounds)
        self.spark.createDataFrame([], _GONE).write.parquet(f"{at}/gone")
        bounds = sorted(r["bound"] for r in self.spark.read.schema("bound string").parquet(f"{at}/bounds").collect())
        self.held.put({"batch": batch, "bounds": bounds, "segments": [self._segment(name)]})
        self._sweep()

    def _segment(self, name: str) -> dict:
        rows = self._at(name, "postings", schemas.POSTINGS_IN_PARTS).count()
        return {"name": name, "rows": rows, "gone": self._at(name, "gone", _GONE).count()}

    def _sweep(self) -> None:
        self.held.sweep("segments", lambda state: [s["name"] for s in state["segments"]])

    def update(self, before: DataFrame, after: DataFrame, batch: int) -> None:
        """One batch. before: the changed and deleted files as they were indexed; after: the added and changed ones as they are now (id and text fields)."""
        state = self.held.state()
        if batch <= state["batch"]:
            return
        name = f"batch{batch}-{uuid.uuid4().hex[:8]}"
        at = f"{self.folder}/segments/{name}"
        write_index(None, build_postings(after, stems=self.stems), doc_stats(after), at, bounds=state["bounds"])
        less = term_stats(build_postings(before, stems=self.stems)).select("term", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_occurrences")).alias("n_occurrences"))
        less.write.mode("append").parquet(f"{at}/vocabulary")
        before.select(F.col("id").alias("doc_id")).union(after.select("id")).distinct().write.parquet(f"{at}/gone")
        state["segments"].append(self._segment(name))
        self.held.put(state | {"batch": batch})
        self._sweep()
        self._merge_if_due()

    def _merge_if_due(self) -> None:
        while (first := first_to_merge(self.held.state()["segments"])) is not None:
            self.merge(first)

    def merge(self, first: int = 0) -> None:
        """The segments from ``first`` on as one. With the base among them no changed ids are left."""
        state = self.held.state()
        merged, name = state["segments"][first:], f"merged-{uuid.uuid4().hex[:8]}"
        at = f"{self.folder}/segments/{name}"
        some = self._rows(merged)
        postings, stats, vocabulary, gone = (some[k] for k in ("postings", "doc_stats", "vocabulary", "gone"))
        alive = self._alive(postings, gone).drop("segment")
        alive.hint("rebalance", "part").sortWithinPartitions("part", "term", "doc_id").write.partitionBy("part").parquet(f"{at}/postings")
        self._alive(stats, gone).drop("segment").write.parquet(f"{at}/doc_stats")
        vocabulary.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences")).where("n_docs <> 0 OR n_occurrences <> 0").write.parquet(f"{at}/vocabulary")
        (gone.select("doc_id") if first else gone.select("doc_id").limit(0)).write.parquet(f"{at}/gone")
        self.held.put(state | {"segments": [*state["segments"][:first], self._segment(name)]})
        self._sweep()

    def _rows(self, segments: list[dict]) -> dict[str, DataFrame]:
        """The tables of some segments as one, rows with their segment's number; gone: the last segment that names a file."""
        kinds = {"postings": schemas.POSTINGS_IN_PARTS, "doc_stats": schemas.DOC_STATS, "vocabulary": schemas.VOCABULARY, "gone": _GONE}
        out = {}
        for kind, schema in kinds.items():
            for k, s in enumerate(segments):
                rows = self._at(s["name"], kind, schema).withColumn("segment", F.lit(k))
                out[kind] = out[kind].unionByName(rows) if kind in out else rows
        out["gone"] = out["gone"].groupBy("doc_id").agg(F.max("segment").alias("gone"))
        if sum(s["gone"] for s in segments) <= SENT:
            out["gone"] = F.broadcast(out["gone"])
        return out

    @staticmethod
    def _alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone, (rows["doc_id"] == gone["doc_id"]) & (rows["segment"] < gone["gone"]), "left_anti")

    def read(self, files: DataFrame) -> Index:
        """The index as it is now; files: the table that it is of."""
        state = self.held.state()
        some = self._rows(state["segments"])
        vocabulary = some["vocabulary"].groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences")).where("n_docs > 0")
        changed = any(s["gone"] for s in state["segments"])
        return Index(files, some["postings"], self._alive(some["doc_stats"], some["gone"]).drop("segment"), vocabulary, self.stems, state["bounds"], some["gone"] if changed else None)
