"""A feed of file changes: cleaning, pending updates, renames, counts, and folding into the files table.

Every streaming operator works on a batch as well, where it gives what the stream gives once all windows are closed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from quillmill.functions.journal import map_dir_event
from quillmill.functions.paths import ancestors, basename
from quillmill.operators import maintain
from quillmill.operators.joins import filter_monitored_roots
from quillmill.sources.manifest import Manifest
from quillmill.sources.written import scratch, written

FLUSH = "15 minutes"
LATE = "10 minutes"


def stream_changes(changes: DataFrame, roots: DataFrame | None = None, late: str = LATE) -> DataFrame:
    """Typed events under the watched roots, directory events renamed, with a watermark: later rows are dropped, no other ones."""
    out = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    if out.isStreaming:
        out = out.withWatermark("ts", late)
    if roots is not None:
        out = filter_monitored_roots(out, roots)
    return out.withColumn("event", map_dir_event(F.col("event"), F.col("is_dir")))


def dedup_pending(changes: DataFrame, flush: str = FLUSH) -> DataFrame:
    """(start, path, n): one pending update of each path in each flush interval, with the number of its events."""
    grouped = changes.groupBy(F.window("ts", flush).alias("w"), "path").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "path", "n")


def pending_state(changes: DataFrame, flush: str = FLUSH) -> DataFrame:
    """(start, path, event): paths to read anew after each interval: the last event of each, without the deleted ones.

    A rename deletes its old path and creates its new one. Events of one instant count in the order deleted, then others.
    """
    plain = changes.select("ts", "path", F.when(F.col("event") == "renamed", "created").otherwise(F.col("event")).alias("event"))
    old = changes.where("event = 'renamed' AND old_path IS NOT NULL").select("ts", F.col("old_path").alias("path"), F.lit("deleted").alias("event"))
    both = plain.unionByName(old)
    order = F.struct("ts", (F.col("event") != "deleted").alias("later"), "event")
    last = both.groupBy(F.window("ts", flush).alias("w"), "path").agg(F.max_by("event", order).alias("event"))
    return last.where("event <> 'deleted'").select(F.col("w.start").alias("start"), "path", "event")


def pair_renames(records: DataFrame, within: str = "1 minute") -> DataFrame:
    """(file_id, ts, path, old_path): each new name with the last old name of its file id before it; null if there is none.

    records: (file_id, seq, ts, event, path) with event rename_old or rename_new, as a batch.
    """
    by_file = W.partitionBy("file_id").orderBy("seq")
    old = F.when(F.col("event") == "rename_old", F.struct("path", "ts"))
    before = F.last(old, ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, -1))
    paired = records.withColumn("__old", before).where("event = 'rename_new'")
    near = F.col("__old.ts") >= F.col("ts") - F.expr(f"INTERVAL {within}")
    return paired.select("file_id", "ts", "path", F.when(near, F.col("__old.path")).alias("old_path"))


def pair_renames_stream(old: DataFrame, new: DataFrame, within: str = "1 minute") -> DataFrame:
    """The same for streams with watermarks: a left outer join on the file id within a time bound, so that its state expires."""
    o = old.select(F.col("file_id").alias("o_id"), F.col("ts").alias("o_ts"), F.col("path").alias("old_path"))
    bound = F.expr(f"file_id = o_id AND o_ts <= ts AND o_ts >= ts - INTERVAL {within}")
    return new.join(o, bound, "left_outer").select("file_id", "ts", "path", "old_path")


def windowed_event_counts(changes: DataFrame, flush: str = FLUSH) -> DataFrame:
    grouped = changes.groupBy(F.window("ts", flush).alias("w"), "event").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "event", "n")


def debounce_queries(log: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(user_id, start, query, n): the last query of each burst of a user."""
    burst = log.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.max_by("query", F.struct("ts", "query")).alias("query"), F.count(F.lit(1)).alias("n"))
    return burst.select("user_id", F.col("w.start").alias("start"), "query", "n")


def late_data(changes: DataFrame, late: str = LATE) -> DataFrame:
    """(start, n_late): by batch, how many events of each interval arrive behind the watermark of all events before them.

    seq is the order of arrival. The running maximum is taken by blocks of arrivals, so that no task sees the whole feed.
    """
    block = F.floor(F.col("seq") / 10_000)
    tops = changes.groupBy(block.alias("block")).agg(F.max("ts").alias("top"))
    before = tops.withColumn("before", F.max("top").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("block", "before")
    inside = W.partitionBy("block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    seen = changes.withColumn("block", block).join(before, "block").withColumn("seen", F.greatest("before", F.max("ts").over(inside)))
    behind = F.col("ts") < F.col("seen") - F.expr(f"INTERVAL {late}")
    return seen.groupBy(F.window("ts", "1 day").start.alias("start")).agg(F.count_if(behind).alias("n_late"))


def event_order(changes: DataFrame) -> Column:
    """The order of events: by time, then seq where there is one; of one instant deletions first, then by what they say."""
    parts = ["seq"] if "seq" in changes.columns else []
    return F.struct("ts", *parts, (~F.startswith("event", F.lit("deleted"))).alias("later"), "event", "path", "old_path")


def _touches(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What events do to the files they meet: (path, at, to) to one file, (dir, at, to) to all below a folder, both with to = null for
    its end, and (path, at): files that were created, modified or moved there."""
    e = changes.withColumn("at", event_order(changes))
    moved = e.where("event = 'renamed' AND old_path IS NOT NULL AND old_path <> path")
    ends = e.where("event = 'deleted'").select("path", "at").unionByName(moved.select("path", "at"))  # a move replaces what is at its target
    one = moved.select(F.col("old_path").alias("path"), "at", F.col("path").alias("to")).unionByName(ends.withColumn("to", F.lit(None).cast("string")))
    folders = e.where("event = 'folder_renamed' AND old_path IS NOT NULL AND old_path <> path")
    below = e.where("event = 'folder_deleted'").select(F.col("path").alias("dir"), "at").unionByName(folders.select(F.col("path").alias("dir"), "at"))
    below = below.withColumn("to", F.lit(None).cast("string")).unionByName(folders.select(F.col("old_path").alias("dir"), "at", F.col("path").alias("to")))
    seen = e.where("event IN ('created', 'modified', 'renamed')").select("path", "at")
    return one, below, seen


def _next_step(living: DataFrame, one: DataFrame, below: DataFrame) -> DataFrame:
    """living with step: the first touch after ``since`` that meets the file where it is, null if there is none."""
    after = F.col("since").isNull() | (F.col("at") > F.col("since"))
    direct = living.join(one, "path").where(after).select("file", "at", F.col("to").isNull().alias("end"), F.col("to").alias("path"))
    above = living.select("file", "since", "path", F.explode(ancestors(F.col("path"))).alias("dir")).join(below, "dir").where(after)
    moved = F.concat("to", F.substr("path", F.length("dir") + 1))
    through = above.select("file", "at", F.col("to").isNull().alias("end"), moved.alias("path"))
    first = direct.unionByName(through).groupBy("file").agg(F.min(F.struct("at", "end", "path")).alias("step"))
    return living.join(first, "file", "left")


def net_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, final, renew): what a batch does to the files it meets: their path after it, null if they are gone, and whether they are
    to be read anew; files that it adds have a null id. files: (id, path).

    Events count one after the other, in ``event_order``. A file's life is followed from touch to touch, all files at once, one join
    for each link of the longest chain; only files that were touched take part. Every sight of a file (created, modified, moved to a path) starts a life as well:
    lives that end at one path are one file, which is the one known longest.
    """
    one, below, seen = (written(x, "touches") for x in _touches(changes))
    # Of sights of a path with no touch between them, the first one.
    through = seen.select("path").distinct().withColumn("dir", F.explode(ancestors(F.col("path")))).join(below, "dir").select("path", "at")
    both = seen.select("path", "at", F.lit(1).alias("sight")).unionByName(one.select("path", "at").unionByName(through).withColumn("sight", F.lit(0)))
    upto = W.partitionBy("path").orderBy("at", "sight").rowsBetween(W.unboundedPreceding, 0)
    part = both.withColumn("part", F.sum(1 - F.col("sight")).over(upto)).where("sight = 1")
    sights = part.groupBy("path", "part").agg(F.min("at").alias("since")).select("path", "since")
    met = one.select("path").unionByName(seen.select("path")).distinct()
    met = files.select("id", "path").join(met, "path", "left_semi").unionByName(
        files.select("id", "path", F.explode(ancestors(F.col("path"))).alias("dir")).join(below.select("dir"), "dir", "left_semi").select("id", "path")
    ).distinct()
    file = F.struct(F.col("since").isNotNull().alias("new"), F.col("since"), F.col("id"), F.col("path").alias("first"))
    none = F.lit(None).cast(sights.schema["since"].dataType)
    living = met.select("id", "path", none.alias("since")).unionByName(sights.select(F.lit(None).cast("long").alias("id"), "path", "since"))
    living = living.select(file.alias("file"), "path", "since")
    over: DataFrame | None = None
    while True:
        stepped = written(_next_step(living, one, below), "steps")
        done = stepped.where("step IS NULL OR step.end").select("file", F.when(F.col("step").isNull(), F.col("path")).alias("path"))
        over = done if over is None else over.unionByName(done)
        living = stepped.where("step IS NOT NULL AND NOT step.end").select("file", F.col("step.path").alias("path"), F.col("step.at").alias("since"))
        if living.isEmpty():
            break
    alive = over.where("path IS NOT NULL").groupBy("path").agg(F.min("file").alias("file"), F.max("file.new").alias("renew"))
    gone = over.where("path IS NULL AND NOT file.new").select(F.col("file.id").alias("id"), F.lit(None).cast("string").alias("final"), F.lit(False).alias("renew"))
    return alive.select(F.col("file.id").alias("id"), F.col("path").alias("final"), "renew").unionByName(gone)


def one_of_each(contents: DataFrame) -> DataFrame:
    """One row of each path: of several the last one by their values, and of equal ones that of the greatest content hash."""
    values = [c for c in contents.columns if c not in ("path", "content")]
    order = [F.col(c).desc_nulls_last() for c in values] + ([F.xxhash64("content").desc()] if "content" in contents.columns else [])
    nr = F.row_number().over(W.partitionBy("path").orderBy(*order))
    return contents.withColumn("__nr", nr).where("__nr = 1").drop("__nr")


def _outcome(net: DataFrame, contents: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, final, __met, __new) of the files that are known, and (path, *values) of those to be added. contents: a path once."""
    fresh = net.where("renew").select("final").join(contents.withColumnRenamed("path", "final"), "final").select("final", F.struct(*values).alias("__new"))
    known = net.where("id IS NOT NULL").join(fresh, "final", "left").select("id", "final", F.lit(True).alias("__met"), "__new")
    return known, net.where("id IS NULL").select(F.col("final").alias("path")).join(fresh.withColumnRenamed("final", "path"), "path").select("path", "__new.*")


def _changed(files: DataFrame, known: DataFrame, values: list[str], now: Column) -> DataFrame:
    """files with what the batch does to known ones."""
    out = files.join(known, "id", "left").where("__met IS NULL OR final IS NOT NULL")
    moved, renewed = F.coalesce(F.col("final") != F.col("path"), F.lit(False)), F.col("__new").isNotNull()
    old = {c: F.col(c) for c in values} | {"name": F.when(moved, basename(F.col("final"))).otherwise(F.col("name"))}
    columns = {c: F.when(renewed, F.col(f"__new.{c}")).otherwise(old[c]).alias(c) for c in values}
    columns |= {"path": F.coalesce("final", "path").alias("path"), "updated_at": F.when(renewed, now).otherwise(F.col("updated_at")).alias("updated_at")}
    return out.select(*[columns.get(c, F.col(c)) for c in files.columns])


def _added(added: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    return maintain.with_new_ids(added, files).withColumns({"created_at": now, "updated_at": now}).select(*files.columns)


def _values(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c not in ("id", "path", "created_at", "updated_at")]


def apply_changes(files: DataFrame, changes: DataFrame, contents: DataFrame, now: Column) -> DataFrame:
    """files after a batch of changes: renamed, deleted, updated and added rows. contents: (path, name, size, hash, file_type, content,
    is_supported) of the paths that can be read, of a path that stands there more than once one row (``one_of_each``); a file to be read anew that is not among them keeps its values, and is not added.

    Only ids and paths are shuffled against the changes; a file's other columns meet one row of the outcome.
    """
    values = _values(files)
    with scratch() as kept:
        net = kept.keep(written(net_changes(files, changes), "net-changes"))
    known, added = _outcome(net, one_of_each(contents), values)
    return _changed(files, known, values, now).unionByName(_added(added, files, now))


class FilesTable:
    """The files table for foreachBatch: rows without content in buckets of their ids, and contents in a table of their own, by the batch that wrote them.

    A batch rewrites the buckets of the files that it touches, reads the others not even for their values, and writes the contents that it renews; a manifest then names the folder of
    each bucket and the contents in use. So what is written follows what has changed, a batch that is given again is skipped, and one that breaks off anywhere leaves the table as it was.
    ``compact`` writes the contents in use as one and swaps them by the manifest, too. Folders go when two manifests do not name them.

    What the last batch did is kept until the next one: ``last_change`` gives the rows it touched as they were and as they are, for whatever follows the table.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets, self.held = spark, buckets, Manifest(spark, folder)
        self.folder = self.held.folder

    def state(self) -> dict:
        """The last batch's number, the version of each bucket, the contents in use, and the rows' schema."""
        return self.held.state() or {"batch": -1, "buckets": self.buckets, "rows": {}, "contents": [], "next": 0, "schema": None}

    def _bucket(self, id_: Column, state: dict) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(state["buckets"])).cast("int")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        versions: dict[str, list[int]] = {}
        for b, version in state["rows"].items():
            if buckets is None or int(b) in buckets:
                versions.setdefault(version, []).append(int(b))
        schema = StructType.fromJson(json.loads(state["schema"]))
        out = self.spark.createDataFrame([], schema)
        for version, held in versions.items():
            part = self.spark.read.schema(StructType(schema.fields + [StructField("bucket", IntegerType())])).parquet(f"{self.folder}/rows/{version}")
            out = out.unionByName(part.where(F.col("bucket").isin(held)).drop("bucket"))
        return out

    def rows(self) -> DataFrame:
        """The files without their content, and the number of the contents that theirs is among."""
        return self._rows(self.state())

    def _contents(self, numbers: list[int]) -> DataFrame:
        paths = [f"{self.folder}/contents/content_batch={k}" for k in numbers]
        schema = "id long, content string, content_batch long"
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/contents").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        state = self.state()
        return self._rows(state).join(self._contents(state["contents"]), ["id", "content_batch"], "left").drop("content_batch")

    def last_change(self) -> tuple[DataFrame, DataFrame]:
        """The files that the last batch touched, as they were before it and as they are after it, with content: deleted ones are in the first alone, added ones in the second.

        Both are written; give them a scratch. Only the buckets of the batch are read, and of the contents those of the numbers that the touched rows name.
        """
        state = self.state()
        change = state.get("change")
        if not change:
            none = self.read().limit(0)
            return none, none
        if "before" not in change:
            raise RuntimeError("the last change went with a compaction: what follows the table is to be built anew if it lacks it")
        ids = self.spark.read.schema("id long").parquet(f"{self.folder}/touched/{change['version']}")

        def rows(held: dict) -> DataFrame:
            touched = written(self._rows(state | held).join(ids, "id", "left_semi"), "touched")
            numbers = [r[0] for r in touched.select("content_batch").distinct().collect()]  # of batches
            found = touched.select("id", "content_batch").join(self._contents(numbers), ["id", "content_batch"]).select("id", "content")
            return written(touched.drop("content_batch").join(found, "id", "left"), "changed")

        return rows(change["before"]), rows(change["after"])

    def write(self, files: DataFrame, batch: int = 0) -> None:
        """A whole table, content and all."""
        state = self.state()
        rows = files.drop("content").withColumn("content_batch", F.lit(state["next"]).cast("long"))
        self._put_contents(files.select("id", "content"), state["next"])
        version = self._put_rows(rows, state)
        schema = json.dumps(json.loads(StructType([StructField(f.name, f.dataType) for f in rows.schema]).json()))
        self._put({"batch": batch, "buckets": state["buckets"], "rows": {str(b): version for b in range(state["buckets"])}, "contents": [state["next"]], "next": state["next"] + 1, "schema": schema})

    def _put_contents(self, contents: DataFrame, number: int) -> None:
        contents.write.mode("overwrite").parquet(f"{self.folder}/contents/content_batch={number}")

    def _put_rows(self, rows: DataFrame, state: dict) -> str:
        version = f"v{uuid.uuid4().hex[:12]}"
        bucketed = rows.withColumn("bucket", self._bucket(F.col("id"), state))
        bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{self.folder}/rows/{version}")
        return version

    def _put(self, state: dict) -> None:
        self.held.put(state)
        sides = lambda s: [s, *((s.get("change") or {}).get(k, {"rows": {}, "contents": []}) for k in ("before", "after"))]
        self.held.sweep("rows", lambda s: [v for side in sides(s) for v in side["rows"].values()])
        self.held.sweep("contents", lambda s: [f"content_batch={k}" for side in sides(s) for k in side["contents"]])
        self.held.sweep("touched", lambda s: [v for v in [(s.get("change") or {}).get("version")] if v])

    def fold(self, changes: DataFrame, batch: int, contents: DataFrame | Callable[[DataFrame], DataFrame]) -> None:
        """One micro-batch; give it to foreachBatch. Contents are joined only for the files that the batch renews; a function gets the table of these files' paths
        after the batch (path) and gives the contents of those that it can read, so that nothing else is read."""
        state = self.state()
        if batch <= state["batch"]:
            return
        if changes.isEmpty():
            self._put(state | {"batch": batch, "change": None})
            return
        number, now = state["next"], F.current_timestamp()
        with scratch():
            files = self._rows(state)
            values, net = _values(files), written(net_changes(files, changes), "net-changes")
            if callable(contents):
                contents = written(contents(net.where("renew").select(F.col("final").alias("path"))), "contents")
            contents = one_of_each(contents)
            told = contents.drop("content").withColumn("content_batch", F.lit(number).cast("long"))
            known, added = _outcome(net, told, values)
            known = written(known, "known")
            added = written(_added(added, files, now), "added")
            touched = known.select("id").unionByName(added.select("id"))
            buckets = sorted(r["b"] for r in touched.select(self._bucket(F.col("id"), state).alias("b")).distinct().collect())  # as many as there are buckets at most
            change = None
            if buckets:
                rows = written(_changed(self._rows(state, buckets), known, values, now).unionByName(added), "rows")
                renewed = rows.where(F.col("content_batch") == number).select("id", "path")
                self._put_contents(renewed.join(contents.select("path", "content"), "path").select("id", "content"), number)
                version = self._put_rows(rows, state)
                touched.write.parquet(f"{self.folder}/touched/{version}")
                before = {"rows": {str(b): state["rows"][str(b)] for b in buckets}, "contents": state["contents"]}
                after = {"rows": {str(b): version for b in buckets}, "contents": [*state["contents"], number]}
                change = {"version": version, "before": before, "after": after}
                state = state | {"rows": state["rows"] | after["rows"], "contents": after["contents"], "next": number + 1}
            self._put(state | {"batch": batch, "change": change})

    def compact(self) -> None:
        """All contents in use as those of one number; the others go when two manifests do not name them. The last change goes, too: bring what follows the table up to it first."""
        state = self.state()
        number = state["next"]
        self._put_contents(self.read().select("id", "content"), number)
        version = self._put_rows(self._rows(state).withColumn("content_batch", F.lit(number).cast("long")), state)
        self._put(state | {"rows": {b: version for b in state["rows"]}, "contents": [number], "next": number + 1, "change": state.get("change") and {"gone": True}})
