"""A running job that follows a change feed: renames paired and pending paths held in keyed state with timers, and the table, index and counts kept up with it.

States live in the state store of the stream's checkpoint, so that a job that stops goes on where it was. Both operators answer by event time alone: however the feed is cut
into batches, and however often it is stopped, their rows are those of their batch twins (``pair_renames``, ``pending_state``) for all that the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillmill.plans.folder_counts import FolderCounts
from quillmill.plans.live_index import LiveIndex
from quillmill.sources.written import scratch, written
from quillmill.streaming.changes import FilesTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers wants the RocksDB state store; set it before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _fields(**types) -> StructType:
    return StructType([StructField(name, type_()) for name, type_ in types.items()])


def _millis(micros: int) -> int:
    """The first millisecond that is not before a time: a watermark that has reached it has passed the time."""
    return -(-micros // 1000)


class _Pairs(StatefulProcessor):
    """Of a file id: records that wait for the watermark, and the old name that is open. One timer at a time: the first waiting record's, or the end of the open name."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _fields(seq=LongType, at=LongType, event=StringType, path=StringType))
        self.open = handle.getValueState("open", _fields(at=LongType, path=StringType))
        self.timer = handle.getValueState("timer", _fields(at=LongType))

    def _wake(self, at: int) -> None:
        held = self.timer.get() if self.timer.exists() else None
        if held and held[0] <= at:
            return
        if held:
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList([(int(s), int(a), e, p) for s, a, e, p in zip(frame["seq"], frame["at"], frame["event"], frame["path"])])
            least = int(frame["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(_millis(first))
        yield pd.DataFrame({"file_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "at": pd.Series(dtype="int64"), "path": pd.Series(dtype=object), "old_path": pd.Series(dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = sorted(self.waiting.get())
        due = [r for r in held if _millis(r[1]) <= passed]
        later = [r for r in held if _millis(r[1]) > passed]
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        name = self.open.get() if self.open.exists() else None
        found = []
        for seq, at, event, path in due:
            if event == "rename_old":
                name = (at, path)
            elif event == "rename_new":
                found.append((key[0], seq, at, path, name[1] if name and name[0] >= at - self.within else None))
        if name and _millis(name[0] + self.within) > passed:
            self.open.update((name[0], name[1]))
        else:
            self.open.clear()
            name = None
        times = [_millis(r[1]) for r in later] + ([_millis(name[0] + self.within) + 1] if name else [])
        if times:
            self._wake(min(times))
        yield pd.DataFrame(found, columns=["file_id", "seq", "at", "path", "old_path"])


def pair_renames_running(records: DataFrame, within_seconds: int = 60) -> DataFrame:
    """(file_id, seq, ts, path, old_path): ``pair_renames`` for a stream with a watermark, whatever the order of arrival within it. An old name is let go when its time is over.

    A file's seq and ts are to rise together. A record is answered when the watermark has passed it.
    """
    keyed = records.select("file_id", "seq", F.unix_micros("ts").alias("at"), "event", "path", "ts")
    shape = "file_id long, seq long, at long, path string, old_path string"
    out = keyed.groupBy("file_id").transformWithStateInPandas(_Pairs(within_seconds * 1_000_000), shape, "append", "EventTime")
    return out.select("file_id", "seq", F.timestamp_micros("at").alias("ts"), "path", "old_path")


class _Pending(StatefulProcessor):
    """Of a path: the last event of each flush interval that is still open. Events of the table go through at once; at an interval's end the path is due, unless it was deleted."""

    def __init__(self, flush: int):
        self.flush = flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", _fields(start=LongType), _fields(at=LongType, later=LongType, event=StringType))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            ordered = frame.assign(start=frame["at"] // self.flush * self.flush).sort_values(["start", "at", "later", "event"])
            for start, at, later, event in ordered.groupby("start").tail(1)[["start", "at", "later", "event"]].itertuples(index=False):
                slot, new = (int(start),), (int(at), int(later), event)
                known = self.last.containsKey(slot)
                if not known or tuple(self.last.getValue(slot)) < new:
                    self.last.updateValue(slot, new)
                if not known:
                    self.handle.registerTimer(_millis(int(start) + self.flush))
            through = frame[frame["through"]]
            yield pd.DataFrame({"path": through["path"], "at": through["at"], "seq": through["seq"], "event": through["shown"], "old_path": through["old_path"], "due": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.flush
        event = self.last.getValue((start,))[2]
        self.last.removeKey((start,))
        out = [] if event == "deleted" else [(key[0], start + self.flush - 1, -1, event, None, True)]
        yield pd.DataFrame(out, columns=["path", "at", "seq", "event", "old_path", "due"])


def _at_once(changes: DataFrame) -> DataFrame:
    """Each event at its path, and a rename at its old path too, which it ends; deletions, renames and events of folders go through."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    base = changes.select("ts", "path", F.unix_micros("ts").alias("at"), seq.cast("long").alias("seq"), "old_path", F.col("event").alias("shown"))
    folder = F.startswith("shown", F.lit("folder_"))
    kind = F.when(F.col("shown") == "renamed", "created").when(folder, "deleted").otherwise(F.col("shown"))
    old = base.where("shown = 'renamed' AND old_path IS NOT NULL").withColumn("path", F.col("old_path")).withColumns({"event": F.lit("deleted"), "through": F.lit(False)})
    own = base.withColumns({"event": kind, "through": folder | F.col("shown").isin("deleted", "renamed")})
    return own.unionByName(old).withColumn("later", (F.col("event") != "deleted").cast("long"))


def pending_running(changes: DataFrame, flush_seconds: int = 900) -> DataFrame:
    """(path, ts, seq, event, old_path, due) of a stream with a watermark: what changes the table at once (due = false: files deleted and renamed, folders), and each path
    that is to be read anew, when its flush interval is over (due = true; ts: the end of the interval). The due rows are those of ``pending_state``.

    Null paths are left out; an event of a folder leaves its own path nothing to be read.
    """
    keyed = _at_once(changes.where("path IS NOT NULL"))
    shape = "path string, at long, seq long, event string, old_path string, due boolean"
    out = keyed.groupBy("path").transformWithStateInPandas(_Pending(flush_seconds * 1_000_000), shape, "append", "EventTime")
    return out.select("path", F.timestamp_micros("at").alias("ts"), "seq", "event", "old_path", "due")


class Follower:
    """For foreachBatch on ``pending_running``: folds each batch into the table and brings index and folder counts up to it.

    ``read`` gives contents: of a table of (path), a row for each that can be read (path and the values of files, as ``fold`` takes them). It gets the due files where they are after the batch; one that a batch
    renames is due at its new path later, and not read before. One whose folder is renamed in an earlier batch than the one it is due in keeps its content until its next event. A batch that broke off is given again: the table
    skips what it has, and index and counts take the table's last change if they lack it.
    """

    def __init__(self, table: FilesTable, read: Callable[[DataFrame], DataFrame], index: LiveIndex | None = None, counts: FolderCounts | None = None):
        self.table, self.read = table, read
        self.followers = [f for f in (index, counts) if f is not None]

    def __call__(self, batch: DataFrame, number: int) -> None:
        with scratch():
            kept = written(batch, "batch")  # a batch that the table has is read all the same, as states are committed by reading
            due = kept.where("due").select("path")
            later = kept.where("NOT due AND event = 'renamed'").select("path").join(due, "path", "left_anti")
            events = kept.withColumn("event", F.when(F.col("due"), "modified").otherwise(F.col("event"))).drop("due")
            self.table.fold(events, number, lambda renewed: self.read(renewed.join(later, "path", "left_anti")))
            self.catch_up()

    def catch_up(self) -> None:
        """Index and counts at the table's last batch; they are one behind it at most, as a batch is done when they have it."""
        number = self.table.state()["batch"]
        behind = [f for f in self.followers if f.held.state()["batch"] < number]
        if behind and not self.table.state().get("change"):
            for f in behind:
                f.held.put(f.held.state() | {"batch": number})
        elif behind:
            with scratch():
                before, after = self.table.last_change()
                for f in behind:
                    f.update(before, after, number)

    def compact(self) -> None:
        self.catch_up()
        self.table.compact()
