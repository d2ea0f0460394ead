"""Keyed state with timers against batches, restarts, and the running job with its index and counts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.operators.stats import folder_stats
from quillmill.plans import folder_counts, live_index, search, tables
from quillmill.sources import readers, written
from quillmill.streaming import changes as ch
from quillmill.streaming import follow

NOW = dt.datetime(2024, 1, 1)
SECOND = dt.timedelta(seconds=1)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    follow.use_keyed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream_in_parts(spark, parts, schema, build, tmp_path):
    """The rows of a stream that is stopped after each part of its input and started anew."""
    feed, out, at = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "cp")
    feed.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(feed / f"p{k}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(feed)).withWatermark("ts", "30 seconds")
        run = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out)


def shuffled(rows, key, rnd, late, cuts):
    """Rows in an order of arrival that no row is later in than the watermark bears, cut into parts."""
    order = sorted(rows, key=lambda r: r[key] + SECOND * rnd.random() * late)
    size = len(order) // cuts + 1
    return [order[k : k + size] for k in range(0, len(order), size)]


def test_paired_renames_with_restarts(spark, rocks, tmp_path):
    rnd = random.Random(2)
    rows, at = [], NOW
    for seq in range(400):
        at += SECOND * rnd.choice([0, 1, 2, 40]) + dt.timedelta(microseconds=rnd.choice([0, 1, 999, 500_000]))
        rows.append((rnd.randrange(6), seq, at, rnd.choice(["rename_old", "rename_new", "modified"]), f"/p{seq}"))
    rows += [(9, 400, at + 1000 * SECOND, "modified", "/end")]
    schema = "file_id long, seq long, ts timestamp, event string, path string"
    got = stream_in_parts(spark, shuffled(rows, 2, rnd, 29, 4), schema, lambda s: follow.pair_renames_running(s, 60), tmp_path)
    want = ch.pair_renames(spark.createDataFrame(rows, schema), "60 seconds")
    key = lambda d: sorted((r["file_id"], r["ts"], r["path"], str(r["old_path"])) for r in d.collect())
    assert key(got) == key(want) and any(r[3] != "None" for r in key(got)) and any(r[3] == "None" for r in key(got))


def test_pending_paths_with_restarts(spark, rocks, tmp_path):
    rnd = random.Random(4)
    rows, at = [], NOW
    for seq in range(400):
        at += SECOND * rnd.choice([0, 1, 7, 60])
        event = rnd.choice(["created", "modified", "modified", "deleted", "renamed"])
        rows.append((seq, at, event, f"/d/{rnd.randrange(8)}", f"/d/{rnd.randrange(8)}" if event == "renamed" else None))
    rows += [(400, at + 4000 * SECOND, "folder_deleted", "/end", None)]
    schema = "seq long, ts timestamp, event string, path string, old_path string"
    got = stream_in_parts(spark, shuffled(rows, 1, rnd, 29, 4), schema, lambda s: follow.pending_running(s, 900), tmp_path).collect()
    want = ch.pending_state(spark.createDataFrame(rows, schema).where("path <> '/end'")).collect()
    due = sorted((r["ts"] + dt.timedelta(microseconds=1) - 900 * SECOND, r["path"], r["event"]) for r in got if r["due"])
    assert due == sorted((r["start"], r["path"], r["event"]) for r in want) and due
    assert sorted(r["seq"] for r in got if not r["due"]) == [r[0] for r in rows if r[2] in ("deleted", "renamed", "folder_deleted")]


def _files(spark, texts):
    rows = [(k, p, p.rpartition("/")[2], len(c), None, "text", c, True, NOW, NOW) for k, (p, c) in enumerate(texts.items())]
    return spark.createDataFrame(rows, schemas.FILES)


def _told(spark, texts):
    return spark.createDataFrame([(p, p.rpartition("/")[2], len(c), None, "text", c, True) for p, c in texts.items()], "path string, name string, size long, hash string, file_type string, content string, is_supported boolean")


def _counts(rows):
    return sorted((r["path"], r["file_count"], r["total_size"]) for r in rows.collect())


def test_counts_after_random_batches(spark, tmp_path):
    rnd = random.Random(8)
    path = lambda: f"/v/{rnd.choice('ab')}/{rnd.choice('cd')}/{rnd.randrange(6)}"
    table = ch.FilesTable(spark, str(tmp_path / "t"), buckets=4)
    table.write(_files(spark, {path(): "x" * rnd.randrange(9) for _ in range(9)}), -1)
    counts = folder_counts.FolderCounts(spark, str(tmp_path / "c"))
    counts.create(table.rows())
    assert table.last_change()[0].count() == 0
    for n in range(4):
        kinds = ["created", "modified", "deleted", "renamed", "folder_renamed", "folder_deleted"]
        events = []
        for k in range(6):
            kind = rnd.choices(kinds, [6, 4, 3, 4, 1, 1])[0]
            folder = kind.startswith("folder")
            at = path()
            events.append((k, NOW, kind, at.rpartition("/")[0] if folder else at, (path().rpartition("/")[0] if folder else path()) if "renamed" in kind else None))
        c = spark.createDataFrame(events, "seq long, ts timestamp, event string, path string, old_path string")
        seen = {e[3] for e in events if not e[2].startswith("folder")}
        table.fold(c, n, _told(spark, {p: "y" * rnd.randrange(30) for p in seen} or {"/none": ""}))
        with written.scratch():
            before, after = table.last_change()
            counts.update(before, after, n)
            counts.update(before, after, n)
        if n == 2:
            table.compact()
            with pytest.raises(RuntimeError, match="compaction"):
                table.last_change()
        plain = {}
        for r in table.rows().collect():
            parts = r["path"].split("/")
            for k in range(2, len(parts)):
                at = plain.setdefault("/".join(parts[:k]), [0, 0])
                at[0] += 1
                at[1] += r["size"]
        assert _counts(counts.read()) == sorted((p, *v) for p, v in plain.items())
    folders = spark.createDataFrame([("/v",), ("/v/a/",), ("/none",)], "path string")
    assert _counts(counts.of(folders)) == _counts(folder_stats(table.rows(), folders))
    assert len(counts.held.state()["segments"]) < 5


def test_a_job_that_follows_its_feed(spark, rocks, tmp_path, monkeypatch):
    """Events come as JSON lines over several runs; one run breaks off between table and index. Index and counts end as those of the table built anew."""
    disk = {f"/d/{k}": f"old foo {k}" for k in range(12)}
    table = ch.FilesTable(spark, str(tmp_path / "t"), buckets=4)
    table.write(_files(spark, disk), -1)
    index = live_index.LiveIndex(spark, str(tmp_path / "i"))
    index.create(table.read())
    counts = folder_counts.FolderCounts(spark, str(tmp_path / "c"))
    counts.create(table.rows())
    read = lambda due: _told(spark, disk).join(due, "path", "left_semi")
    job = follow.Follower(table, read, index, counts)
    (tmp_path / "feed").mkdir()
    start = 1_704_067_200_000

    def run(nr, events):
        lines = [{"type": "event", "event": e, "path": p, "oldPath": o, "timestamp": start + 1000 * s, "volume": "/", "isDirectory": d} for s, e, p, o, d in events]
        (tmp_path / "feed" / f"{nr}.json").write_text("\n".join(json.dumps(x) for x in lines))
        feed = ch.stream_changes(readers.read_change_feed(spark, str(tmp_path / "feed")), late="10 seconds")
        run = follow.pending_running(feed).writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()

    disk |= {"/d/1": "bar one", "/n/new": "foo bar new"}
    run(0, [(1, "modified", "/d/1", None, False), (2, "created", "/n/new", None, False), (3, "deleted", "/d/2", None, False), (4, "renamed", "/e/3", "/d/3", False)])
    del disk["/d/2"]
    disk["/e/3"] = disk.pop("/d/3") + " moved"
    now = {r["path"]: r["content"] for r in table.read().collect()}
    assert "/d/2" not in now and now["/e/3"] == "old foo 3" and now["/d/1"] == "old foo 1" and "/n/new" not in now  # contents wait for the end of the interval
    with monkeypatch.context() as m:
        m.setattr(live_index.LiveIndex, "update", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            run(1, [(1000, "modified", "/d/4", None, False), (1000, "deleted", "/d/6", None, False)])
    assert table.state()["batch"] > index.held.state()["batch"]
    del disk["/d/6"]
    del disk["/d/4"]
    disk["/f/3"] = disk.pop("/e/3")  # due in the batch that renames its folder
    disk["/d/5"] = "bar five"
    run(2, [(1001, "renamed", "/f", "/e", True), (1002, "deleted", "/d/4", None, False), (1003, "modified", "/d/5", None, False)])
    run(3, [(3000, "modified", "/nowhere", None, False)])
    assert {r["path"]: r["content"] for r in table.read().collect()} == disk
    asked = spark.createDataFrame([(0, "foo"), (1, "bar"), (2, '"foo bar"'), (3, "moved"), (4, "old")], "query_id int, query string")
    key = lambda i: sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in search.search(i, asked).collect())
    assert key(index.read(table.read())) == key(search.Index.of(table.read()))
    assert _counts(counts.read()) == _counts(folder_counts.count_differences(table.rows().limit(0), table.rows()))
