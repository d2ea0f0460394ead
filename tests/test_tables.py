"""Sources, exports, maintenance and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import maintain, rank, results
from quillmill.plans import scan, search, tables
from quillmill.sources import readers, writers
from quillmill.streaming import changes as ch

DIR = "/root/testdata/sf0.001"
UTC = dt.timezone.utc


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_readers(spark, tmp_path):
    write(tmp_path / "in/a.txt", "Hällo\nzwei".encode())
    write(tmp_path / "in/sub/b.md", b"# b")
    write(tmp_path / "in/c.bin", b"\x00\x01")
    files = readers.read_files(spark, str(tmp_path / "in"))
    assert sorted(r["path"].rpartition("/")[2] for r in files.collect()) == ["a.txt", "b.md", "c.bin"]
    assert {r["path"].rpartition("/")[2]: r["content"] for r in readers.read_text_files(spark, str(tmp_path / "in")).collect()} == {"a.txt": "Hällo\nzwei", "b.md": "# b"}
    assert readers.read_modified_since(spark, str(tmp_path / "in"), dt.datetime(2000, 1, 1)).count() == 3
    assert readers.read_modified_since(spark, str(tmp_path / "in"), dt.datetime(2999, 1, 1)).count() == 0


def test_index_and_shards(spark, tmp_path):
    files = tables.files(spark, DIR)
    i = search.Index.of(files)
    writers.write_index(files, i.postings, i.stats, str(tmp_path / "index"))
    back = search.Index.read(spark.read.parquet(str(tmp_path / "index/files")), str(tmp_path / "index"))
    queries = tables.words(spark, DIR, 2)
    rows = lambda d: sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in d.collect())
    assert rows(search.search(back, queries)) == rows(search.search(i, queries))
    for k in range(3):
        files.where(F.col("id") % 3 == k).write.parquet(str(tmp_path / f"shard{k}"))
    whole = readers.read_shards(spark, [str(tmp_path / f"shard{k}") for k in range(3)])
    assert whole.count() == files.count() and whole.columns == files.columns


def test_search_syntax(spark):
    rows = [(1, "report 2024 summary"), (2, "report draft of the year"), (3, "summary only"), (4, "crème brûlée report-card"), (5, "reports running")]
    names = {1: "annual.txt", 2: "draft.md", 3: "summary.pdf", 4: "menu.txt", 5: "pdf notes.log"}
    kinds = {"txt": "text", "md": "text", "pdf": "pdf", "log": "text"}
    files = spark.createDataFrame([(i, f"/home/{'downloads' if i == 3 else 'docs'}/{names[i]}", names[i], 10 * i, None, kinds[names[i].rpartition(".")[2]], t, True, None, dt.datetime(2024, 1, i)) for i, t in rows], "id long, path string, name string, size long, hash string, file_type string, content string, is_supported boolean, created_at timestamp, updated_at timestamp")
    index = search.Index.of(files)
    cases = {
        "report": {1, 2, 4, 5}, "report*": {1, 2, 4}, "report AND 2024": {1}, "report OR summary": {1, 2, 3, 4, 5}, "report NOT draft": {1, 4, 5},
        "name:summary": {3}, "ext:pdf summary": {3}, "path:downloads summary": {3}, "creme": {4}, "report-card": {4}, "pdf": {3, 5}, "zzz": set(), "   ": set(), "name:draft ignored words": {2},
    }
    queries = spark.createDataFrame(list(enumerate(cases)), "query_id long, query string")
    got = {}
    for r in search.search(index, queries).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert {q: got.get(k, set()) for k, q in enumerate(cases)} == cases
    stemmed = search.Index.of(files, stems=True)
    one = lambda i, q, **o: {r["id"] for r in search.search(i, spark.createDataFrame([(1, q)], "query_id long, query string"), search.Options(**o)).collect()}
    assert one(stemmed, "run") == one(stemmed, "running") == one(stemmed, "runs") == {5} and one(stemmed, "reported") == {1, 2, 4, 5}
    assert one(index, "sumary") == one(index, "runing") == set() and one(index, "summarry", typos=2) == {1, 3} and one(index, "runnnig draft", typos=2) == set()
    assert one(index, "draftt reprot", typos=2) == {2}
    late = search.Options(since="2024-01-02", until="2024-01-04", size_least=20, size_most=0, file_types=["text"])
    assert {r["id"] for r in search.search(index, queries.where("query = 'report'"), late).collect()} == {2}
    assert {r["id"] for r in search.search_by_filename(index, spark.createDataFrame([(1, "draft")], "query_id long, query string")).collect()} == {2}


    regex = spark.createDataFrame([(0, "/dra[fg]t|2024/ report"), (1, "/(?P<n>a)/ report"), (2, "/card/"), (3, "summary"), (4, "/MENU/ creme"), (5, "/(/ report")], "query_id long, query string")
    found = {}
    for r in search.search_with_regex(index, regex).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    assert found == {0: {1, 2}, 3: {1, 3}, 4: {4}}


def test_stemmed_search_against_a_loop(spark):
    """The registered query: files with a term whose stem begins with the stem of the wanted word."""
    from quillmill.operators.index import porter_stem, tokenize
    from quillmill.plans.queries import QUERIES

    files = tables.files(spark, DIR).select("id", "is_supported", *[tokenize(F.col(c)).alias(c) for c in ("name", "content", "file_type")]).collect()
    held = {r["id"]: {porter_stem(w) for c in ("name", "content", "file_type") for w in r[c]} for r in files if r["is_supported"]}
    want = set()
    for r in tables.words(spark, DIR, 1, 4).where("query <> ''").withColumn("t", tokenize(F.concat("query", F.lit("ing")))).collect():
        stem = porter_stem(r["t"][0])
        want |= {(r["query_id"], i) for i, stems in held.items() if any(s.startswith(stem) for s in stems)}
    got = QUERIES["t13_search_with_stems"](spark, DIR).collect()
    assert {(r["query_id"], r["id"]) for r in got} == want and want


def test_scan_of_a_folder(spark, tmp_path):
    root = tmp_path / "in"
    write(root / "a.txt", b"plain text")
    write(root / "sub" / "b.html", b"<p>Hi <b>there</b></p>")
    write(root / ".git" / "c.txt", b"hidden")
    write(root / "skip.log", b"skipped")
    write(root / "d.xyz", b"unknown")
    none = tables.files(spark, DIR).limit(0)
    rules = spark.createDataFrame([("logs", "ext", ".log", True)], "name string, type string, pattern string, enabled boolean")
    folders = spark.createDataFrame([(1, f"{root}/sub")], "id long, path string").withColumns({"file_count": F.lit(0).cast("long"), "total_size": F.lit(0).cast("long"), "last_scan_at": F.lit(None).cast("timestamp"), "last_full_scan_at": F.lit(None).cast("timestamp")})
    index = scan.scan(str(root), none, str(tmp_path / "one"), F.current_timestamp(), rules, folders)
    first = {r["name"]: r for r in index.files.collect()}
    assert {n: r["content"] for n, r in first.items()} == {"a.txt": "plain text", "b.html": "Hi there"} and all(r["hash"] for r in first.values())
    found = search.search(index, spark.createDataFrame([(1, "there")], "query_id long, query string")).collect()
    assert [r["name"] for r in found] == ["b.html"]
    assert spark.read.parquet(str(tmp_path / "one" / "folders")).first()["file_count"] == 1
    write(root / "a.txt", b"changed text, longer")
    again = scan.scan(str(root), index.files, str(tmp_path / "two"), F.current_timestamp(), rules)
    second = {r["name"]: r for r in again.files.collect()}
    assert second["a.txt"]["content"] == "changed text, longer" and {n: r["id"] for n, r in second.items()} == {n: r["id"] for n, r in first.items()}
    assert second["b.html"] == first["b.html"]


def test_all_words_are_some_of_any_words(spark):
    index = search.Index.of(tables.files(spark, DIR))
    q = tables.words(spark, DIR, 2)
    pairs = lambda d: {(r["query_id"], r["id"]) for r in d.select("query_id", "id").collect()}
    every = search.Options(k=10**9)
    either = q.withColumn("query", F.replace("query", F.lit(" "), F.lit(" OR ")))
    assert pairs(search.search(index, q, every)) <= pairs(search.search(index, either, every))
    found = search.search(index, q, every)
    once = results.dedup_by_hash(found)
    assert sorted(results.dedup_by_hash(once).collect(), key=str) == sorted(once.collect(), key=str)


def test_exports(spark, tmp_path):
    rows = [(1, "a,b.txt", "/x/a,b.txt", 1536, "text", dt.datetime(2024, 1, 1), "content"), (2, "<c>.md", "/x/<c>.md", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, path string, size long, file_type string, updated_at timestamp, match_type string")
    read = lambda p: "".join(f.read_bytes().decode() for f in sorted(p.glob("part-*")))
    writers.export_csv(df, str(tmp_path / "csv"))
    lines = read(tmp_path / "csv").split("\r\n")
    assert lines[0] == "\ufefffile name,path,type,size,modified,match type" and sorted(lines[1:3]) == ['"a,b.txt","/x/a,b.txt",text,1.5 KB,2024-01-01 00:00:00,content', "<c>.md,/x/<c>.md,,-,-,"]
    writers.export_html(df, str(tmp_path / "html"), "t & u")
    page = read(tmp_path / "html")
    assert page.startswith("<!DOCTYPE html>") and "t &amp; u" in page and "&lt;c&gt;.md" in page and page.rstrip().endswith("</html>")
    writers.export_txt(df, str(tmp_path / "txt"), [F.col("id")])
    assert "[1] a,b.txt\npath: /x/a,b.txt\ntype: text | size: 1.5 KB" in read(tmp_path / "txt")
    whole = read(tmp_path / "txt")
    both = df.withColumn("query_id", F.lit(7)).unionByName(df.where("id = 2").withColumn("query_id", F.lit(8)))
    own = lambda kind, q, **more: (writers.export_by_query(both, str(tmp_path / f"by_{kind}"), kind, [F.col("id")], **more), read(tmp_path / f"by_{kind}" / f"query_id={q}"))[1]
    assert own("txt", 7) == whole and own("txt", 8).startswith("[1] <c>.md\npath: /x/<c>.md\n")
    assert sorted(own("csv", 7).split("\r\n")) == sorted(lines) and own("csv", 8).split("\r\n") == [lines[0], "<c>.md,/x/<c>.md,,-,-,", ""]
    assert sorted(own("html", 7, title=F.lit("t & u")).split("\n")) == sorted(page.split("\n")) and own("html", 8).count("<dt>") == 1
    with pytest.raises(ValueError):
        own("pdf", 7)
    cards = text.quote_cards(spark.createDataFrame([(1, "one key two")], "id long, content string"), F.lit("key")).withColumn("nr", F.lit(1))
    writers.export_quotes(cards, str(tmp_path / "md"))
    assert "> one**key**two" in read(tmp_path / "md")
    writers.export_quotes(cards, str(tmp_path / "q"), markdown=False)
    assert "...onekeytwo..." in read(tmp_path / "q")


def test_numbers_follow_the_sort(spark):
    rows = spark.range(0, 5000, numPartitions=7).select("id", (F.col("id") * 7919 % 1009).alias("v"))
    got = rank.numbered(rows.orderBy(F.col("v").desc(), "id"), "place").collect()
    want = sorted(((r["v"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 5001))
    assert rank.numbered(rows.limit(0).orderBy("id")).count() == 0


def test_results_job(spark, tmp_path):
    """Phrases, exclusions, names, words that no content holds as they are written, repeated files, queries without results."""
    when = dt.datetime(2024, 1, 1)
    texts = {1: "start " + "x" * 60 + " the Foo <b> bar and more " + "y" * 90, 2: "bar then foo", 3: "caf\u00e9 only", 4: None, 5: "bar then foo"}
    rows = [(i, f"/d/n{i}.txt", f"n{i}.txt", len(c or ""), "same" if i in (2, 5) else str(i), "text", c, True, when, when) for i, c in texts.items()]
    files = spark.createDataFrame(rows, "id long, path string, name string, size long, hash string, file_type string, content string, is_supported boolean, created_at timestamp, updated_at timestamp")
    asked = [(1, "foo bar"), (2, '"bar then"'), (3, "bar NOT then"), (4, "cafe"), (5, "nothing"), (6, 'name:"n4"'), (7, "zzz OR FOO*"), (8, "")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    job = search.results_job(search.Index.build(files, str(tmp_path / "index")), queries, search.Options(dedup=True))
    got = {(r["query_id"], r["id"]): r["snippet"] for r in job.collect()}
    cut = "..." + ("x" * 60 + " the ")[-40:] + "<mark>Foo</mark> &lt;b&gt; bar and more " + "y" * (60 - len(" <b> bar and more ")) + "..."
    assert {k: v for k, v in got.items() if k[1] not in (2, 5)} == {(1, 1): cut, (3, 1): got[3, 1], (4, 3): None, (6, 4): None, (7, 1): cut}
    assert "<mark>bar</mark>" in got[3, 1]
    rest = {k[0]: v for k, v in got.items() if k[1] in (2, 5)}
    assert rest == {1: "bar then <mark>foo</mark>", 2: "<mark>bar then</mark> foo", 7: "bar then <mark>foo</mark>"}
    places = {q: sorted(r["nr"] for r in job.collect() if r["query_id"] == q) for q in (1, 2, 7)}
    assert places == {1: [1, 2], 2: [1], 7: [1, 2]}


def test_upsert_twice_is_upsert_once(spark):
    files = tables.files(spark, DIR)
    batch = files.orderBy("id").limit(20).withColumns({"content": F.lit("new"), "seq": F.lit(1)}).unionByName(files.orderBy("id").limit(3).withColumns({"path": F.concat("path", F.lit(".x")), "seq": F.lit(1)}))
    now = F.lit("2025-01-01").cast("timestamp")
    once = maintain.upsert_files(files, batch, now)
    twice = maintain.upsert_files(once, batch, now)
    key = lambda d: sorted(map(tuple, d.select("path", "content", "size", "created_at", "updated_at").collect()), key=str)
    assert key(once) == key(twice)
    assert once.select("id").distinct().count() == once.count() == files.count() + 3
    kept = {r["path"]: r["id"] for r in files.collect()}
    assert all(r["id"] == kept[r["path"]] for r in once.collect() if r["path"] in kept)


SCHEMA = "seq long, event string, path string, old_path string, volume string, ts timestamp, is_dir boolean"


def event(seq, kind, path, old=None, minute=None):
    return (seq, kind, path, old, "/v", dt.datetime(2024, 1, 1, 0, seq if minute is None else minute, tzinfo=UTC), False)


def _files(spark, paths):
    rows = [(k, p, p.rpartition("/")[2], 1, None, "text", f"old {p}", True, dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 1)) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, "id long, path string, name string, size long, hash string, file_type string, content string, is_supported boolean, created_at timestamp, updated_at timestamp")


def _contents(spark, paths):
    return spark.createDataFrame([(p, p.rpartition("/")[2], 2, None, "text", f"new {p}", True) for p in paths], "path string, name string, size long, hash string, file_type string, content string, is_supported boolean")


def sequentially(paths, events, readable):
    """The events one after the other: {path: (old path or None for an added file, read anew)} of what is left."""
    state = {p: [p, False] for p in paths}
    for kind, path, old in events:
        if kind == "deleted":
            state.pop(path, None)
        elif kind == "renamed" and old and old != path:
            file = state.pop(old, [None, True])
            state[path] = [file[0], True]
        elif kind in ("created", "modified", "renamed"):
            state.setdefault(path, [None, True])[1] = True
        elif kind == "folder_deleted":
            state = {p: f for p, f in state.items() if not p.startswith(path + "/")}
        elif kind == "folder_renamed":
            inside = {p: f for p, f in state.items() if p.startswith(old + "/")}
            state = {p: f for p, f in state.items() if p not in inside and not p.startswith(path + "/")}
            state |= {path + p[len(old) :]: f for p, f in inside.items()}
    return {p: (o, new and p in readable) for p, (o, new) in state.items() if o or p in readable}


CASES = {
    "rotation": [("renamed", "/log.2", "/log.1"), ("renamed", "/log.1", "/log"), ("created", "/log", None)],
    "swap": [("renamed", "/t", "/a"), ("renamed", "/a", "/b"), ("renamed", "/b", "/t")],
    "modified after a move": [("renamed", "/b", "/a"), ("modified", "/b", None)],
    "deleted after a move": [("renamed", "/b", "/a"), ("deleted", "/b", None)],
    "modified before a move": [("modified", "/a", None), ("renamed", "/c", "/a")],
    "long chain": [("renamed", f"/x{k + 1}", f"/x{k}" if k else "/a") for k in range(14)],
    "folder goes after a file came": [("created", "/d/new", None), ("folder_deleted", "/d", None), ("created", "/d/late", None)],
    "folder moves": [("created", "/d/new", None), ("folder_renamed", "/e", "/d"), ("renamed", "/e/y", "/e/x"), ("folder_renamed", "/f", "/e"), ("modified", "/f/new", None)],
    "folder within": [("folder_renamed", "/d/s/t", "/d/s"), ("folder_deleted", "/d/s", None)],
}


def _fold(spark, paths, events, readable):
    changes = spark.createDataFrame([event(k, e, p, o, minute=0) for k, (e, p, o) in enumerate(events)], SCHEMA)
    out = ch.apply_changes(_files(spark, paths), changes, _contents(spark, readable), F.lit("2025-01-01").cast("timestamp"))
    rows = out.collect()
    assert len({r["id"] for r in rows}) == len(rows) == len({r["path"] for r in rows})
    for r in rows:
        assert r["name"] == r["path"].rpartition("/")[2]
    return {r["path"]: (paths[r["id"]] if r["id"] < len(paths) else None, r["content"] == f"new {r['path']}") for r in rows}


def _in_volume(k, paths, events, readable):
    """The same below a folder of its own, so that one batch holds many cases."""
    at = lambda p: p and f"/v{k}{p}"
    return [at(p) for p in paths], [(e, at(p), at(o)) for e, p, o in events], [at(p) for p in readable]


def test_changes_of_one_batch(spark):
    paths = ["/a", "/b", "/log", "/log.1", "/log.2", "/d/x", "/d/s/z", "/keep"]
    readable = ["/a", "/b", "/c", "/log", "/log.1", "/x14", "/d/new", "/d/late", "/f/new", "/e/y"]
    cases = [_in_volume(k, paths, events, readable) for k, events in enumerate(CASES.values())]
    got = _fold(spark, *(sum(x, []) for x in zip(*cases)))
    for k, (name, case) in enumerate(zip(CASES, cases)):
        assert {p: v for p, v in got.items() if p.startswith(f"/v{k}/")} == sequentially(*case), name


def _random_case(seed):
    rng = random.Random(seed)
    folders = ["", "/d", "/d/s", "/e"]
    path = lambda: f"{rng.choice(folders)}/{rng.choice('abc')}"
    paths = sorted({path() for _ in range(9)})
    events = []
    for _ in range(40):
        kind = rng.choice(["created", "modified", "deleted", "renamed", "renamed", "renamed", "folder_renamed", "folder_deleted"])
        if kind.startswith("folder"):
            if rng.random() < 0.6:
                continue
            old, new = rng.sample([f for f in folders if f], 2)
            if kind == "folder_renamed" and (old.startswith(new) or new.startswith(old)):
                continue
            events.append((kind, new, old if kind == "folder_renamed" else None))
        else:
            events.append((kind, path(), path() if kind == "renamed" else None))
    return paths, events, sorted({path() for _ in range(9)})


def test_random_batches_equal_a_loop(spark):
    cases = [_in_volume(seed, *_random_case(seed)) for seed in range(40)]
    got = _fold(spark, *(sum(x, []) for x in zip(*cases)))
    for seed, case in enumerate(cases):
        assert {p: v for p, v in got.items() if p.startswith(f"/v{seed}/")} == sequentially(*case), seed


def test_folding_a_stream(spark, tmp_path):
    store = ch.FilesTable(spark, str(tmp_path / "table"))
    store.write(_files(spark, ["/a", "/b", "/e", "/keep"]), -1)
    feed = tmp_path / "feed"
    feed.mkdir()
    batches = [[("modified", "/a", None), ("renamed", "/c", "/b")], [("deleted", "/e", None), ("created", "/n", None), ("renamed", "/d", "/c")]]
    for k, events in enumerate(batches):
        lines = [{"type": "event", "event": e, "path": p, "oldPath": o, "volume": "/", "timestamp": 1_704_067_200_000 + 1000 * (10 * k + n), "isDirectory": False} for n, (e, p, o) in enumerate(events)]
        (feed / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        contents = _contents(spark, ["/a", "/n"])
        stream = ch.stream_changes(readers.read_change_feed(spark, str(feed)))
        run = stream.writeStream.foreachBatch(lambda d, n, c=contents: store.fold(d, n, c)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {r["path"]: r["content"] for r in store.read().collect()}
    assert got == {"/a": "new /a", "/d": "old /b", "/n": "new /n", "/keep": "old /keep"}, got
    store.fold(spark.createDataFrame([event(1, "deleted", "/a")], SCHEMA), 0, _contents(spark, ["/a"]))  # seen before
    assert "/a" in {r["path"] for r in store.read().collect()}
    store.compact()
    assert {r["path"]: r["content"] for r in store.read().collect()} == got
    store.compact()
    assert {r["path"]: r["content"] for r in store.read().collect()} == got
    assert len(list((tmp_path / "table" / "rows").iterdir())) == len(list((tmp_path / "table" / "contents").iterdir())) == 2


def _streamed(spark, tmp_path, build, name):
    schema = spark.read.parquet(f"{DIR}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{DIR}/events*.parquet")
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_streams_equal_their_batches_in_closed_windows(spark, tmp_path):
    batch = tables.changes(spark, DIR)
    for name, build in {"pending": ch.dedup_pending, "state": ch.pending_state, "counts": ch.windowed_event_counts}.items():
        got = {tuple(r) for r in _streamed(spark, tmp_path, lambda s, b=build: b(ch.stream_changes(tables.as_changes(s))), name).collect()}
        want = {tuple(r) for r in build(ch.stream_changes(batch)).collect()}
        open_ = max(w[0] for w in want) - dt.timedelta(minutes=30)
        assert got <= want and {w for w in want if w[0] < open_} <= got, name


def test_debounced_stream(spark, tmp_path):
    log = lambda e: e.select("user_id", F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("ts"))
    got = {tuple(r) for r in _streamed(spark, tmp_path, lambda s: ch.debounce_queries(log(s).withWatermark("ts", "10 minutes"), "1 hour"), "bursts").collect()}
    want = {tuple(r) for r in ch.debounce_queries(log(spark.read.parquet(f"{DIR}/events.parquet")), "1 hour").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_renames_in_streams(spark, tmp_path):
    row = lambda f, m, p: (f, dt.datetime(2024, 1, 1, 0, m, tzinfo=UTC), p)
    schema = "file_id long, ts timestamp, path string"
    old, new = [row(1, 1, "/a"), row(2, 1, "/x"), row(9, 50, "/z")], [row(1, 2, "/b"), row(2, 30, "/y"), row(3, 5, "/n"), row(9, 59, "/zz")]
    for side, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / side))
    read = lambda s: spark.readStream.schema(schema).parquet(str(tmp_path / s)).withWatermark("ts", "1 minute")
    out = ch.pair_renames_stream(read("old"), read("new"), "5 minutes")
    run = out.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["file_id"], r["old_path"]) for r in spark.table("pairs").collect()}
    assert {(1, "/a"), (2, None), (3, None)} <= got
    records = spark.createDataFrame([(f, k, t, e, p) for e, rows in (("rename_old", old), ("rename_new", new)) for k, (f, t, p) in ((r[1].minute * 2 + (e == "rename_new"), r) for r in rows)], "file_id long, seq long, ts timestamp, event string, path string")
    assert {(r["file_id"], r["old_path"]) for r in ch.pair_renames(records, "5 minutes").collect()} == {(1, "/a"), (2, None), (3, None), (9, None)}
