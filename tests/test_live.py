"""Phrases in searches, reading by parts, the index that follows its files, the versioned table and the scan, against plain loops."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.operators import match
from quillmill.plans import live_index, scan, search, tables
from quillmill.sources import written
from quillmill.sources.manifest import Manifest
from quillmill.sources.writers import bounds_of, part_of
from quillmill.streaming import changes as ch

DIR = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 1)
WORDS = "foo bar baz barn a b c food fo or that".split()


def files(spark, texts):
    rows = [(k, f"/d/n{k}.txt", f"n{k}.txt", len(c), None, "text", c, True, NOW, NOW) for k, c in texts.items()]
    return spark.createDataFrame(rows, schemas.FILES)


def asked(spark, queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def times(held, words, last_is_prefix):
    """How often the words stand in a row in any of the fields."""
    fits = lambda w, t, k: t.startswith(w) if last_is_prefix and k == len(words) - 1 else t == w
    return sum(all(fits(w, ts[i + k], k) for k, w in enumerate(words)) for ts in held for i in range(len(ts) - len(words) + 1))


def plain_search(texts, query):
    """{id: rank} by the rules: expressions in order, NOT before what is excluded, OR makes any of them enough."""
    held = {k: [tokens(f"n{k}.txt"), tokens(c), ["text"]] for k, c in texts.items()}
    parts = re.findall(r'"[^"]+"|\S+', query)
    want, bad, any_ = [], [], False
    i = 0
    while i < len(parts):
        word = parts[i].upper()
        if word == "NOT" and i + 1 < len(parts):
            bad.append(parts[i + 1])
            i += 1
        elif word == "OR":
            any_ = True
        elif word != "AND":
            want.append(parts[i])
        i += 1
    count = lambda k, e: times(held[k], tokens(e), not e.startswith('"') and not e.endswith("*"))
    f = {e: {k: n for k in held if (n := count(k, e))} for e in {*want, *bad}}
    length = {k: sum(map(len, h)) for k, h in held.items()}
    mean = sum(length.values()) / len(length)
    out = {}
    for k in held:
        if any(k in f[e] for e in bad) or not (any if any_ else all)(k in f[e] for e in want):
            continue
        rank = 0.0
        for e in want:
            if k in f[e]:
                idf = math.log((len(held) - len(f[e]) + 0.5) / (len(f[e]) + 0.5))
                rank -= (idf if idf > 0 else 1e-6) * f[e][k] * 2.2 / (f[e][k] + 1.2 * (0.25 + 0.75 * length[k] / mean))
        out[k] = round(rank, 9)
    return out


QUERIES = ["foo-bar", '"foo bar"', '"foo bar" baz', 'a NOT "b c"', "foo NOT foo-bar", '"or that"', 'baz OR "a b"', 'foo OR "b c" NOT "bar baz"', '"a b c"', "a-b-c", "foo", "a b c", '"foo bar" AND "bar baz"', "b-c NOT c-a", "fo* bar", '"foo foo"']


def test_phrases_against_a_loop(spark):
    rnd = random.Random(11)
    texts = {k: " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([2, 4, 8, 30, 90]))) for k in range(80)}
    index = search.Index.of(files(spark, texts))
    got = {q: {} for q in range(len(QUERIES))}
    for r in search.search(index, asked(spark, QUERIES)).collect():
        got[r["query_id"]][r["id"]] = round(r["rank"], 9)
    for k, q in enumerate(QUERIES):
        want = plain_search(texts, q)
        assert got[k].keys() == want.keys(), q
        assert all(abs(got[k][i] - want[i]) < 1e-8 for i in want), q
    assert got[0] and got[1] and got[3]


def test_operators_inside_of_quotes_and_odd_quotes(spark):
    texts = {1: "this or that", 2: "that this", 3: "salt not pepper", 4: "salt", 5: "foo and bar", 6: "bar foo"}
    index = search.Index.of(files(spark, texts))
    cases = {'"this or that"': {1}, "this or zzz": {1, 2}, '"salt not pepper"': {3}, "salt NOT pepper": {4}, '"foo': {5, 6}, 'bar "foo': {5, 6}, '"foo and bar"': {5}, 'name:n6 "foo and bar"': {6}}
    got = {}
    for r in search.search(index, asked(spark, cases)).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert {q: got.get(k, set()) for k, q in enumerate(cases)} == cases


def test_ten_queries_read_a_tenth_of_the_postings(spark, tmp_path):
    f = tables.files(spark, DIR)
    index = search.Index.build(f, str(tmp_path / "i"), part_rows=400)
    q = tables.words(spark, DIR, 1, 4).where("length(query) >= 6").orderBy("query_id").limit(10)
    pruned = index.postings_of(match.expand_terms(match.query_terms(q), index.vocabulary))
    assert len(index.bounds) > 50 and pruned.count() * 10 < index.postings.count()
    assert "PartitionFilters: [" in (plan := pruned._jdf.queryExecution().executedPlan().toString()) and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    key = lambda i: sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in search.search(i, q).collect())
    assert key(index) == key(search.Index.of(f))


def test_bounds(spark):
    """Parts of about equal weight; a term of many shares has a part of its own; the parts follow the order of terms."""
    vocabulary = spark.createDataFrame([(f"t{k:04}", 10 if k != 500 else 4000, 10) for k in range(1000)], schemas.VOCABULARY)
    bounds = bounds_of(vocabulary, 1000)
    assert bounds == sorted(bounds) and 8 < len(bounds) < 15
    parts = vocabulary.withColumn("part", part_of(F.col("term"), bounds)).collect()
    assert [sum(b <= r["term"] for b in bounds) for r in parts] == [r["part"] for r in parts]
    assert bounds_of(vocabulary.limit(0)) == [] and bounds_of(vocabulary, 10**9) == []


def test_document_as_query_against_a_loop(spark):
    rnd = random.Random(5)
    texts = {k: " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 9, 25]))) for k in range(60)}
    index = search.Index.of(files(spark, texts))
    docs = ["foo bar", "a b c or", "foo nowhere", "", "that that THAT", "n7"]
    found = search.search_document_as_query(index, spark.createDataFrame(list(enumerate(docs)), "query_id int, text string"), search.Options(k=10**9)).collect()
    want = {(k, i) for k, d in enumerate(docs) if tokens(d) for i, c in texts.items() if {*tokens(d)} <= {*tokens(c), *tokens(f"n{i}.txt"), "text"}}
    assert {(r["query_id"], r["id"]) for r in found} == want and want


def test_an_index_that_follows_its_files(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([3, 9, 25])))
    now = {k: text() for k in range(60)}
    live = live_index.LiveIndex(spark, str(tmp_path / "live"))
    live.create(files(spark, now), part_rows=60)
    for batch in range(6):
        changed, deleted = rnd.sample(sorted(now), 6), []
        deleted = changed[:2]
        before = {k: now[k] for k in changed}
        for k in deleted:
            del now[k]
        after = {k: text() for k in [*changed[2:], 100 + 2 * batch, 101 + 2 * batch]}
        now |= after
        if batch == 2:  # breaks off before the manifest: nothing has happened
            with monkeypatch.context() as m:
                m.setattr(Manifest, "put", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    live.update(files(spark, before), files(spark, after), batch)
        live.update(files(spark, before), files(spark, after), batch)
        live.update(files(spark, {}), files(spark, {1: "seen before"}), batch)
    state = live.held.state()
    assert len(state["segments"]) < 5 and any(s["name"].startswith("merged") for s in state["segments"])
    table = files(spark, now)
    got, want = live.read(table), search.Index.of(table)
    q = asked(spark, QUERIES)
    key = lambda i: sorted((r["query_id"], r["id"], round(r["rank"], 9)) for r in search.search(i, q).collect())
    assert key(got) == key(want)
    words = lambda i: sorted(map(tuple, i.vocabulary.select("term", "n_docs", "n_occurrences").collect()))
    assert words(got) == words(want)
    docs = spark.createDataFrame([(0, "foo bar"), (1, "a b")], "query_id int, text string")
    division = lambda i: sorted(map(tuple, search.search_document_as_query(i, docs, search.Options(k=10**9)).collect()))
    assert division(got) == division(want)
    live.merge()
    whole = live.read(table)
    assert key(whole) == key(want) and words(whole) == words(want) and whole.gone is None
    assert len(list((tmp_path / "live" / "segments").iterdir())) <= len(state["segments"]) + 1


def _table(spark, paths):
    rows = [(k, p, p.rpartition("/")[2], 1, None, "text", f"old {p}", True, NOW, NOW) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, schemas.FILES)


def _events(spark, events):
    return spark.createDataFrame([(k, NOW, e, p, o) for k, (e, p, o) in enumerate(events)], "seq long, ts timestamp, event string, path string, old_path string")


def _told(spark, texts):
    return spark.createDataFrame([(p, p.rpartition("/")[2], len(c), c, "text", c, True) for p, c in texts], "path string, name string, size long, hash string, file_type string, content string, is_supported boolean")


def contents(table):
    return {r["path"]: r["content"] for r in table.read().collect()}


def test_a_path_that_contents_name_twice(spark, tmp_path):
    table = ch.FilesTable(spark, str(tmp_path / "t"), buckets=4)
    table.write(_table(spark, ["/a", "/b"]), -1)
    told = _told(spark, [("/a", "x"), ("/a", "xx"), ("/a", "xx"), ("/n", "y"), ("/n", "yy")])
    table.fold(_events(spark, [("modified", "/a", None), ("created", "/n", None)]), 0, told)
    assert table.read().count() == 3 and contents(table) == {"/a": "xx", "/b": "old /b", "/n": "yy"}
    out = ch.apply_changes(_table(spark, ["/a"]), _events(spark, [("modified", "/a", None)]), told, F.lit(NOW).cast("timestamp"))
    assert out.count() == 1


@pytest.mark.parametrize("step", ["_put_contents", "_put_rows", "_put"])
@pytest.mark.parametrize("what", ["fold", "compact"])
def test_a_fault_leaves_the_table_readable(spark, tmp_path, monkeypatch, step, what):
    table = ch.FilesTable(spark, str(tmp_path / "t"), buckets=4)
    table.write(_table(spark, ["/a", "/b", "/c"]), -1)
    table.fold(_events(spark, [("modified", "/b", None)]), 0, _told(spark, [("/b", "b2")]))
    was = contents(table)
    do = (lambda: table.fold(_events(spark, [("modified", "/a", None), ("deleted", "/c", None)]), 1, _told(spark, [("/a", "a2")]))) if what == "fold" else table.compact
    with monkeypatch.context() as m:
        real = getattr(ch.FilesTable, step)

        def broken(self, *args):
            if step != "_put":
                real(self, *args)
            raise OSError("lost")

        m.setattr(ch.FilesTable, step, broken)
        with pytest.raises(OSError, match="lost"):
            do()
    assert contents(table) == was == {"/a": "old /a", "/b": "b2", "/c": "old /c"}
    do()
    assert contents(table) == ({"/a": "a2", "/b": "b2"} if what == "fold" else was)


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    table = ch.FilesTable(spark, str(tmp_path / "t"), buckets=32)
    table.write(_table(spark, [f"/d/{k}" for k in range(300)]), -1)
    left = {*written._LEFT}
    table.fold(_events(spark, [("modified", "/d/7", None), ("renamed", "/e", "/d/8"), ("deleted", "/d/9", None)]), 0, _told(spark, [("/d/7", "new")]))
    versions = table.state()["rows"]
    assert len({*versions.values()}) == 2 and sorted(map(list(versions.values()).count, {*versions.values()}))[0] <= 3
    got = contents(table)
    assert len(got) == 299 and got["/d/7"] == "new" and got["/e"] == "old /d/8" and got["/d/10"] == "old /d/10"
    assert {*written._LEFT} == left  # what the batch wrote on the way is gone


def test_a_scan_opens_only_what_is_to_be_read(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k in range(30):
        (root / f"f{k}.txt").write_text(f"text {k}")
    (root / "odd [1]{a}*.txt").write_text("odd name")
    none = tables.files(spark, DIR).limit(0)
    now = F.current_timestamp()
    first = written.written(scan.scan_rows(scan.readers.read_files(spark, str(root)), none, now, None, str(root), str(root)), "first")
    assert {r["name"]: r["content"] for r in first.collect()} == {f"f{k}.txt": f"text {k}" for k in range(30)} | {"odd [1]{a}*.txt": "odd name"}
    (root / "f1.txt").write_text("longer text")
    (root / "f2.txt").unlink()
    (root / "new [2].txt").write_text("new")
    files = scan.readers.read_files(spark, str(root))
    wanted = scan.to_read(scan.listed(files), first)
    assert {r["path"].rpartition("/")[2] for r in wanted.collect()} == {"f1.txt", "new [2].txt"}
    opened = scan.opened(files, written.written(wanted, "wanted"))
    scans = re.findall(r"FileScan binaryFile \[([^\]]*)\]", opened._jdf.queryExecution().executedPlan().toString())
    assert opened.count() == 2 and sum("content#" in x for x in scans) == 1
    second = scan.scan_rows(files, first, now, None, str(root), str(root))
    got = {r["name"]: r["content"] for r in second.collect()}
    assert len(got) == 31 and got["f1.txt"] == "longer text" and got["new [2].txt"] == "new" and "f2.txt" not in got and got["f3.txt"] == "text 3"
    stay = scan.scan_rows(files, first, now)
    assert "f2.txt" in {r["name"] for r in stay.collect()}
