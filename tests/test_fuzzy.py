"""The fuzzy re-rank reads whole contents and all hits of a search."""

import numpy as np

from quillmill.operators import fuzzy
from quillmill.plans import queries
from quillmill.plans import search as plans
from quillmill.plans import tables as t

DIR = "/root/testdata/sf0.001"


def loop_errors(pattern, text):
    row = [0] * (len(text) + 1)
    for i, ch in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != ch)))
    return min(row)


def test_blocks_against_a_loop(monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 16)
    monkeypatch.setattr(fuzzy, "LANES", 7)
    rng = np.random.default_rng(5)
    for _ in range(200):
        text, pattern = ("".join(rng.choice(list("abc"), int(rng.integers(low, high)))) for low, high in ((0, 120), (2, 12)))
        assert fuzzy.substring_errors(pattern, text) == loop_errors(pattern, text)


def test_many_pairs_at_once_against_a_loop(monkeypatch):
    rng = np.random.default_rng(6)
    for block, lanes in ((512, 4096), (40, 5)):
        monkeypatch.setattr(fuzzy, "BLOCK", block)
        monkeypatch.setattr(fuzzy, "LANES", lanes)
        pairs = [tuple("".join(rng.choice(list("abé😀"), int(rng.integers(low, high)))) for low, high in ((1, 33), (0, 150))) for _ in range(150)]
        pairs += [("x" * 32, ""), ("x" * 32, "y" * 90), ("ab", "\ud800ab"), ("é" * 32, "é" * 31)]
        assert list(fuzzy.least_errors(pairs)) == [loop_errors(p, t) for p, t in pairs]
    assert list(fuzzy.least_errors([])) == []


def test_slices_and_joins_give_the_same(spark, monkeypatch):
    """A file hit by many queries, files without name or content, ties and repeated hits, queries too short or null; sent or joined."""
    names = [(1, "report.txt", "The quarterly reprot of the board, and more. " * 30), (2, None, "nothing near"), (3, "summary of a report", None), (4, "", ""), (5, "a\u00e9", "a" * 3000 + "board" + "b" * 3000)]
    asked = ["report", "board", "quartely", "x", "", None, "zzzzqqq", "a\u00e9", "The quarterly report of the whole board and nothing else"]
    files = spark.createDataFrame(names, "id long, name string, content string")
    hits = spark.createDataFrame([(k, i, q) for k, q in enumerate(asked) for i in (1, 2, 3, 4, 5, 9)] + [(0, 1, "report")], "query_id int, id long, query string")
    text = {i: (n, c) for i, n, c in names}
    want = sorted((r["query_id"], r["id"], round(s, 6)) for r in hits.collect() if r["id"] in text and (s := fuzzy.fuzzy_score(r["query"], *text[r["id"]])) is not None)
    for sent, most in ((1 << 20, 256), (0, 2)):
        monkeypatch.setattr(fuzzy, "SENT_BYTES", sent)
        monkeypatch.setattr(fuzzy, "ASKED", most)
        got = fuzzy.fuzzy_rerank(hits, files)
        assert got.columns == ["query_id", "id", "query", "fuzzy_score"]
        assert sorted((r["query_id"], r["id"], round(r["fuzzy_score"], 6)) for r in got.collect()) == want
    assert len(want) == 8 and fuzzy.fuzzy_rerank(hits.limit(0), files).count() == 0


def test_a_late_match_counts():
    assert fuzzy.fuzzy_score("needle", None, "x " * 6000 + "needle") is not None


def test_rerank_query_against_a_loop(spark):
    i, q = queries._index(spark, DIR), t.words(spark, DIR, 2)
    hits = plans.with_content(plans.search(i, q, plans.Options(k=200)), i.files).join(q, "query_id").select("query_id", "id", "query", "name", "content").collect()
    want = {(r["query_id"], r["id"]): fuzzy.fuzzy_score(r["query"], r["name"], r["content"]) for r in hits}
    want = {k: round(v, 6) for k, v in want.items() if v is not None}
    got = {(r["query_id"], r["id"]): r["fuzzy_score"] for r in queries.t17_fuzzy_rerank(spark, DIR).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert max(np.unique([k for k, _ in want], return_counts=True)[1]) > 20
