"""The trie of prefixes against a plain one, with components split over tasks and inside them, and against DuckDB."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillmill.llm import prefix_trie as pt

DIR = "/root/testdata/sf0.01"
COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    old = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    new = {}
    for c, ts in old.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        new[c] = old.get(base, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
        ends[tuple(new[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    out = []
    for node, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def run(spark, rows, most=pt.MOST, parts=3):
    df = spark.createDataFrame(rows, COLUMNS).repartition(parts).selectExpr("*", "'x' AS pos", "1 AS k", "turn AS rep")
    return sorted(map(tuple, pt.trie(df, most).collect()), key=str)


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    got = sorted(map(tuple, pt.trie(spark.read.parquet(f"{DIR}/conversations.parquet")).collect()), key=str)
    assert got == sorted(con.execute(pt.SQL).fetchall(), key=str)


@pytest.mark.parametrize("most", [1, 5, pt.MOST])
def test_against_a_plain_trie(spark, monkeypatch, most):
    """Few different turns, so that many conversations share long beginnings; blocks, pieces and tasks are small."""
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "PIECE", 20)
    monkeypatch.setattr(pt, "AT_ONCE", 10)
    rnd = random.Random(most)
    rows = [(c, t, rnd.choice("ab"), rnd.choice(["x", "é"]) if t < 12 else f"{c}") for c in rnd.sample(range(-40, 400), 90) for t in range(rnd.choice([0, 1, 3, 9, 11, 15, 30]))]
    rows += [(1000 + i, t, "a", f"same {t}") for i in range(40) for t in range(10)]
    got = run(spark, rows, most)
    assert got == plain(rows)
    assert max(r[3] for r in got if r[1] > 3) >= 30


def test_odd_rows(spark):
    rows = [(None, 1, "a", "b"), (1, None, "a", None), (1, None, None, "z"), (1, 3, "b", ""), (1, 3, "a", "tie"), (1, 3, "a", "tie"), (2, 0, "a:", "b"), (2, 1, "a", ":b"), (7, 0, "", "long " * 50_000), (-3, 1, "a", "b"), (-5, 1, "a", "c"), (20, 1, None, None)]
    rows += [(5, t, "u", str(t % 3)) for t in range(700)]
    assert run(spark, rows, 50) == plain(rows)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_decompose():
    """A chain, a star and a random tree at once."""
    rnd = random.Random(3)
    top, depth, parent, size, values = [], [], [], [], []
    for comp, n in enumerate((300, 300, 500)):
        up = [-1] + [k - 1 if comp == 0 else 0 if comp == 1 else rnd.randrange(k) for k in range(1, n)]
        d = [0] * n
        for k in range(1, n):
            d[k] = d[up[k]] + 1
        order = sorted(range(n), key=lambda k: d[k])
        place = {k: i for i, k in enumerate(order)}
        s = [1] * n
        for k in range(n - 1, 0, -1):
            s[up[k]] += s[k]
        start = len(top)
        top += [comp] * n
        depth += [d[k] for k in order]
        parent += [-1 if up[k] < 0 else start + place[up[k]] for k in order]
        size += [s[k] for k in order]
        values += [rnd.randrange(100) for _ in order]
    sums = pt.decompose(np.array(top), np.array(depth), np.array(parent), np.array(size), np.array([values, size]))
    want = np.array([values, size])
    for k in sorted(range(len(top)), key=lambda k: -depth[k]):
        if parent[k] >= 0:
            want[:, parent[k]] += want[:, k]
    assert (sums == want).all()
