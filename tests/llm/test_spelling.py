"""Spelling variants against a plain loop over all pairs, and DuckDB."""

import random
import re
import zlib
from collections import Counter

import duckdb

from quillmill.llm import spelling as sp

DIR = "/root/testdata/sf0.001"


def near(a, b):
    """One inserted, deleted or replaced code point apart, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for id_, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, forms = [], {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best is not None and words[best] >= 10 * n else None, len(found))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, forms[w][1], words.get(forms[w][0])))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, sp.variants(df.withColumn("word", df.text).withColumn("n", df.doc_id)).collect()))


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = sp.variants(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(sp.SQL).fetchall())


def test_against_all_pairs(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcé") for _ in range(n)) for n in (7, 7, 8, 9, 10, 12, 15) for _ in range(4)]
    texts = []
    for w in base:
        copies = [w] * rnd.choice([2, 30, 400])
        for _ in range(12):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abcéÿ")
            copies += [rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])] * rnd.choice([2, 3, 25])
        texts += copies
    rnd.shuffle(texts)
    rows = [(k, " ".join(texts[k::40]) + ".") for k in range(40)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert sum(r[4] for r in got) > 100 and any(r[1] and r[2] != r[1] for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Château château CHÂTEAU"), (None, "nothing nothing"), (None, "nothing"), (4, "nothin nothings×nothings"), (4, "nothin nothings×nothings"), (5, "z" * 70_000 + " " + "z" * 70_000 + " " + "a1b " * 20_000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
