"""Mixing against DuckDB, the stated properties, and odd rows."""

import duckdb
import pytest

from quillmill.llm import mixing as mx

DIR = "/root/testdata/sf0.001"


def reported(df):
    return sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mx.mix_report(df).collect()), key=str)


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({mx.SQL})").fetchall()
    assert reported(spark.read.parquet(f"{DIR}/documents.parquet")) == sorted(want, key=str)


@pytest.mark.parametrize("shares", [(100, 10, 1), (1, 1, 500), (30, 30, 30)])
def test_properties(spark, shares):
    rows = [(1000 * k + j, "word " * (1 + (j * 7) % 40), f"s{k}") for k, n in enumerate(shares) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = reported(df)
    assert out == reported(df.repartition(1))
    total, targets, taken = 0, {}, {}
    for _, s, size, whole, target, t in out:
        total += size
        targets[s] = target
        assert 0 <= t <= 3 * size and target <= 3 * whole
        taken[s] = taken.get(s, 0) + t
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert all(int(targets[s]) == taken[s] for s in targets)
    sizes = {i: size for i, _, size, *_ in out}
    mixed = [r["doc_id"] for r in mx.mix(df).collect()]
    for s in targets:
        assert abs(sum(sizes[i] for i in mixed if f"s{i // 1000}" == s) - targets[s]) <= 20 + 1


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", None), (4, "z " * 50_000, "t"), (5, "  \t\n", "u")]
    df = spark.createDataFrame([(i, t, s, 7, "k") for i, t, s in rows], "doc_id long, text string, source string, bin int, key string")
    out = reported(df)
    assert len(out) == len(rows) and {r[2] for r in out if r[0] in (2, 3)} == {0} and [r[2] for r in out if r[0] == 5] == [1]
    assert all(r[5] <= 3 * r[2] for r in out)
    mixed = mx.mix(df)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert mx.mix_report(df.limit(0)).count() == 0 and mx.mix(df.limit(0)).count() == 0


def test_heavier_documents_come_first_more_often(spark):
    rows = [(i, ("good words only here " if i % 2 else "%%% ### $$$ !!! ") * 5, "a" if i < 4000 else "b") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    chosen = [r["doc_id"] for r in mx.mix(df).collect() if r["doc_id"] < 4000]
    times = {i: chosen.count(i) for i in range(200)}
    good, bad = sum(times[i] for i in range(1, 200, 2)), sum(times[i] for i in range(0, 200, 2))
    assert good >= bad
