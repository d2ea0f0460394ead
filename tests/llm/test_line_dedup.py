"""Line dedup against DuckDB and on odd rows."""

import duckdb

from quillmill.llm import line_dedup as ld

DIR = "/root/testdata/sf0.001"


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = ld.line_dedup(spark.read.parquet(f"{DIR}/documents.parquet")).select("doc_id", "text", "n_lines_seen", "n_lines_removed").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ld.SQL).fetchall())
    assert sum(r["n_lines_removed"] for r in got) > 0


def cleaned(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, id int")
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_seen", "n_lines_removed"]
    return sorted(((r["doc_id"], r["text"], r["n_lines_removed"]) for r in out.collect()), key=str)


def test_windows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\n b \nc\ny"), (3, "b\nc\nd\ne"), (4, "a\nb"), (5, "q\nq\nq\nq\nq\nr"), (6, "a\nb\nz\nb\nc")]
    assert cleaned(spark, rows) == sorted([(1, "a\nb\nc\nd", 0), (2, "x\ny", 4), (3, "e", 3), (4, "a\nb", 0), (5, "q\nr", 4), (6, "a\nb\nz\nb\nc", 0)], key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "one\ntwo\nthree"), (4, "one\ntwo\nthree"), (None, "one\ntwo\nthree\nfour"), (5, "u\nv\nw\n" * 3), (5, "one\ntwo\nthree\nother"), (6, "long\n" + "\n".join(str(i) for i in range(60_000)))]
    want = [(1, None, 0), (2, "", 0), (3, "\n\n\n", 0), (4, "one\ntwo\nthree", 0), (4, "one\ntwo\nthree", 0), (None, "four", 3), (5, "u\nv\n", 7), (5, "other", 3), rows[-1] + (0,)]
    got = cleaned(spark, rows)
    assert [g for g in got if g[0] != 5] == sorted((w for w in want if w[0] != 5), key=str)
    assert [g for g in got if g[0] == 5 and "other" in g[1]] == [(5, "other", 3)] and len(got) == len(rows)
    assert cleaned(spark, []) == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7, "x"), (2, "a\nb\nc", 8, "y")], "doc_id long, text string, n_lines_removed int, N_lines_seen string")
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_seen_", "n_lines_removed_"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 7, "x", 3, 0), (2, "", 8, "y", 3, 3)]


def test_no_python_in_the_plan(spark):
    plan = ld.line_dedup(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_second_hashes_do_not_follow_the_first(spark):
    """xxhash64 goes on from the hash before, so what tells the two apart has to stand first: equal first hashes then say nothing of the second."""
    import pathlib
    import re

    made = spark.sql("SELECT xxhash64(a) AS x, xxhash64(a, 'second') AS y, xxhash64('second', a) AS z FROM VALUES ('a'), ('b') AS t(a)").collect()
    chained = spark.range(1).selectExpr(*[f"xxhash64(cast({r['x']} AS bigint)) AS h{k}" for k, r in enumerate(made)]).first()
    assert len({r["z"] for r in made}) == 2 and len({*chained}) == 2
    for path in pathlib.Path(ld.__file__).parent.glob("*.py"):
        assert not re.search(r"xxhash64\([^()]*(\([^()]*\))?[^()]*,\s*F\.lit\(\"second\"\)\)", path.read_text()), path
