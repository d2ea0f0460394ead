"""Factorisation machine: its linear-time score against the double sum, held-out accuracy, odd rows."""

import numpy as np

from quillmill.llm import quality as q

DIR = "/root/testdata/sf0.01"


def test_score_equals_the_double_sum():
    rng = np.random.default_rng(1)
    weights = {"b": 0.3, "w": rng.normal(size=q.FEATURES), "v": rng.normal(size=(q.FEATURES, q.RANK))}
    c, x, n = q.vectors(["One two three, four.", "", None, "x" * 50, "a a a a\nb b\nb b"])
    got, _ = q.machine(weights, c, x, n)
    at = 0
    for k, size in enumerate(n):
        i, v = c[at : at + size], x[at : at + size].astype(float)
        at += size
        pairs = sum(weights["v"][i[a]] @ weights["v"][i[b]] * v[a] * v[b] for a in range(size) for b in range(a))
        assert abs(got[k] - (0.3 + weights["w"][i] @ v + pairs)) < 1e-4


def test_texts_do_not_affect_each_other():
    texts = ["One two three, four.", "", "x1 y2\n\nz", None, "Again again again AGAIN %% ##"]
    c, x, n = q.vectors(texts)
    ends = np.cumsum(n)
    for k, t in enumerate(texts):
        c1, x1, n1 = q.vectors([t])
        assert n1[0] == n[k] and (np.sort(c1) == np.sort(c[ends[k] - n[k] : ends[k]])).all() and np.allclose(np.sort(x1), np.sort(x[ends[k] - n[k] : ends[k]]))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    got = q.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 60 and (got.predicted == got.quality).mean() > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, ""), (None, "x"), (1, "fine words here"), (4, "junk " * 50_000)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'a' AS score", "1 AS held_out", "'b' AS id")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.score(docs, none).collect()
    assert len(got) == 6 and all(r["score"] == 0.5 for r in got)
    labels = spark.createDataFrame([(i, t, 1) for i, t in ((1, 0), (2, 0), (3, 1), (4, 1), (None, 1), (99, 1))], "doc_id long, quality int, toxic int")
    got = q.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert q.score(docs.limit(0), labels).count() == 0
