"""Toxicity: held-out accuracy on given tables, the counts against a plain loop, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np

from quillmill.llm import toxicity as tox

DIR = "/root/testdata/sf0.01"


def plain_rows(text):
    out = []
    word = ""
    table = tox.symbol_table()
    for ch in text.lower() + " ":
        unit = ch.encode("utf-16-le")
        for k in range(0, len(unit), 2):
            s = int(table[int.from_bytes(unit[k : k + 2], "little")])
            if s != 32:
                word += chr(s)
                out.append(word[-tox.ORDER :])
            elif word:
                out.append((word + " ")[-tox.ORDER :])
                word = ""
    return out


def as_text(row):
    return bytes(b for b in int(row).to_bytes(8, "big") if b).decode("latin-1")


def test_rows_of():
    texts = ["Hello, World! it's", "", None, "éà ß  x1y", "internationalisation", "...", "日本 𝒳"]
    rows, counts = tox.rows_of(texts)
    want = [plain_rows(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert [as_text(r) for r in rows] == [r for w in want for r in w]


def test_counts(spark):
    rows = [("the cat sat", 0, 0), ("the dog", 0, 1), ("the cat", 1, 1), (None, 1, 0)]
    got = {as_text(r["row"]): tuple(r)[1:] for r in tox.count_rows(spark.createDataFrame(rows, "text string, fold int, label int")).collect()}
    want = {}
    for text, fold, label in rows:
        for row, n in Counter(plain_rows(text or "")).items():
            v = want.setdefault(row, [0, 0, 0, 0])
            v[fold * 2 + label] += n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_differences_against_a_loop(spark):
    counts = {"\0a": (8, 2), "ab": (6, 2), "ac": (2, 0), "abc": (30, 1), "abd": (1, 9), "xbc": (1, 0), "bc": (4, 4)}
    coded = [(int.from_bytes(k.replace("\0", "").encode(), "big"), *v) for k, v in counts.items()]
    n0, n1 = sum(v[1] for v in coded), sum(v[2] for v in coded)
    coded = {r: (a * n1 / n0, b) for r, a, b in coded}
    context = {}
    for r in coded:
        context.setdefault(r >> 8, []).append(r)
    d = tox.DISCOUNT

    def shared(row):
        p = 1 / 256
        for m, longer in ((2, {r & 0xFFFFFFFF for r in coded}), (4, set(coded))):
            mask = (1 << 8 * m) - 1
            kinds = Counter(r & mask for r in longer)
            here = row & mask
            around = {g: k for g, k in kinds.items() if g >> 8 == here >> 8}
            s = sum(around.values())
            p = max(kinds[here] - tox.SHARED_DISCOUNT, 0) / s + tox.SHARED_DISCOUNT * len(around) / s * p
        return p

    def p(row, c):
        s = sum(coded[r][c] for r in context[row >> 8])
        m = sum(min(coded[r][c], d) for r in context[row >> 8])
        return max(coded[row][c] - d, 0) / s + m / s * shared(row) if s else shared(row)

    df = spark.createDataFrame([(int.from_bytes(k.replace("\0", "").encode(), "big"), *v) for k, v in counts.items()], "row long, n0 long, n1 long")
    rows, contexts = tox.differences(df)
    got = {r["row"]: r["value"] for r in rows.collect()}
    assert set(got) == set(coded)
    for r, v in got.items():
        assert abs(v - (np.log(p(r, 1)) - np.log(p(r, 0)))) < 1e-9
    assert {r["row"] for r in contexts.collect()} == set(context)


def test_a_model_is_planned_in_small_parts(spark):
    df = spark.createDataFrame([(0x6162, 8, 2), (0x6163, 2, 0), (0x61626364, 3, 9)], "row long, n0 long, n1 long")
    rows, _ = tox.differences(df)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") == 1, plan
    assert rows.count() == 3


def test_table_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**55, 50_000))
    values = rng.normal(size=len(keys)).astype(np.float32)
    t = tox.Table(keys, values)
    got, held = t.find(np.concatenate([keys, keys + 1]))
    assert held[: len(keys)].all() and (got[: len(keys)] == values).all()
    assert (held[len(keys) :] == np.isin(keys + 1, keys)).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    got = tox.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert len(got) > 60 and (toxic.predicted == 1).mean() > 0.6
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.95


def plain_scores(rows, labels):
    """Every step of the module's text in plain loops; rows: (id, text), labels: (id, toxic)."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    known = {i: t for i, t in labels}
    taught = [(i, t) for i, t in rows if i in known and fold(i) != 2]

    def model(folds):
        n = [Counter(), Counter()]
        for i, t in taught:
            if fold(i) in folds:
                n[known[i]].update(plain_rows(t or ""))
        scale = sum(n[1].values()) / max(sum(n[0].values()), 1)
        n[0] = {r: k * scale for r, k in n[0].items()}
        rows_ = set(n[0]) | set(n[1])
        by = [{}, {}]
        for r in rows_:
            for c in (0, 1):
                s, m = by[c].get(r[:-1], (0, 0))
                by[c][r[:-1]] = (s + n[c].get(r, 0), m + min(n[c].get(r, 0), tox.DISCOUNT))
        levels = []
        longer = rows_
        for m in tox.SHARED:
            kinds = Counter(r[-m:] for r in longer)
            around = {}
            for g, k in kinds.items():
                s, t = around.get(g[:-1], (0, 0))
                around[g[:-1]] = (s + k, t + 1)
            levels.append((m, kinds, around))
            longer = {r[-m:] for r in longer}

        def shared(r):
            p = 1 / 256
            for m, kinds, around in reversed(levels):
                s, t = around[r[-m:][:-1]]
                p = max(kinds[r[-m:]] - tox.SHARED_DISCOUNT, 0) / s + tox.SHARED_DISCOUNT * t / s * p
            return p

        def back(h, c):
            s, m = by[c].get(h, (0, 0))
            return m / s if s else 1.0

        def value(r):
            h = r[:-1]
            if r not in rows_:
                return math.log(back(h, 1)) - math.log(back(h, 0)) if h in by[0] else 0.0
            p = [max(n[c].get(r, 0) - tox.DISCOUNT, 0) / by[c][h][0] + back(h, c) * shared(r) if by[c][h][0] else shared(r) for c in (0, 1)]
            return math.log(p[1]) - math.log(p[0])

        return value

    def sums(text, value):
        words, now = [], []
        for r in plain_rows(text or ""):
            now.append(r)
            if r.endswith(" "):
                words.append((len(now), sum(map(value, now))))
                now = []
        over = [sum(v > k for _, v in words) for k in tox.LEVELS] + [sum(max(v - tox.LEVELS[0], 0) for _, v in words)]
        return [sum(n for n, _ in words), len(words), sum(v for _, v in words), *over]

    first, both = model({0, 1}), model({0, 1, 3})
    curve = [(i, t) for i, t in taught if fold(i) == 3]
    beta = tox.fit_curve(tox.features(np.array([sums(t, first) for _, t in curve])), np.array([known[i] for i, _ in curve], dtype=float))
    x = tox.features(np.array([sums(t, both) for _, t in rows]))
    return {i: 1 / (1 + math.exp(-min(max(z, -30), 30))) for (i, _), z in zip(rows, x @ beta)}


def test_scores_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    fine, bad = ["the", "river", "walks", "over", "stones", "and", "trees", "sing"], ["scumbag", "idiots", "filthy"]
    rows, labels = [], []
    for i in range(120):
        toxic = int(rng.random() < 0.4)
        words = list(rng.choice(fine, int(rng.integers(1, 40))))
        for w in rng.choice(bad, 3 * toxic):
            words.insert(int(rng.integers(0, len(words) + 1)), w)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, toxic))
    rows += [(1000, ""), (1001, None), (1002, "été, 日本 SCUMBAG")]
    want = plain_scores(rows, labels)
    got = tox.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-3, (r, want[r["doc_id"]])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, ""), (None, "x"), (1, "fine words here"), (4, "scum " * 50_000)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'a' AS score", "1 AS held_out", "'b' AS id")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tox.score(docs, none).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    labels = spark.createDataFrame([(i, 1, t) for i, t in ((1, 0), (2, 0), (3, 1), (4, 1), (None, 1), (99, 1))], "doc_id long, quality int, toxic int")
    got = tox.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score(docs.limit(0), labels).count() == 0
    kept = tox.reject(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    want = {r["doc_id"]: r["score"] for r in tox.score(docs, labels).collect()}
    monkeypatch.setattr(tox, "SENT", 100)
    monkeypatch.setattr(tox, "ROWS", 200)
    got = {r["doc_id"]: r["score"] for r in tox.score(docs, labels).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6
    kept = {r["doc_id"] for r in tox.reject(docs, labels).collect()}
    assert kept == {i for i, p in want.items() if p < tox.THRESHOLD}
