"""Near duplicates against all pairs."""

import numpy as np
import pytest

from quillmill.llm import minhash_dedup as md

DIR = "/root/testdata/sf0.001"


def shingle_set(text):
    w = [x for x in (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").split(" ") for x in x.split()]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, similarity=0.8):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in md.near_duplicates(df).collect()), key=str)


def make(n, hot, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    word = lambda k: list(rng.choice(vocabulary, k))
    texts = [word(int(rng.integers(1, 120))) for _ in range(n)]
    base = word(100)
    for _ in range(hot):
        t = list(base)
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(0, 100))] = str(rng.choice(vocabulary))
        texts.append(t)
    for _ in range(n // 4):
        t = list(texts[int(rng.integers(0, n))])
        t[int(rng.integers(0, len(t)))] = "changed"
        texts.append(t)
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[i])) for i in order]


def test_against_all_pairs(spark):
    rows = make(150, 60)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(md, "BLOCK", 8)
    rows = make(30, 150, seed=4)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert found(docs) == want
    kept = md.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if w[2])


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, None), (4, "  \n"), (5, "one two"), (6, "One\ttwo"), (7, "a b c d e f"), (7, "q w e r t y"), (None, "a b c d e f"), (8, long), (9, long + " tail"), (10, "a b c d e f")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, ta int, grp int")
    got = found(df)
    want = sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (None, 7, False), (8, 8, True), (9, 8, False), (10, 7, False)], key=str)
    assert got == want
    assert md.near_duplicates(df.limit(0)).count() == 0 and md.keep_one(df.limit(0)).count() == 0
    assert sorted((r["doc_id"] for r in md.keep_one(df).collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, 7, 8], key=str)


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_registers_agree_with_the_probability_jaccard(share):
    rng = np.random.default_rng(2)
    agree = want = 0.0
    for _ in range(60):
        e = rng.integers(1, 2**63, 100, dtype=np.uint64)
        w = 1 + rng.exponential(1, 100)
        cut = int(100 * share)
        v = w.copy()
        v[:10] *= 2
        other = np.concatenate([e[:cut], rng.integers(1, 2**63, 100 - cut, dtype=np.uint64)])
        s = md.signatures(np.concatenate([e, other]), np.concatenate([w, v]), np.array([100, 100]))
        agree += (s[0] == s[1]).mean() / 60
        x, y = dict(zip(e.tolist(), w)), dict(zip(other.tolist(), v))
        want += sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys()) / 60
    assert abs(agree - want) < 0.02


def test_a_much_repeated_passage_hides_no_near_copy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(30):
        words = [f"w{i}" for i in rng.integers(0, 100_000, 200)]
        once = list(words)
        for at in (60, 110, 160):
            once[at] = "edited"
        rows += [(2 * k, " ".join(words[:40] * 20 + words[40:])), (2 * k + 1, " ".join(once))]
    want = brute(rows)
    assert sum(not kept for _, _, kept in want) == 30
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_hashing_holds_little_memory():
    """A worker's arrays are bounded by a piece of text, whatever the batch; the pieces change no bucket and no set."""
    import random
    import tracemalloc

    import pyarrow as pa

    draw = random.Random(3)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta", "a", "of", "longer-word"], k=draw.randint(0, 700))) for _ in range(1500)] + [None, ""]
    assert sum(len(t or "") for t in texts) > 2_500_000
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), ids, ids], ["id", "text", "ta", "tb"])
    md.shingle_sets(texts[:1])
    tracemalloc.start()
    sets = md.shingle_sets(texts)
    most = tracemalloc.get_traced_memory()[1]
    assert most < 45e6
    tracemalloc.reset_peak()
    buckets = [k for out in md._hashed(iter([batch])) for k in out.column(3).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70e6
    for i in (0, 1, 700, 1499, 1500, 1501):
        assert buckets[i] == md.band_keys([texts[i]])[0].tolist() and (sets[i] == md.shingle_sets([texts[i]])[0]).all()


def test_a_chain_is_contracted_once(spark, monkeypatch):
    """The first pass's groups go into the second search for components, not its chains of links."""
    from quillmill.llm import components as cc

    rounds, write, search = [], cc.materialize, md.components

    def written(df, name):
        rounds[-1] += name == "representatives"
        return write(df, name)

    monkeypatch.setattr(cc, "materialize", written)
    monkeypatch.setattr(md, "components", lambda edges: (rounds.append(0), search(edges))[1])
    words = [f"w{i}" for i in range(250)]
    docs = [(i, " ".join(words[i : i + 100])) for i in range(150)]
    out = md.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {0} and len(out) == 150
    assert len(rounds) == 2 and rounds[0] > 1 and rounds[1] == 1, rounds
