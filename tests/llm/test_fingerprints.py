"""Fingerprints against a plain version over all documents in order."""

import hashlib

import numpy as np
import pytest

from quillmill.llm import fingerprints as fp

DIR = "/root/testdata/sf0.001"


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = fp.sketch(t), fp.sketch(edited), fp.sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_string(a), fp.to_string(b), like(t, edited), like(t, after)))
    return out


def like(a, b):
    """Containment of the kept hashes, or of all shingles where a text keeps none; texts without words are like each other only."""
    sets = [{*fp.sketch(t).tolist()} for t in (a, b)]
    if not all(sets):
        sets = [{*fp.all_hashes(t).tolist()} for t in (a, b)]
    least = min(map(len, sets))
    return len(sets[0] & sets[1]) / least if least else float(sets[0] == sets[1])


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    same(fp.compare_with_next(docs).collect(), plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "b"), (None, "n u l l"), (-3, None), (7, ""), (10**15, "é" * 9 + " x"), (8, "one two three four five six seven " * 300)]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, range string, head boolean")
    same(fp.compare_with_next(docs).collect(), plain(rows))
    assert fp.compare_with_next(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "only one document here today")], "doc_id long, text string")
    same(fp.compare_with_next(one).collect(), plain([(1, "only one document here today")]))


def test_containment_of_unequal_documents():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 20_000)]
    whole, part = " ".join(words), " ".join(words[3000:4500])
    assert fp.containment(fp.sketch(whole), fp.sketch(part)) > 0.98
    other = " ".join(f"v{i}" for i in rng.integers(0, 10**6, 1500))
    assert fp.containment(fp.sketch(whole), fp.sketch(other)) < 0.02
    both = fp.merged(fp.sketch(whole), fp.sketch(other))
    assert fp.containment(both, fp.sketch(other)) == 1.0
    assert (fp.from_string(fp.to_string(both)) == both).all()


def test_plain_fingerprint(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b c d e f")], "doc_id long, text string")
    got = dict(map(tuple, fp.fingerprint(docs).collect()))
    assert got[1] == got[3] == fp.to_string(fp.sketch("a b c d e f")) and got[2] == ""


def plain_sketch(text, fraction):
    """The least hash of every shingle in order, from single words' hashes."""
    words = text.split()
    all_ = {int(fp.shingles(fp.word_hashes(" ".join(words[k : k + 5]).encode())[2], 5)[0]) for k in range(max(1, len(words) - 4))} if words else set()
    return sorted(h for h in all_ if h < fraction * 2**64)


@pytest.mark.parametrize("text", ["", "one", "one two", "a b c d e", "a b c d e f g h i j k l m n", "x " * 50])
def test_sketch_of_single_shingles(text):
    assert fp.sketch(text).tolist() == plain_sketch(text, fp.FRACTION)


def test_a_short_text_inside_a_long_one(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    shorts = [" ".join(f"w{i}" for i in range(k, k + 5)) for k in range(100, 140)]
    assert any(not len(fp.sketch(s)) for s in shorts)
    rows = [x for k, s in enumerate(shorts) for x in ((2 * k, s), (2 * k + 1, long))]
    got = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 0").collect()
    assert len(got) == len(shorts) and all(r["near_next"] == 1.0 for r in got)


def test_merging_is_the_sketch_of_both():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, n)) for n in (1, 2, 3, 5, 6, 7, 9, 12, 200)]
    for a in texts:
        for b in texts:
            whole = np.unique(np.concatenate([fp.shingles(fp.word_hashes(t.encode())[2], 5) for t in (a, b)]))
            assert fp.merged(fp.sketch(a), fp.sketch(b)).tolist() == fp._kept(whole, fp.FRACTION).tolist()
