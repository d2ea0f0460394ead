"""The pipeline, stage by stage, against plain versions on a small table."""

from collections import Counter

import corpus_pipeline as cp
from quillmill.llm import common, toxicity
from test_minhash_dedup import brute as groups
from test_bpe import REAL

DIR = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def without_lines(docs):
    """docs: {id: text} -> texts without later occurrences of three-line windows."""
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        solid = [(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b, c in zip(solid, solid[1:], solid[2:]):
            window = (a[1], b[1], c[1])
            if window in seen:
                gone |= set(range(a[0], c[0] + 1))
            seen.add(window)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "bpe"]
    stage = dict(cp.STAGES)

    kept = stage["toxicity"](spark, docs, DIR)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    before, first = rows(docs), rows(kept)
    assert set(first) == {i for i, p in scores.items() if not p} and all(first[i] == before[i] for i in first)

    cleaned = stage["line_dedup"](spark, kept, DIR)
    assert cleaned.columns == docs.columns
    second = rows(cleaned)
    want = without_lines({i: r["text"] for i, r in first.items()})
    assert {i: r["text"] for i, r in second.items()} == {i: t for i, (t, n) in want.items() if not n or t.strip(" ")}
    assert all(r["n_chars"] == len(r["text"]) for r in second.values())

    single = stage["minhash_near_dedup"](spark, cleaned, DIR)
    assert single.columns == docs.columns
    third = rows(single)
    assert sorted(third) == sorted(i for i, _, k in groups([(i, r["text"]) for i, r in second.items()]) if k)
    assert all(third[i] == second[i] for i in third)

    mixed = stage["mixing"](spark, single, DIR)
    assert mixed.columns == docs.columns
    fourth = mixed.collect()
    times = Counter(r["doc_id"] for r in fourth)
    assert max(times.values()) <= 3 and all(r == third[r["doc_id"]] for r in fourth)
    size, taken = Counter(), Counter()
    for r in third.values():
        size[r["source"]] += len(r["text"].split())
    for r in fourth:
        taken[r["source"]] += len(r["text"].split())
    total, left, target = sum(size.values()), set(size), {}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 3 * size[s]}
        for s in full or left:
            target[s] = 3 * size[s] if full else level * weight[s]
        left -= full or left
    longest = max(len(r["text"].split()) for r in third.values())
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in size)

    last = stage["bpe"](spark, mixed, DIR).collect()
    assert Counter(r["doc_id"] for r in last) == times
    assert all(r["n_tokens"] == len(REAL.encode(third[r["doc_id"]]["text"], add_special_tokens=False).ids) for r in last)


def test_run(spark):
    out = cp.run(spark, DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def odd(spark):
    lines = "one line\nanother line\na third line\n"
    rows = [
        (1, None, "src"), (2, "", "src"), (3, "   ", None), (4, lines + "tail of four", "src"), (5, lines, "b"), (5, lines, "b"),
        (None, "a row without an id stays too", "b"), (6, "word " * 60_000, "c"), (7, "é 日本 \n\n\n x", None), (8, lines + "tail of four", "c"),
    ]
    schema = "doc_id long, text string, source string, n_lines_removed int, id string, score double, size string, n_chars long, `__nd_ta` int, component_id string"
    return spark.createDataFrame([(i, t, s, 1, "x", 0.5, "y", 3, 4, "z") for i, t, s in rows], schema)


def test_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{DIR}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    docs, stage = odd(spark), dict(cp.STAGES)
    by_id = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    first = stage["toxicity"](spark, docs, f"{tmp_path}/none")
    assert first.columns == docs.columns and by_id(first) == by_id(docs)  # no label: nothing is rejected
    second = stage["line_dedup"](spark, docs, DIR)
    got = by_id(second)
    assert second.columns == docs.columns
    # 5's lines all stand in 4 before, and so do 8's but for the last one.
    assert not any(i == 5 for i, _ in got) and got[8, "tail of four"] == 0 and got[1, None] == got[2, ""] == got[3, "   "] == 1
    third = stage["minhash_near_dedup"](spark, docs, DIR)
    got = by_id(third)
    assert third.columns == docs.columns
    assert got[4, docs.where("doc_id = 4").first()["text"]] == 1 and not any(i == 8 for i, _ in got) and got[5, "one line\nanother line\na third line\n"] == 2
    assert got[1, None] == got[2, ""] == got[3, "   "] == 1 and sum(i is None for i, _ in got.elements()) == 1
    fourth = stage["mixing"](spark, docs, DIR)
    assert fourth.columns == docs.columns and set(by_id(fourth)) <= set(by_id(docs)) and max(by_id(fourth).values()) <= 6
    last = stage["bpe"](spark, docs, DIR).collect()
    assert len(last) == 10 and all(r["n_tokens"] == 0 for r in last if r["doc_id"] in (1, 2, 3))
    for name, f in cp.STAGES:
        assert f(spark, docs.limit(0), DIR).count() == 0, name


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    cp.run(spark, DIR).collect()
    assert [p.name.split("-")[1:3] for p in tmp_path.iterdir()] == [["stage", "bpe"]]
