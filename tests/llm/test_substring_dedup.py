"""Substring dedup against a plain version, and its answer to shifts."""

import numpy as np
import pytest

from quillmill.llm import substring_dedup as sd

DIR = "/root/testdata/sf0.001"


def plain_ends(data):
    """The gear hash byte by byte."""
    ends, h = [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(sd._GEAR[b])) & 0xFFFF
        if h >> (16 - sd.BITS) == 0:
            j = i + 1
            while j < len(data) and data[j] & 0xC0 == 0x80:
                j += 1
            ends.append(j)
    ends = sorted({*ends, len(data)}) if data else []
    out, start = [], 0
    for e in ends:
        while e - start > sd.LONGEST:
            j = start + sd.LONGEST
            while data[j] & 0xC0 == 0x80:
                j -= 1
            out.append(j)
            start = j
        out.append(e)
        start = e
    return out


@pytest.mark.parametrize("text", ["", "a", "plain words " * 40, "é" * 500, "日本語テキスト" * 60, "aaaa" * 300, "mixed é words ñ with 語 " * 30])
def test_chunk_ends(text):
    data = text.encode()
    assert sd.chunk_ends(data).tolist() == plain_ends(data)
    start, length, _ = sd.chunks(text)
    assert int(length.sum()) == len(text) and "".join(text[a : a + n] for a, n in zip(start, length)) == text


def plain(rows, least=sd.LEAST):
    seen, later = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t}):
        for a, n, d in zip(*map(np.ndarray.tolist, sd.chunks(t))):
            if d in seen:
                runs = later.setdefault((i, t), [])
                if not runs or runs[-1][-1][1] != a:
                    runs.append([])
                runs[-1].append((a, a + n, seen[d]))
            else:
                seen[d] = i
    out = {}
    for (i, t), runs in later.items():
        runs = [[c for c in r if c[1] - c[0] >= sd.SHORT] for r in runs]
        runs = [r for r in runs if r and r[-1][1] - r[0][0] >= least]
        if runs:
            out[i, t] = (sd._cut(t, [(r[0][0], r[-1][1]) for r in runs]), sorted({c[2] for r in runs for c in r}))
    return out


def test_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(rows)
    assert len(want) > 5
    got = {r["doc_id"]: (r["text"], r["first_ids"]) for r in sd.without_repeats(docs, only_changed=True).collect()}
    assert got == {i: v for (i, _), v in want.items()}
    whole = {r["doc_id"]: r["text"] for r in sd.without_repeats(docs).collect()}
    assert whole == {i: got[i][0] if i in got else t for i, t in rows}


def test_passages_are_found_wherever_they_stand(spark):
    rng = np.random.default_rng(3)
    word = lambda k: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(k))
    rows, passage = [], {}
    for k in range(100):
        p = word(60)
        passage[k] = p
        rows += [(10 * k, word(80) + " " + p + " " + word(50)), (10 * k + 1, word(int(rng.integers(1, 90))) + " " + p + word(30)), (10 * k + 2, word(150))]
    got = {r["doc_id"]: r for r in sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), only_changed=True).collect()}
    assert set(got) <= {10 * k + 1 for k in range(100)} and len(got) >= 95
    for i, r in got.items():
        assert passage[i // 10] not in r["text"] and r["first_ids"] == [i - 1]


def test_odd_rows(spark):
    p = "a passage of some length that stands in several of these documents, word for word, and is long enough to be found in all. " * 2
    rows = [(1, p), (1, p), (2, None), (3, ""), (None, "x " + p), (4, "short"), (5, "short"), (1, "other " + p), (9, "w " * 100_000)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, place string, id int")
    out = sd.without_repeats(df)
    assert out.columns == [*df.columns, "repeat_spans", "first_ids"]
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(rows)
    by = lambda i: sorted((t for d, t in got if d == i), key=str)
    assert by(2) == [None] and by(3) == [""] and by(4) == by(5) == ["short"]
    texts = sorted(len(t) for d, t in got if d in (1, None))
    assert len(texts) == 4 and texts[0] < 100
    assert sd.without_repeats(df.limit(0)).count() == 0


def test_rows_of_equal_id_and_names_that_clash(spark):
    p = "a passage of some length that stands in two rows of one id, word for word, and is long enough to be found by its chunks, all of them. "
    df = spark.createDataFrame([(1, "first " + p * 2, "u", "v"), (1, "second " + p * 2, "u", "v")], "doc_id long, text string, repeat_spans string, first_ids string")
    out = sd.without_repeats(df)
    assert out.columns == [*df.columns, "repeat_spans_", "first_ids_"]
    got = [r for r in out.collect() if r["repeat_spans_"]]
    assert got and all(r["first_ids_"] == [1] for r in got) and min(len(r["text"]) for r in got) < 120


def test_many_rows_of_one_id(spark):
    """Told apart by their texts, however many there are; a null text among them has no repeats."""
    p = "a passage that stands in some of these rows, word for word, long enough to be found by its chunks wherever it may stand in them. " * 2
    rows = [(1, None), (1, None)] + [(1, f"row {k} " + "".join(f"{k * 7919 % 100_003} {j} " for j in range(12)) + (p if k % 4 == 0 else "")) for k in range(1500)]
    got = sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    kept = sorted((r["text"] for r in got if r["text"]), key=lambda t: int(t.split()[1]))
    assert sum(r["text"] is None and r["repeat_spans"] is None for r in got) == 2
    assert all(a.startswith(b[: b.index(" ", 4)]) for a, b in zip(kept, (t for _, t in rows[2:])))
    assert sum(p in t for t in kept) == 1 and all(t == b for t, (_, b) in zip(kept, rows[2:]) if p not in b)


def test_a_common_chunk_does_not_change_the_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = sorted(map(tuple, sd.repeats(docs).collect()))
    monkeypatch.setattr(sd, "HOT", 1_000_000)  # every repeated chunk is sent
    assert sorted(map(tuple, sd.repeats(docs).collect())) == want
    monkeypatch.setattr(sd, "HOT", 1)  # none is
    assert sorted(map(tuple, sd.repeats(docs).collect())) == want
