"""WARC archives: a round trip against plain rules, archives written by hand, and broken ones."""

import hashlib
import random

import duckdb
import pytest
import zstandard

from quillmill.llm import warc
from quillmill.llm.queries import op11_warc

DIR = "/root/testdata/sf0.001"


def plain(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, p in data:
        if len(p) >= 1000:
            top[p] = max([x for x in (top.get(p), i) if x is not None], default=None)
    out = []
    for i, p in data:
        first = top.get(p)
        again = first is not None and i != first
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x", "é" * 600), (2, "http://a/y", "é" * 600), (9, None, "é" * 600), (3, "http://b/ \r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", "é" * 600), (None, "n", None), (9, "again", "é" * 600), (7, "long", "<p>x</p>\n" * 300_000), (8, "lines", "a\r\n\r\nWARC/1.1\r\nP*M\x18\x00\x00\x00\x00" + "b" * 999)]
COLUMNS = "page_id long, url string, html string"


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    assert sorted(map(tuple, op11_warc(spark, DIR).collect()), key=str) == sorted(con.execute(warc.SQL).fetchall(), key=str)


@pytest.mark.parametrize("sent", [warc.SENT, 0])
def test_round_trip(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    df = spark.createDataFrame(ROWS, COLUMNS).selectExpr("*", "page_id AS id", "url AS digest", "1 AS first")
    warc.write_archives(df, str(tmp_path / "w"))
    assert sorted(map(tuple, warc.pages_read(spark, str(tmp_path / "w")).collect()), key=str) == plain(ROWS)
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    by = {(r["record_id"], r["record_type"], r["target_uri"]): r for r in found}
    assert by["<urn:x-page:8>", "response", "lines"]["payload"].decode() == ROWS[11][2]
    assert by["<urn:x-page:3>", "response", "http://b/%20%0D%0AX:%20y"]["payload"] == b"short"
    assert by["<urn:x-page:1>", "revisit", "http://a/x"]["payload"] == b"" and by["<urn:x-page:1>", "revisit", "http://a/x"]["refers_to"] == "<urn:x-page:9>"


def test_many_archives_with_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(warc, "BLOCKS", 2)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(400)]
    rows = [(i, f"http://h/{i}", "<html><body>" + " ".join(rnd.choice(words) for _ in range(200)) + "</body></html>") for i in range(300)]
    rows += [(1000 + i, "again", rows[0][2]) for i in range(100)]
    warc.write_archives(spark.createDataFrame(rows, COLUMNS).repartition(3), str(tmp_path / "w"))
    parts = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert len(parts) > 6 and all(p[:4] == warc.DICTIONARY for p in parts)
    assert sorted(map(tuple, warc.pages_read(spark, str(tmp_path / "w")).collect()), key=str) == plain(rows)


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], COLUMNS), str(tmp_path / "w"))
    assert warc.pages_read(spark, str(tmp_path / "w")).collect() == []


def block(payload, **more):
    fields = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:a>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Type": "text/plain", "Content-Length": str(len(payload))} | more
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + payload + b"\r\n\r\n"


def read(spark, folder, data, strict=False):
    folder.mkdir()
    (folder / "x.warc.zst").write_bytes(data)
    return warc.read_archives(spark, str(folder), strict=strict).orderBy("offset").collect()


def test_archives_of_others(spark, tmp_path):
    """A raw dictionary, frames of several blocks, without checksum or length, skippable frames between, folded fields."""
    samples = [b"some text that comes again %d and again" % (i % 7) * 3 for i in range(500)]
    held = zstandard.train_dictionary(2048, samples)
    packer = zstandard.ZstdCompressor(dict_data=held, write_content_size=False)
    big = bytes(random.Random(2).randbytes(700_000))
    data = warc.DICTIONARY + len(held.as_bytes()).to_bytes(4, "little") + held.as_bytes() + packer.compress(block(b"one")) + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + packer.compress(block(big, **{"WARC-Target-URI": "http://a\r\n b"}))
    got = read(spark, tmp_path / "a", data, strict=True)
    assert [bytes(r["payload"]) for r in got] == [b"one", big] and got[1]["target_uri"] == "http://a b"
    sha = {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"two").hexdigest()}
    assert read(spark, tmp_path / "b", zstandard.compress(block(b"two", **sha)), strict=True)[0]["payload_digest"] == hashlib.sha1(b"two").hexdigest()


def test_broken_records(spark, tmp_path):
    ok = zstandard.compress(block(b"fine"))
    cases = {
        "Content-Length is 9": block(b"abc", **{"Content-Length": "9"}),
        "Content-Length is 2": block(b"abc", **{"Content-Length": "2"}),
        "Content-Length is no number": block(b"abc", **{"Content-Length": "3x"}),
        "no warc-date": block(b"abc", **{"WARC-Date": None}),
        "no version line": b"HTTP/1.1 200 OK\r\n\r\n",
        "the header does not end": b"WARC/1.0\r\nWARC-Type: x\r\n",
        "digest": block(b"abc", **{"WARC-Payload-Digest": "sha1:" + "0" * 40}),
        "block has": block(b"a") + block(b"b"),
        "no HTTP head": block(b"abc", **{"Content-Type": "application/http"}),
    }
    data = ok + b"".join(zstandard.compress(c) for c in cases.values()) + ok
    got = read(spark, tmp_path / "a", data)
    assert [r["error"] for r in (got[0], got[-1])] == [None, None] and len(got) == len(cases) + 2
    for row, said in zip(got[1:-1], cases):
        assert said in row["error"]
    cut = read(spark, tmp_path / "b", ok + ok[:-3])
    assert cut[0]["error"] is None and "cut off" in cut[1]["error"]
    assert "cannot be read" in read(spark, tmp_path / "c", b"plain text, no frame at all")[0]["error"]
    with pytest.raises(Exception, match="Content-Length is 9"):
        read(spark, tmp_path / "d", zstandard.compress(cases["Content-Length is 9"]), strict=True)
