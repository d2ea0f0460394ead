"""Quote cards against a plain loop, and on a long line."""

import random
import re
import time

from quillmill.functions import text
from quillmill.plans.queries import QUERIES

END = "[。！？；\n.?!]"


def plain_cards(line, q):
    low, at, k, out = line.lower(), 0, 0, []
    while (at := low.find(q.lower(), at)) >= 0:
        k, left, right = k + 1, line[:at], line[at + len(q) :]
        ends = [m.end() for m in re.finditer(END, left)]
        one, two = left[ends[-1] :] if ends else left, left[ends[-2] :] if len(ends) > 1 else left
        before = _side(left, one.strip(" "), two.strip(" "))[-200:]
        ends = [m.end() for m in re.finditer(END, right)]
        one, two = right[: ends[0]] if ends else right, right[: ends[1]] if len(ends) > 1 else right
        after = _side(right, one.strip(" "), two.strip(" "))[:200]
        if before or after:
            out.append((k, before, line[at : at + len(q)], after))
        at += len(q)
    return out


def _side(whole, one, two):
    return (one or whole) if len(two) < 100 and len(whole) > len(two) else two


def test_cards_as_by_a_loop(spark):
    rnd = random.Random(4)
    kinds = [["key", " ", "a", "."], ["KEY", " " * 150, "é", "wordy " * 30, "!"], ["kéy", "key", "bcd " * 60, "。", " "], ["Key", " " * 500, "x", "?"], ["key"], ["key", "z" * 390, ".", "\t"]]
    lines = ["".join(rnd.choice(kind) for _ in range(n)) for kind in kinds for n in (1, 2, 5, 30, 300, 900)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, content string")
    got = text.quote_cards(rows, text.F.lit("key")).orderBy("id", "k").collect()
    want = [(nr, *card) for nr, line in enumerate(lines) for card in plain_cards(line, "key")]
    assert [(r["id"], r["k"], r["before"], r["keyword"], r["after"]) for r in got] == want
    assert max(w[1] for w in want) > 2 * text.RUN and len(want) > 1000


def test_a_long_line(spark):
    """One line's occurrences take time by their number, not by its square."""
    cards = lambda n: text.quote_cards(spark.createDataFrame([(1, "a nation of words. " * n)], "id long, content string"), text.F.lit("tion"))
    assert cards(100).count() == 100
    began = time.time()
    assert cards(20_000).selectExpr("sum(length(before) + length(after)) AS s", "count(*) AS n").first()["n"] == 20_000
    assert time.time() - began < 20


def test_export_of_a_long_line(spark, tmp_path):
    spark.createDataFrame([(7, "a nation of words. " * 20_000, "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    values = [r["value"] for r in QUERIES["s10_export_quotes"](spark, str(tmp_path)).collect()]
    assert time.time() - began < 30
    assert len(values) == 20_000 and values[-1].startswith("## Quote 20000\n**Line**: 1\n\n> ") and "**tion**" in values[-1]
