"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and each word's more frequent form.

Words are runs of the letters A to Z, a to z and U+00C0 to U+00FF, of which A to Z are lower-cased. Where 31 divides the unsigned crc32 of
``<doc_id>:<run>``, the run loses its code point at crc32 modulo its length. Distinct words of ``LEAST`` code points and
more that occur ``OFTEN`` times and more are the vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Of two such words the shorter one (either, of equal lengths)
gives two disjoint chunks, its halves; the other gives the grams of those lengths. One edit leaves one chunk whole, and it stands in the other word
where it stood, or one place on: the chunk before the edit at the same place, the one behind it moved by the difference of the lengths. So a chunk is joined with
the grams at these two places only. What lies beside the chunk holds the edit, so that one of its own two halves is whole too; a key is a chunk with one of those halves,
three quarters of a word, so that the words that share a common chunk are not compared pair by pair. Pairs that meet are verified by their edit distance;
a pair that several keys find counts at the first of them.

A word's form is its near word that occurs most often (ties: the least in code-point order), if that one occurs at least ``RATIO`` times as
often; its root is where the forms end. Forms grow by ``RATIO`` from one to the next, so a chain of them is short.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in ``<doc_id>:<run>``; rows repeated as a whole count again; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import drop, materialize, scratch

LEAST = 7
OFTEN = 2
RATIO = 10
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every word of every text as it counts, too short ones left out."""
    runs = F.filter(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0)), lambda w: F.length(w) >= LEAST)
    # One row for a run; explode_outer of nothing gives none, so null texts go here.
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = rows.select("run", h.alias("h")).select(F.when(F.col("h") % 31 == 0, without).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that occur often enough."""
    return occurrences(docs, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)


def _places(length: Column) -> tuple[Column, Column, Column]:
    """Of a word that gives chunks: where its second chunk begins, where that one's second half does, and the first one's."""
    a = F.floor(length / 2).cast("int")
    return a, a + F.floor((length - a) / 2).cast("int"), F.floor(a / 2).cast("int")


def _keys(word: Column, length: Column, shift: int) -> list[Column]:
    """A word's four keys against chunk words of ``length``, ``shift`` code points shorter than itself (0: its own chunks, too)."""
    a, ab, a2 = _places(length)
    head = lambda n: F.substring(word, F.lit(1), n)
    tail = lambda n: F.substring(word, n + 1 + shift, F.length(word))
    return [head(ab), F.concat(head(a), F.lit(" "), tail(ab)), F.concat(head(a2), F.lit(" "), tail(a)), tail(a2)]


def _key_rows(words: DataFrame, shifts: list[int]) -> DataFrame:
    """(key, kind, shift, word, n): the keys as hashes; the words of a key are compared, so a collision costs time only."""
    length = F.length("word")
    made = [F.struct(F.xxhash64(length - s, F.lit(kind), key).alias("key"), F.lit(kind).alias("kind"), F.lit(s).alias("shift")) for s in shifts for kind, key in enumerate(_keys(F.col("word"), length - s, s))]
    return words.select("word", "n", F.explode(F.array(*made)).alias("k")).select("k.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of (word, n) once, the shorter one first (of equal lengths the lesser)."""
    chunks = _key_rows(words, [0]).drop("shift")
    grams = _key_rows(words, [0, 1]).select("key", F.col("kind").alias("gram_kind"), "shift", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = chunks.join(grams, "key").where((F.col("kind") == F.col("gram_kind")) & ((F.col("shift") == 1) | (F.col("word") < F.col("near"))) & (F.length("near") == F.length("word") + F.col("shift")))
    length = F.length("word")
    own, other = _keys(F.col("word"), length, 0), [F.when(F.col("shift") == 1, x).otherwise(y) for x, y in zip(_keys(F.col("near"), length, 1), _keys(F.col("near"), length, 0))]
    first = F.when(own[0] == other[0], 0).when(own[1] == other[1], 1).when(own[2] == other[2], 2).otherwise(3)
    return met.where((F.levenshtein("word", "near", 1) == 1) & (first == F.col("kind"))).select("word", "n", "near", "near_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles how far the forms have been followed."""
    now = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = moved
        if moved.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the vocabulary."""
    with scratch() as kept:
        words = materialize(vocabulary(docs, id_col, text_col), "words")
        pairs = near_pairs(words)
        both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
        met = pairs.select(both.alias("p")).select("p.word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("p.near_n")).alias("less"), F.col("p.near").alias("near")).alias("near"))
        all_ = words.select("word", "n", F.lit(None).cast(met.schema["near"].dataType).alias("near")).unionByName(met)
        found = all_.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("best"))
        form = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best.near"))
        table = kept.keep(materialize(found.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms"))
        roots = kept.keep(materialize(_roots(table.where("form IS NOT NULL").select("word", "form")), "word-roots"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB: crc32 by its table of 256 values, near words by what is left when one code point goes.
SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT run, string_split(id || ':' || run, '') AS cs, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7) GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(cs, lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END)) AS bs FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM less b JOIN words a ON b.rest = a.word
  UNION SELECT b.word, a.word, a.n FROM less b JOIN words a ON b.rest = a.word),
found AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN found f ON w.word = f.word),
steps AS (
  WITH RECURSIVE r AS (SELECT word, word AS last, 0 AS k FROM forms UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN forms f ON f.word = r.last WHERE f.form IS NOT NULL)
  SELECT word, arg_max(last, k) AS root FROM r GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN steps s ON f.word = s.word
"""
