"""Line dedup: windows of three lines that occur before are removed. DataFrame functions only.

Every document is cut into lines at ``\\n``; lines that are blank after trimming spaces do not count as lines.
Each run of three such lines is one window, told by two 64-bit hashes of the trimmed lines. Windows are counted
over the whole corpus; the first occurrence (least doc_id, nulls last, then text hash, then line) stays, and the
spans of lines of all later occurrences are merged and taken out, blank lines inside a span with them.

Defined cases: a null text stays null; an empty text or one of fewer than three lines stays as it is; rows that
repeat a (doc_id, text) are the same occurrence and are treated alike; an empty table gives an empty table;
other columns pass through untouched, and where one is named as one that the result adds, the added one has an
underscore behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import free_name, private_prefix

WINDOW = 3


def _lines(text):
    return F.split(text, "\n", -1)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans): for each document with later occurrences, the line spans (first, last) to take out."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), _lines(F.col(text_col)).alias("lines")).where(F.col("lines").isNotNull())
    solid = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t"))), lambda s: s["t"] != "")
    hashed = F.transform(solid, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["t"]).alias("a"), F.xxhash64(F.lit("second"), s["t"]).alias("b")))
    slim = slim.select("id", "th", hashed.alias("ls")).where(F.size("ls") >= WINDOW)
    shifted = [F.slice("ls", F.lit(1 + k), F.size("ls") - (WINDOW - 1)) for k in range(WINDOW)]
    zipped = F.arrays_zip(*[s.alias(f"l{k}") for k, s in enumerate(shifted)])
    windows = slim.select("id", "th", F.explode(zipped).alias("w")).select(
        "id",
        "th",
        F.col("w.l0.i").alias("first"),
        F.col(f"w.l{WINDOW - 1}.i").alias("last"),
        F.xxhash64(*[F.col(f"w.l{k}.a") for k in range(WINDOW)]).alias("wa"),
        F.xxhash64(*[F.col(f"w.l{k}.b") for k in range(WINDOW)]).alias("wb"),
    )
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("first").alias("first"))
    repeated = windows.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1").select("wa", "wb", "kept")
    later = windows.join(repeated, ["wa", "wb"]).where(place != F.col("kept"))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` cleaned and two more columns, n_lines_seen and n_lines_removed (all lines, blank ones too)."""
    names = docs.columns
    own = private_prefix(names, "__ld_")
    spans = repeated_spans(docs, id_col, text_col).select(F.col("id").alias(f"{own}id"), F.col("th").alias(f"{own}th"), F.col("spans").alias(f"{own}spans"))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{own}th")), "left").drop(f"{own}id", f"{own}th")
    joined = joined.withColumn(f"{own}lines", _lines(F.col(text_col)))
    covered = F.flatten(F.transform(f"{own}spans", lambda s: F.sequence(s["first"], s["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{own}lines") - 1), covered)
    joined = joined.withColumn(f"{own}left", F.when(F.col(f"{own}spans").isNotNull(), left))
    text = F.when(F.col(f"{own}left").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(f"{own}left", lambda i: F.get(f"{own}lines", i)), "\n"))
    seen = F.coalesce(F.size(f"{own}lines"), F.lit(0))
    seen = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(seen)
    keep = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in names]
    removed = F.when(F.col(f"{own}left").isNull(), F.lit(0)).otherwise(seen - F.size(f"{own}left"))
    return joined.select(*keep, seen.alias(free_name(names, "n_lines_seen")), removed.alias(free_name(names, "n_lines_removed")))


SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), line AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM cut
), solid AS (
  SELECT doc_id, i, trim(raw, ' ') AS t FROM line WHERE trim(raw, ' ') <> ''
), win AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER o AS z,
         t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS w
  FROM solid WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, a, z FROM (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) AS n FROM win WHERE w IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) AS text, count(*) AS n_left
  FROM line l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines_seen,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n_left, 0) END AS INTEGER) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
