"""Mixing sources to target weights: Efraimidis-Spirakis sampling into word budgets per source.

A document's size is its number of words (runs of anything but ASCII white space; null text: 0). Sources, in
code-point order with null last, weigh 5, 2, 1, repeating, and share the words of the corpus by weight; a target
stops at 3 times its source's size and what is over goes to the others by weight until none is above. A source
first gives as many complete epochs as fit in its target; the rest is drawn without replacement: each document
gets the key -ln(u) / w, with u a uniform number from a digest of doc_id and w a quality weight (a column that the caller
gives, such as a classifier's score, or else one from the symbols in its text, which SQL can check), and documents
are taken by rising key until the prefix sum of their sizes reaches the budget. With ``cut`` the document in
which the budget ends gives only the words that are missing; without, it is taken whole if at least half of
it fits. No global sort is needed: sizes are first summed by key bin, and only the bin in which a source's budget ends
is sorted.

Defined cases: null doc_id counts as the empty string for the digest; rows with equal doc_id in the same source
have equal keys and share what is left in proportion to their size; a source of size 0 takes nothing; an empty
table gives an empty table. The number of sources is taken to be small beside the number of documents: targets
are computed over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.llm.common import materialize, private_prefix, scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[^\p{L}\p{N}\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without symbols, less the more of its characters are neither letter, digit nor white space."""
    chars = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.lit(8.0) * F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("double") / chars)


def sampling_key(id_: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":" + SEED)))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def _weight(text_col: str, weight: Column | None) -> Column:
    """The caller's weight of a document (a quality score, say), at least 1e-6 and that where it is null or NaN; else the one of its text."""
    if weight is None:
        return quality_weight(F.col(text_col))
    weight = weight.cast("double")
    return F.when(weight.isNull() | F.isnan(weight), F.lit(1e-6)).otherwise(F.greatest(weight, F.lit(1e-6)))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(text).alias("size"), sampling_key(F.col(id_col), _weight(text_col, weight)).alias("key"))


def source_plan(slim: DataFrame, cut: bool = True) -> DataFrame:
    """One row per source: src, source_size, target, epochs, and where the fractional epoch ends (cut_key, cut_id, cut_left, cut_size)."""
    slim = slim.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1.0) * BINS).cast("int"))
    bins = materialize(slim.groupBy("src", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    sizes = bins.groupBy("src").agg(F.sum("words").alias("source_size"))
    by_name, everything = W.orderBy(F.col("src").asc_nulls_last()), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), place + 1))
    # Water level: sources in order of cap / weight; the level is set by the first one that stays under its cap.
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    filling = W.orderBy("ratio", F.col("src").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    weighed = weighed.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
            "nth": F.row_number().over(filling),
        }
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    plan = weighed.select("src", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    # The bin in which each budget ends, then the document in it.
    upto = W.partitionBy("src").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    same = F.col("src").eqNullSafe(F.col("psrc"))
    budgets = plan.select(F.col("src").alias("psrc"), "budget")
    ends = bins.withColumn("upto", F.sum("words").over(upto)).join(budgets, same).where((F.col("upto") - F.col("words") < F.col("budget")) & (F.col("upto") >= F.col("budget")))
    ends = ends.select("psrc", F.col("bin").alias("pbin"), (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))
    inside = slim.join(ends, F.col("src").eqNullSafe(F.col("psrc")) & (F.col("bin") == F.col("pbin")))
    inside = inside.groupBy("psrc", "left", "key", "id").agg(F.sum("size").alias("words"))
    run = W.partitionBy("psrc").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    stop = inside.withColumn("upto", F.sum("words").over(run)).where((F.col("upto") - F.col("words") < F.col("left")) & (F.col("upto") >= F.col("left")))
    missing = F.col("left") - F.col("upto") + F.col("words")
    if not cut:
        missing = F.when(missing * 2 >= F.col("words"), F.col("words")).otherwise(F.lit(0))
    stop = stop.select(F.col("psrc"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), missing.cast("long").alias("cut_left"), F.col("words").alias("cut_size"))
    # Written, so that its size is known when it is joined to the documents: one row for each source.
    return materialize(plan.join(stop, same, "left").drop("psrc"), "mix-ends")


def _taken(size: Column, key: Column, id_: Column) -> Column:
    """Words taken of a document, given its source's plan."""
    at = (key == F.col("cut_key")) & id_.eqNullSafe(F.col("cut_id"))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (id_ < F.col("cut_id")))
    part = F.when(at, F.floor(F.col("cut_left") * size / F.greatest(F.col("cut_size"), F.lit(1)))).when(before, size).otherwise(F.lit(0))
    return (F.col("epochs") * size + F.coalesce(part, F.lit(0))).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source), one row for each document."""
    with scratch() as kept:
        slim = kept.keep(materialize(_slim(docs, id_col, text_col, source_col, weight), "mix-docs"))
        plan = kept.keep(source_plan(slim, cut=True)).withColumnRenamed("src", "psrc")
    joined = slim.join(plan, F.col("src").eqNullSafe(F.col("psrc")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(F.col("size"), F.col("key"), F.col("id")).alias("taken"), F.col("src").alias(source_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The mixed corpus: docs' columns, a document as many times as the mix takes it, always whole."""
    names = docs.columns
    own = private_prefix(names, "__mix_")
    size, key = word_count(F.col(text_col)), sampling_key(F.col(id_col), _weight(text_col, weight))
    with scratch() as kept:
        slim = materialize(_slim(docs, id_col, text_col, source_col, weight), "mix-docs")
        plan = kept.keep(source_plan(slim, cut=False))
    plan = plan.select(*[F.col(c).alias(f"{own}{c}") for c in plan.columns])
    joined = docs.withColumns({f"{own}size": size, f"{own}key": key}).join(plan, F.col(source_col).eqNullSafe(F.col(f"{own}src")))
    id_, k = F.col(id_col), F.col(f"{own}key")
    within = (k < F.col(f"{own}cut_key")) | ((k == F.col(f"{own}cut_key")) & (F.coalesce(id_ < F.col(f"{own}cut_id"), F.lit(False)) | (id_.eqNullSafe(F.col(f"{own}cut_id")) & (F.col(f"{own}cut_left") > 0))))
    times = F.col(f"{own}epochs") + F.when(within, F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn(f"{own}times", times.cast("int")).where(F.col(f"{own}times") > 0).withColumn(f"{own}nth", F.explode(F.sequence(F.lit(1), F.col(f"{own}times")))).select(*[F.col(f"`{c}`") for c in names])


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0)
         / (1.0::DOUBLE / (1.0::DOUBLE + 8.0::DOUBLE * coalesce(len(regexp_extract_all(text, '{SYMBOL}')), 0)::DOUBLE / greatest(coalesce(length(text), 0), 1)::DOUBLE)) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER w, 0)::BIGINT)::DOUBLE
            / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT)::DOUBLE AS level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE,
         coalesce((SELECT arg_min(level, nth) FROM l WHERE level <= ratio), 0.0) * weight) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), f AS (
  SELECT d.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM f
"""
