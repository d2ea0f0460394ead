"""Duplicates among results, query history and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HISTORY_KEPT, HISTORY_SHOWN = 50, 20
# The words of the query syntax that completions offer.
SYNTAX = ("AND", "OR", "NOT", "name:", "path:", "ext:")
SUGGESTIONS = 5


def dedup_by_hash(results: DataFrame) -> DataFrame:
    """One result of each hash (or path, without a hash) and query: the latest; it takes the best rank of its group."""
    key = F.coalesce(F.nullif("hash", F.lit("")), F.col("path"))
    group = W.partitionBy("query_id", "__key")
    latest = group.orderBy(F.coalesce(F.col("updated_at"), F.timestamp_seconds(F.lit(0))).desc(), "rank", "id")
    out = results.withColumn("__key", key).withColumns({"__nr": F.row_number().over(latest), "__best": F.min("rank").over(group)})
    return out.where("__nr = 1").withColumn("rank", F.col("__best")).drop("__key", "__nr", "__best")


def recent_searches(log: DataFrame, limit: int = HISTORY_SHOWN, query_col: str = "query", ts_col: str = "ts") -> DataFrame:
    """(query, ts): the newest different queries."""
    newest = log.where(F.trim(query_col) != "").groupBy(F.trim(query_col).alias("query")).agg(F.max(ts_col).alias("ts"))
    return newest.orderBy(F.col("ts").desc(), "query").limit(min(limit, HISTORY_KEPT))


def suggest(prefixes: DataFrame, history: DataFrame, saved: DataFrame) -> DataFrame:
    """(prefix, nr, kind, text): completions of each typed prefix: syntax words, then history, then saved queries.

    Syntax words are all shown; queries fill up to five, each text once. history: (query, ts); saved: (query, name).
    A query can complete a prefix only if both begin with the same character, on which they are joined.
    """
    p = prefixes.select("prefix").distinct().withColumn("low", F.lower("prefix"))
    words = p.select("prefix", "low", F.posexplode(F.array(*[F.lit(s) for s in SYNTAX])).alias("nr", "text"))
    words = words.where(F.startswith(F.lower("text"), F.col("low")) | ((F.length("low") >= 2) & F.contains(F.lower("text"), F.col("low"))))
    syntax = words.select("prefix", F.lit(0).alias("rank"), F.col("nr").cast("long").alias("key"), F.lit("syntax").alias("kind"), "text")
    ordered = history.select(F.lit(1).alias("rank"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("key"), F.lit("history").alias("kind"), F.col("query").alias("text"))
    kept = saved.select(F.lit(2).alias("rank"), F.lit(0).cast("long").alias("key"), F.lit("saved").alias("kind"), F.col("query").alias("text")).distinct()
    first = lambda c: F.substring(F.lower(c), 1, 1)
    found = p.join(ordered.unionByName(kept), first("prefix") == first("text")).where(F.startswith(F.lower("text"), F.col("low")))
    whole = syntax.unionByName(found.select("prefix", "rank", "key", "kind", "text"))
    once = whole.groupBy("prefix", "text").agg(F.min(F.struct("rank", "key", "kind")).alias("s"))
    numbered = once.withColumn("nr", F.row_number().over(W.partitionBy("prefix").orderBy("s.rank", "s.key", "text")))
    return numbered.where((F.col("nr") <= SUGGESTIONS) | (F.col("s.rank") == 0)).select("prefix", "nr", F.col("s.kind").alias("kind"), "text")
