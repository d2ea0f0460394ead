"""Connected components of a large graph of links, by contraction.

In each round every vertex takes the least of itself and its neighbours as its representative, edges are
rewritten to representatives, and loops and repeats are dropped, so that the graph shrinks; the maps of all rounds
are then composed. Rounds take turns in what "least" means: by id, which ends star-shaped graphs at once, and by
a hash of the id, which shrinks chains by a constant share. All steps are joins and aggregations with
partial sums; no group of neighbours is ever gathered, and each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import drop, materialize, scratch

MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long) -> (id, component), a written table: each id of an edge between two ids, with the least id it is connected to."""
    with scratch() as kept:
        return kept.keep(materialize(_components(edges), "components"))


def _components(edges: DataFrame) -> DataFrame:
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for turn in range(MOST_ROUNDS):
        if links.isEmpty():
            break
        rank = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c)))
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        if turn % 2 == 0:
            rep = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("rep"))
        else:
            near = both.select("a", F.struct(rank("b").alias("h"), F.col("b").alias("v")).alias("s")).groupBy("a").agg(F.min("s").alias("s"))
            rep = near.select("a", F.least(F.col("s"), F.struct(rank("a").alias("h"), F.col("a").alias("v")))["v"].alias("rep"))
        maps.append(materialize(rep.withColumnRenamed("a", "id"), "representatives"))
        left, right = maps[-1].select(F.col("id").alias("a"), F.col("rep").alias("x")), maps[-1].select(F.col("id").alias("b"), F.col("rep").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, links = links, materialize(moved, "edges")
        drop(old)
    else:
        raise RuntimeError("the components did not converge")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = whole.select(F.col("id").alias("rep"), F.col("rep").alias("next"))
        whole = earlier.join(later, "rep", "left").select("id", F.coalesce("next", "rep").alias("rep"))
    if len(maps) > 1:
        whole = materialize(whole, "composed")
        # A hashed round may have ended a component at another vertex than its least.
        least = whole.groupBy("rep").agg(F.min("id").alias("component"))
        whole = whole.join(least, "rep").select("id", "component")
    else:
        whole = whole.select("id", F.col("rep").alias("component"))
    return whole
