"""Embedding near-dedup: Euclidean p-stable hashing in several tables, then exact cosines in double precision.

Vectors are normalised; a hash is floor((a . x + b) / w) with a Gaussian a and a uniform b, and a table's bucket
is the row of k such hashes. For unit vectors of cosine c the distance is sqrt(2 - 2 c); with w = 2 two vectors at
cosine 0.95 agree in one hash with probability 0.874 and unrelated ones (distance sqrt 2) with 0.486. k grows with the
logarithm of the number of vectors, so that a bucket holds about ``IN_BUCKET`` unrelated ones at any size (8 at
least), and the number of tables is what finds a pair at the threshold with probability ``RECALL``.

Equal vectors are one class from the start, with its number of rows; only classes are hashed. A bucket is cut
into blocks of some hundred vectors (more, by the square root, in very large ones), and every pair of blocks is one
unit of work, so that a hot bucket is spread over many tasks. A unit multiplies its two blocks and gives for each
vector the number of rows it links to and one edge of a spanning forest, never a row for each pair. A pair that
shares buckets of several tables counts in the first one only.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
length do not either. Defined cases: a null id is kept and gets a null component unless it is linked; rows with equal
ids are vectors of their own, and their ids' least still names the component; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import materialize, mix, scratch
from quillmill.llm.components import components

COSINE = 0.95
WIDTH = 2.0
IN_BUCKET = 256
RECALL = 0.999
LEAST_HASHES = 8
BLOCK = 512
TILE = 1024
SEED = 20


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that two points at a distance agree in one hash."""
    r = width / distance
    return 1 - 2 * 0.5 * math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(hashes in a table, tables) for n vectors."""
    near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2))
    k = max(LEAST_HASHES, round(math.log(max(n, 1) / IN_BUCKET) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def _projections(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, count)), rng.uniform(0, WIDTH, count)


def _buckets(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket numbers (vectors x tables)."""
    a, b = _projections(unit.shape[1], k * tables)
    hashes = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    out = np.full((len(unit), tables), np.uint64(unit.shape[1]))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[:, :, i])
    return out.view(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of vector in a list column."""
    lengths = np.asarray(column.value_lengths())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)].astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _linked(x: np.ndarray, y: np.ndarray | None, xk: np.ndarray, yk: np.ndarray | None, xn: np.ndarray, yn: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the unit vectors of one unit of work: (rows linked to, root), for x and then y; y is None for a block with itself.

    xk, yk: their buckets in earlier tables; xn, yn: how many rows each stands for. Roots number the vectors of x and then y.
    """
    own = y is None
    if own:
        y, yk, yn = x, xk, xn
    n, shift = len(x), 0 if own else len(x)
    count, root = np.zeros(n + (0 if own else len(y)), dtype=np.int64), np.arange(n + (0 if own else len(y)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(0, n, TILE):
        for j in range(i if own else 0, len(y), TILE):
            near = x[i : i + TILE] @ y[j : j + TILE].T >= cosine
            if own and i == j:
                np.fill_diagonal(near, False)
            for t in range(xk.shape[1]):
                if not near.any():
                    break
                near &= xk[i : i + TILE, t, None] != yk[None, j : j + TILE, t]
            if not near.any():
                continue
            count[i : i + len(near)] += near @ yn[j : j + TILE]
            if not (own and i == j):
                count[shift + j : shift + j + near.shape[1]] += near.T @ xn[i : i + TILE]
            # Labels of the tile's components, then one union for each vector whose label is new.
            a, b = np.arange(i, i + near.shape[0]), np.arange(shift + j, shift + j + near.shape[1])
            la, lb, none = a.copy(), b.copy(), np.iinfo(np.int64).max
            while True:
                na = np.minimum(la, np.where(near, lb[None, :], none).min(axis=1))
                nb = np.minimum(lb, np.where(near, na[:, None], none).min(axis=0))
                if own and i == j:
                    na = nb = np.minimum(na, nb)
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
            for v, label in zip(np.concatenate([a, b]), np.concatenate([la, lb])):
                if v != label and root[v] != root[label]:
                    p, q = top(v), top(label)
                    if p != q:
                        root[max(p, q)] = min(p, q)
    return count, np.array([top(i) for i in range(len(root))])


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each vector."""
    with scratch() as kept:
        rows, told = _told(vectors, id_col, vector_col, cosine)
        kept.keep(told)
    out = rows.select("id", "ha", "hb").join(told, ["ha", "hb"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _told(vectors: DataFrame, id_col: str, vector_col: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The rows (id, ha, hb) and, written, what is known of each class of equal vectors: (ha, hb, n_links, component_id)."""
    vector = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumns({"ha": F.when(F.col("good"), F.xxhash64("v")), "hb": F.when(F.col("good"), F.xxhash64(F.lit("second"), "v"))})
    # One row for each different vector; its number is fixed by writing it.
    classes = rows.where("good").groupBy("ha", "hb").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    k, tables = plan(classes.count(), cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at, x in _by_length(column):
                b = _buckets(_unit(x), k, tables)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[at], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(b.ravel())], ["node", "t", "bucket"])

    places = materialize(classes.select("node", "v").mapInArrow(hashed, "node long, t int, bucket long"), "buckets")
    sizes = places.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    block = F.greatest(F.lit(float(BLOCK)), 16 * F.sqrt("size"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    # A vector goes to every pair of blocks that holds its own.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    sent = places.join(sizes, ["t", "bucket"]).withColumn("own", own).withColumn("to", F.explode(spread)).select("node", "t", "bucket", "to.i", "to.j", (F.col("own") == F.col("to.j")).alias("right"))
    every = places.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "bucket"))).alias("b")).select("node", F.col("b.bucket").alias("b"))  # one entry for each table
    held = classes.select("node", "n", "v").join(every, "node")
    work = sent.join(held, "node").select("t", "bucket", "i", "j", "right", "node", "n", "v", F.expr("slice(b, 1, t)").alias("b"))

    def unit_of_work(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: whole.column(name).chunk(0) if whole.column(name).num_chunks else whole.column(name).combine_chunks()
        node, n, right = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "right"))
        t = int(whole.column("t")[0].as_py())
        same = whole.column("i")[0].as_py() == whole.column("j")[0].as_py()
        earlier = column("b").flatten().to_numpy(zero_copy_only=False).reshape(len(node), t)
        out = []
        for at, x in _by_length(column("v")):  # a bucket holds one length, but for collisions
            x = _unit(x)
            if same:
                count, root = _linked(x, None, earlier[at], None, n[at], None, cosine)
                names = node[at]
            else:
                r = right[at]
                count, root = _linked(x[~r], x[r], earlier[at][~r], earlier[at][r], n[at][~r], n[at][r], cosine)
                names = np.concatenate([node[at][~r], node[at][r]])
            hit = count > 0
            out.append((names[hit], count[hit], names[root[hit]]))
        names, count, root = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(count), pa.array(root)], ["node", "n", "root"]) if len(names) else None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for start, end in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[start])
                if key != now and parts:
                    if (got := unit_of_work(parts)) is not None:
                        yield got
                    parts = []
                now = key
                parts.append(batch.slice(start, end - start))
        if parts and (got := unit_of_work(parts)) is not None:
            yield got

    keys = ["t", "bucket", "i", "j"]
    found = materialize(work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "node long, n long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), "component")
    joined = classes.select("node", "ha", "hb", "n", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    told = joined.join(names, "component").join(counts, "node", "left").select("ha", "hb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows, materialize(told, "told")
