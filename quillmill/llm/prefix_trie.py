"""The trie of conversation prefixes: which conversations begin alike, and what is saved when a shared beginning is kept once.

Conversations are ordered by turn (null first; ties by the MD5 of role and text) and rebuilt: the first h turns of conversation c - c % 5, then c's own
turns after its first h, h being the unsigned crc32 of c in decimals modulo 9. A node is a distinct sequence of first turns; it is told by its
depth and two 64-bit hashes, the exclusive or of hashes of (place, turn) up to there, and named by the smallest member's conv_id and its depth. A member's row knows its node's
hashes and, without its own turn, those of the parent.

Totals of subtrees come by centroid decomposition of the forest of parent edges. A component is a connected part of the trie with its top. Its centroid
is the deepest node with more than half of its nodes below it (itself included). The component's values from the centroid down are summed and added to every node on the path from
the centroid's parent to the top; the centroid is done then, and what hangs below it and what is left above are components of at most half the size. So a trie as deep as the
longest conversation takes as many rounds as its number of nodes has bits. Components of more than ``MOST`` nodes are split by joins, all of them in one
round: the path is the rows of the centroid's own smallest member, and a node lies below the centroid if its smallest member passes there. Components of at most ``MOST`` nodes
are taken to the end inside a task. What the rounds send to all tasks is one row for each component of more than ``MOST`` nodes.

No step gathers a conversation or a node's members in one task: turns are numbered by ranges of (conv_id, turn), hashes are combined by blocks of ``BLOCK`` turns, members
are counted with partial sums. Only the text of a node's conv_ids, whose SHA-256 is wanted and cannot be combined from parts, runs through one task as pieces,
in bounded memory. Texts stay where they are read; their MD5 and length go on.

Defined cases: a null role or text is empty; rows with a null conv_id belong to no conversation; conversations that lose all turns are members of the root only; rows that
repeat a turn count as often as they stand; c % 5 has the sign of c; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.llm.common import drop, materialize, scratch

EVERY = 5
HEADS = 9
BLOCK = 256
MOST = 50_000
#: Nodes that a task works on at once, and bytes of a piece of conv_ids.
AT_ONCE, PIECE = 200_000, 1 << 16
#: Components of more than MOST nodes that are sent to all tasks; beyond that they are joined.
SENT = 100_000


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, with each one's number among those of its conversation in this partition."""
    last, count = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        number = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv)))) + 1
        if conv[0] == last:
            number[: start[1] if len(start) > 1 else len(conv)] += count
        last, count = conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4)), pa.array(number)], ["conv_id", "m", "n_bytes", "pid", "k"])


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, k, m, n_bytes): the turns of each conversation in order, m telling a turn by role and text; and (conv_id, n) of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    m = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = materialize(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn"), m.alias("m"), F.octet_length(text).cast("long").alias("n_bytes")), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "m"]
    # Rows that are equal as a whole may fall into one range; their place in the written table parts them.
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order)
    numbered = materialize(ranged.select("conv_id", "turn", "m", "n_bytes", F.spark_partition_id().alias("pid")).mapInArrow(_number, "conv_id long, m binary, n_bytes long, pid int, k long"), "numbered")
    drop(turns)
    parts = numbered.groupBy("conv_id", "pid").agg(F.max("k").alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("pid", "n"))).alias("parts"))
    parts = materialize(parts, "lengths")
    # A partition shares at most its first and last conversation with others, so this is at most two rows for each.
    before = F.transform("parts", lambda x, i: F.struct(x["pid"].alias("pid"), F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("before")))
    cut = parts.where(F.size("parts") > 1).select("conv_id", F.explode(before).alias("x")).select("conv_id", "x.*")
    whole = numbered.join(F.broadcast(cut), ["conv_id", "pid"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "m", "n_bytes")
    return whole, parts.select("conv_id", "n")


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, n_pos, m, n_bytes): the turns of the rebuilt conversations; and (conv_id, n_pos), turnless ones too."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = lengths.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    of = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(of, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_pos")), "rebuilt")
    own = turns.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("pos"), "n_pos", "m", "n_bytes")
    first = turns.where(F.col("k") < HEADS).withColumnRenamed("conv_id", "base").join(convs, "base").where("k <= h").select("conv_id", F.col("k").alias("pos"), "n_pos", "m", "n_bytes")
    return own.unionByName(first), convs.select("conv_id", "n_pos")


def prefixes(turns: DataFrame) -> DataFrame:
    """Each row of a rebuilt conversation with p1, p2, the hashes of the sequence that ends there, and q1, q2, those of the one before."""
    terms = {f"t{s}": F.xxhash64(F.lit(s), F.col("pos"), F.col("m")) for s in (1, 2)}
    rows = turns.withColumns(terms | {"block": F.floor((F.col("pos") - 1) / BLOCK)}).drop("m")
    upto = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumns({f"p{s}": F.bit_xor(f"t{s}").over(upto) for s in (1, 2)})
    sums = rows.where(F.col("n_pos") > BLOCK).groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{s}").alias(f"o{s}") for s in (1, 2)])
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *[F.bit_xor(f"o{s}").over(earlier).alias(f"o{s}") for s in (1, 2)])
    both = inside.join(sums, ["conv_id", "block"], "left")
    whole = {f"p{s}": F.col(f"p{s}").bitwiseXOR(F.coalesce(f"o{s}", F.lit(0))) for s in (1, 2)}
    both = both.select("conv_id", "pos", "n_pos", "n_bytes", *[whole[f"p{s}"].alias(f"p{s}") for s in (1, 2)], "t1", "t2")
    return both.select("conv_id", "pos", "n_pos", "n_bytes", "p1", "p2", *[F.col(f"p{s}").bitwiseXOR(F.col(f"t{s}")).alias(f"q{s}") for s in (1, 2)])


def _forest(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The nodes but for the root, (rep, depth, parent, n_convs, n_children, n_bytes), and the path of each conversation, (conv_id, pos, rep,
    parent, is_last), rep and parent being the smallest members of a node and of its parent; the root's smallest member and its number of members."""
    root, n = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    plain = rows.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("q1", "q2", "n_bytes")])
    plain = materialize(plain, "nodes")
    below = plain.groupBy((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    above = plain.select((F.col("pos") + 1).alias("pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent"))
    # All nodes of depth 1 have one parent, the root; they need no join.
    deep = plain.where("pos > 1").join(above, ["pos", "q1", "q2"])
    nodes = plain.where("pos = 1").withColumn("parent", F.lit(root).cast("long")).unionByName(deep.select(*plain.columns, "parent"))
    nodes = nodes.join(below, ["pos", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumnRenamed("pos", "depth"), "forest")
    named = nodes.select(F.col("depth").alias("pos"), "p1", "p2", "rep", "parent")
    paths = rows.join(named, ["pos", "p1", "p2"]).select("conv_id", "pos", "rep", "parent", (F.col("pos") == F.col("n_pos")).alias("is_last"))
    return nodes, materialize(paths, "paths"), root, n


def _sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(rep, depth, size): nodes below each, itself included. A conversation is the smallest member of the last nodes of its path, if of any."""
    owned = nodes.groupBy("rep").agg(F.min("depth").alias("first"), F.max("depth").alias("last")).withColumnRenamed("rep", "conv_id")
    met = paths.join(owned, "conv_id").select("rep", F.col("pos").alias("depth"), (F.col("last") - F.greatest("first", "pos") + 1).alias("size"))
    return met.groupBy("rep", "depth").agg(F.sum("size").alias("size"))


def decompose(top: np.ndarray, depth: np.ndarray, parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of values over the subtrees of a forest, by centroid decomposition of all its components at once.

    top: component numbers, 0 to n - 1; rows of a component stand together, sorted by depth; parent: row of the parent, -1 for tops; size: nodes of a subtree; values: a column each.
    """
    n = len(top)
    enter, free = np.zeros(n, dtype=np.int64), 0
    after = [0] * n  # where a node's next child is entered
    for i, (p, s) in enumerate(zip(parent.tolist(), size.tolist())):
        if p < 0:
            enter[i], free = free, free + s
        else:
            enter[i] = after[p]
            after[p] += s
        after[i] = int(enter[i]) + 1
    leave = enter + size
    comp, weight, sums = top.copy(), size.copy(), np.zeros_like(values)
    alive = np.arange(n)
    while len(alive):
        # Rows of a component stand together, in the order they are entered, the top first.
        alive = alive[np.lexsort((enter[alive], comp[alive]))]
        starts = np.flatnonzero(np.append(True, comp[alive][1:] != comp[alive][:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(alive))))
        heavy = np.flatnonzero(2 * weight[alive] > weight[alive[starts]][group])
        heavy = heavy[np.lexsort((depth[alive[heavy]], group[heavy]))]
        centre = np.empty(len(starts), dtype=np.int64)
        centre[group[heavy]] = alive[heavy]  # the deepest comes last
        c = centre[group]
        low = (enter[alive] >= enter[c]) & (enter[alive] < leave[c])
        path = (enter[alive] < enter[c]) & (enter[c] < leave[alive])
        total = np.zeros((len(values), len(starts)), dtype=values.dtype)
        for k in range(len(values)):
            np.add.at(total[k], group[low], values[k, alive[low]])
        sums[:, alive[path]] += total[:, group[path]]
        weight[alive[path]] -= weight[c[path]]
        sums[:, centre] += total
        below = low & (alive != c)
        tops = parent[alive] == c
        comp[alive[below]] = len(starts) + np.cumsum(tops & below)[below]
        comp[alive[~low]] = group[~low]
        alive = alive[alive != c]
    return sums


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, sorted by top and depth: each node's sums."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        col = {name: t.column(name).to_numpy() for name in t.column_names}
        same = (col["top_rep"][1:] == col["top_rep"][:-1]) & (col["top_depth"][1:] == col["top_depth"][:-1])
        top = np.cumsum(np.append(True, ~same)) - 1
        at = {key: i for i, key in enumerate(zip(col["rep"].tolist(), col["depth"].tolist()))}
        is_top = (col["rep"] == col["top_rep"]) & (col["depth"] == col["top_depth"])
        parent = np.array([-1 if t else at[p, d - 1] for t, p, d in zip(is_top.tolist(), col["parent"].tolist(), col["depth"].tolist())], dtype=np.int64)
        sums = decompose(top, col["depth"], parent, col["size"], np.stack([col["leaf"], col["saved"]]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (col["rep"], col["depth"], sums[0] + col["more_leaves"], sums[1] + col["more_saved"])], ["rep", "depth", "n_leaves", "saved_tokens"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < AT_ONCE:
            continue
        t = pa.Table.from_batches(held)
        rep, depth = t.column("top_rep").to_numpy(), t.column("top_depth").to_numpy()
        last = np.flatnonzero((rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1]))
        if len(last):  # up to where the last component begins
            yield out(t.slice(0, int(last[-1]) + 1))
            held = t.slice(int(last[-1]) + 1).to_batches()
    if held:
        yield out(pa.Table.from_batches(held))


def _split(part: DataFrame, paths: DataFrame, root: int, most: int) -> tuple[DataFrame, DataFrame]:
    """One round over the components of more than ``most`` nodes: (finished centroids with their sums, the components after it)."""
    tops = part.where("rep = top_rep AND depth = top_depth").select("top_rep", "top_depth", F.col("size").alias("whole"))
    small = lambda df: F.broadcast(df) if df.count() <= SENT else df
    key = ["top_rep", "top_depth"]
    heavy = part.join(small(tops), key).where(2 * F.col("size") > F.col("whole"))
    centre = heavy.groupBy(*key).agg(F.max(F.struct("depth", "rep", "size")).alias("c")).select(*key, F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
    centre = materialize(centre, "centroids")
    x = part.join(small(centre), key)
    # Does a node's smallest member pass through the centroid? One row for each member and component is asked.
    asked = x.where("rep <> c_rep").select(*key, "rep", "c_rep", "c_depth").distinct()
    step = paths.select(F.col("conv_id").alias("rep"), (F.col("pos") - 1).alias("c_depth"), F.col("rep").alias("child"), F.col("parent").alias("c_rep"))
    passing = asked.join(step, ["rep", "c_depth", "c_rep"]).select(*key, "rep", "child")
    x = x.join(passing, [*key, "rep"], "left")
    child = F.when(F.col("rep") != F.col("c_rep"), F.col("child")).when(F.col("depth") > F.col("c_depth"), F.col("c_rep"))
    centred = (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))
    x = materialize(x.withColumn("child", child).withColumn("centred", centred), "parted")
    low = x.where("centred OR child IS NOT NULL").groupBy(*key).agg(F.sum("leaf").alias("low_leaves"), F.sum("saved").alias("low_saved"))
    centre = materialize(centre.join(small(low), key), "totals")
    done = x.where("centred").join(small(centre.select(*key, "low_leaves", "low_saved")), key).select("rep", "depth", (F.col("more_leaves") + F.col("low_leaves")).alias("n_leaves"), (F.col("more_saved") + F.col("low_saved")).alias("saved_tokens"))
    on = small(centre.where("c_depth > top_depth").withColumnRenamed("c_rep", "conv_id"))
    add = ["c_size", "low_leaves", "low_saved"]
    path = paths.join(on, "conv_id").where("pos >= top_depth AND pos < c_depth").select("rep", F.col("pos").alias("depth"), *add)
    path = path.unionByName(centre.where("top_depth = 0 AND c_depth > 0").select(F.lit(root).cast("long").alias("rep"), F.lit(0).cast("long").alias("depth"), *add))
    below = x.where("NOT centred AND child IS NOT NULL").withColumns({"top_rep": F.col("child"), "top_depth": F.col("c_depth") + 1}).select(*part.columns)
    rest = x.where("NOT centred AND child IS NULL").select(*part.columns).join(path, ["rep", "depth"], "left")
    plus = {"size": -F.col("c_size"), "more_leaves": F.col("low_leaves"), "more_saved": F.col("low_saved")}
    rest = rest.withColumns({c: F.col(c) + F.coalesce(v, F.lit(0)) for c, v in plus.items()}).select(*part.columns)
    return materialize(done, "done"), materialize(below.unionByName(rest), "components")


def roll_up(nodes: DataFrame, paths: DataFrame, root: int, most: int = MOST) -> DataFrame:
    """(rep, depth, n_leaves, saved_tokens) of the forest's nodes (rep, depth, parent, size, leaf, saved), root and all."""
    zero = F.lit(0).cast("long")
    part = nodes.withColumns({"top_rep": F.lit(root).cast("long"), "top_depth": zero, "more_leaves": zero, "more_saved": zero})
    done, small = [], []
    while True:
        tops = part.where("rep = top_rep AND depth = top_depth").select("top_rep", "top_depth", (F.col("size") > most).alias("large"))
        tops = materialize(tops, "tops")
        if tops.where("large").isEmpty():
            small.append(part)
            break
        told = F.broadcast(tops.where("large").select("top_rep", "top_depth", "large")) if tops.where("large").count() <= SENT else tops.where("large")
        marked = part.join(told, ["top_rep", "top_depth"], "left")
        small.append(marked.where("large IS NULL").drop("large"))
        over, part = _split(marked.where("large").drop("large"), paths, root, most)
        done.append(over)
    whole = small[0]
    for s in small[1:]:
        whole = whole.unionByName(s)
    columns = ["top_rep", "top_depth", "rep", "depth", "parent", "size", "leaf", "saved", "more_leaves", "more_saved"]
    dealt = whole.select(*columns).repartition("top_rep", "top_depth").sortWithinPartitions("top_rep", "top_depth", "depth")
    out = dealt.mapInArrow(_local, "rep long, depth long, n_leaves long, saved_tokens long")
    for d in done:
        out = out.unionByName(d)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rep, depth, conv_id) -> (rep, depth, first, text): the conv_ids of a node that stand together here, in pieces."""
    key, ids, size, rows = None, [], 0, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["rep", "depth", "first", "text"])

    for b in batches:
        for rep, depth, c in zip(*(x.to_pylist() for x in b.columns)):
            if key != (rep, depth) or size > PIECE:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids, size = (rep, depth), [], 0
            ids.append(c)
            size += 12
        if len(rows) > 10_000 or sum(len(r[3]) for r in rows[-64:]) > 2_000_000:
            yield batch()
            rows = []
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
    if rows:
        yield batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (rep, depth, sha): a node's pieces run through one hash, none is held."""
    key, sha = None, None
    for b in batches:
        out = []
        for rep, depth, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
            if key == (rep, depth):
                sha.update(b"," + text.encode())
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (rep, depth), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["rep", "depth", "sha"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], ["rep", "depth", "sha"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(rep, depth, sha) of (rep, depth, conv_id): SHA-256 of each node's conv_ids, ascending, with commas between."""
    cut = ends.repartitionByRange("rep", "depth", "conv_id").sortWithinPartitions("rep", "depth", "conv_id").mapInArrow(_pieces, "rep long, depth long, first long, text string")
    return cut.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(_hashes, "rep long, depth long, sha string")


def trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node."""
    with scratch() as kept:
        turns, lengths = numbered_turns(conversations)
        whole, convs = rebuilt(turns, lengths)
        rows = materialize(prefixes(whole), "prefixes")
        nodes, paths, root, n_convs = _forest(rows, convs)
        if root is None:
            empty = conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
            return empty
        zero = F.lit(0).cast("long")
        top = nodes.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("depth") == 1).alias("n_children"))
        top = top.select(F.lit(root).cast("long").alias("rep"), zero.alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", zero.alias("n_bytes"), (F.col("size") + 1).alias("size"))
        sized = nodes.join(_sizes(nodes, paths), ["rep", "depth"]).select(*top.columns).unionByName(top)
        sized = materialize(sized.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "sized")
        sums = roll_up(sized.select("rep", "depth", "parent", "size", "leaf", "saved"), paths, root, most)
        ends = paths.where("is_last").select("rep", F.col("pos").alias("depth"), "conv_id").unionByName(convs.where("n_pos = 0").select(F.lit(root).cast("long").alias("rep"), zero.alias("depth"), "conv_id"))
        found = sized.join(sums, ["rep", "depth"]).join(ends_hashes(ends), ["rep", "depth"], "left")
        out = found.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
        return kept.keep(materialize(out, "trie"))


#: The same in DuckDB; every node meets all nodes above it, which is for small tables only.
SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
turns AS (
  SELECT conv_id, m, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS k FROM (
    SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS m, strlen(text)::BIGINT AS n_bytes
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
heads AS (SELECT c.conv_id, k AS pos, m, n_bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND k <= h),
taken AS (SELECT c.conv_id, h, count(pos) AS taken FROM convs c LEFT JOIN heads USING (conv_id) GROUP BY ALL),
rebuilt AS (SELECT conv_id, pos, m, n_bytes FROM heads UNION ALL SELECT t.conv_id, k - h + taken, m, n_bytes FROM turns t JOIN taken USING (conv_id) WHERE k > h),
rows AS (
  SELECT conv_id, pos AS depth, n_bytes, string_agg(m, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
longest AS (SELECT conv_id, max(depth) AS n FROM rows GROUP BY conv_id),
nodes AS (SELECT p, depth, min(r.conv_id) AS rep, count(*) AS n_convs, min(n_bytes) AS n_bytes, string_agg(r.conv_id::VARCHAR, ',' ORDER BY r.conv_id) FILTER (depth = n) AS ends FROM rows r JOIN longest USING (conv_id) GROUP BY p, depth),
tree AS (SELECT n.*, up.rep AS parent, count(down.p) AS n_children FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.p = left(n.p, -32) AND up.depth = n.depth - 1 LEFT JOIN nodes down ON down.depth = n.depth + 1 AND left(down.p, -32) = n.p GROUP BY ALL),
sums AS (
  SELECT r.p, r.depth, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.n_bytes)::BIGINT AS saved
  FROM tree x JOIN rows r ON r.conv_id = x.rep AND r.depth <= x.depth GROUP BY r.p, r.depth)
SELECT rep AS conv_id, t.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM tree t JOIN sums s ON s.p = t.p AND s.depth = t.depth
"""
