"""MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding, and exact verification.

A text is lower-cased and cut into words (runs of anything but ASCII white space); its shingles are runs of five words
(all of them, if it has fewer). A text has two signatures, in one all shingles weigh 1 and in the other
1 + ln(times they occur); without repeated shingles they are the same. In a signature of m registers every
shingle is a Poisson process of arrivals whose rate is its weight; each arrival falls on a random register, and
a register keeps the shingle that comes first, so that two texts agree in a register with the probability
Jaccard similarity of their weighted shingles. A shingle's process ends once its time passes the latest register's.
Registers are cut into bands; texts that agree in a whole band, of whichever signatures, share a bucket and are candidates.
Where all weigh 1 the probability Jaccard similarity is that of the sets, which decides links: with 22 bands
of 6 registers a pair of similarity 0.8 is a candidate with probability 0.998, however often a text repeats its parts.

Candidates are verified by the exact Jaccard similarity of their sets of shingles; 0.8 or more is a link, and a
group is what links connect. Equal texts are one class from the start and only one of them is hashed into buckets.
Buckets are worked on in pairs of blocks, so that a hot bucket is spread over many tasks. In a unit of work only
texts outside its largest group are compared with the others, and only a spanning forest of the links leaves
it: no pair of texts that are not yet connected is skipped, and no list of pairs is ever made. The first bands are
worked on first; of the others only the buckets that still hold different groups.

Defined cases: null and empty texts and texts of white space link with nothing but equal texts of words do;
rows with null ids take part, a group's name is its least id that is not null; rows with equal ids are told apart by
their text; rows repeated as a whole are one document and are kept or dropped together; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import give_back, joined, materialize, mix, pieces, private_prefix, scratch, shingles, word_hashes
from quillmill.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 22, 6
FIRST_BANDS = 4
BLOCK = 256
#: So many characters, one text at least, are hashed at a time; it bounds a worker's memory and changes no result.
PIECE = 400_000


def _words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    run = np.cumsum([len(t or "") for t in texts]) // PIECE
    for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(run)) + 1):
        data, ends = joined([(texts[i] or "").lower() for i in some])
        start, _, words = word_hashes(data)
        until = np.searchsorted(start, ends)
        begin = 0
        for end in until:
            yield words[begin:end]
            begin = end


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text."""
    return [np.unique(shingles(w, WORDS)) for w in _words(texts)]


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of each run of weighted elements: (runs x m), the element that comes first in each register."""
    n = len(counts)
    first, times = np.zeros(n * m, dtype=np.uint64), np.full(n * m, np.inf)
    run = np.repeat(np.arange(n), counts)
    alone = counts == 1  # its only element comes first everywhere
    first.reshape(n, m)[alone] = elements[np.cumsum(counts)[alone] - 1][:, None]
    active = np.flatnonzero(~alone[run])
    now = np.zeros(len(elements))
    turn = 0
    with np.errstate(over="ignore"):
        while len(active):
            turn += 1
            e = elements[active]
            a = mix(e + np.uint64(2 * turn) * np.uint64(0x9E3779B97F4A7C15))
            b = mix(a ^ np.uint64(0xD1B54A32D192ED03))
            now[active] += -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weights[active]
            t, slot = now[active], run[active] * m + (b % np.uint64(m)).astype(np.int64)
            sooner = np.flatnonzero(t < times[slot])
            sooner = sooner[np.argsort(-t[sooner], kind="stable")]  # of equal slots the last one written, the earliest, stays
            times[slot[sooner]], first[slot[sooner]] = t[sooner], e[sooner]
            here = np.unique(run[active])
            latest = np.full(n, -np.inf)
            latest[here] = times.reshape(n, m)[here].max(axis=1)
            active = active[t < latest[run[active]]]
    return first.reshape(n, m)


def _buckets(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Bucket of each set, none of them empty, in each band."""
    first = signatures(np.concatenate(sets), np.concatenate(weights), np.array([len(s) for s in sets])).reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), first.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + first[:, :, r])
    return out.view(np.int64)


def band_keys(texts: list[str | None]) -> list[np.ndarray]:
    """The buckets of each text: one for each band, then, if it repeats shingles, one for each band of its weighted signature; none without words."""
    sets, times = [], []
    for w in _words(texts):
        s, n = np.unique(shingles(w, WORDS), return_counts=True)
        sets.append(s)
        times.append(n)
    keys = [np.empty(0, dtype=np.int64)] * len(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        for i, k in zip(full, _buckets([sets[i] for i in full], [np.ones(len(sets[i])) for i in full])):
            keys[i] = k
    repeating = [i for i in full if (times[i] > 1).any()]
    if repeating:
        for i, k in zip(repeating, _buckets([sets[i] for i in repeating], [1.0 + np.log(times[i]) for i in repeating])):
            keys[i] = np.concatenate([keys[i], k])
    return keys


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ta, tb) -> (id, ta, tb, keys)"""
    for batch in pieces(batches, "text", PIECE):
        keys = band_keys(batch.column(1).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], ["id", "ta", "tb", "keys"])


def spanning_links(sets: list[np.ndarray], groups: np.ndarray, similarity: float = SIMILARITY, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the given groups of one unit of work, as many as unions; with ``left`` only between left and right."""
    n = len(sets)
    names, root = np.unique(groups, return_inverse=True)
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    if len(names) < 2:
        return out
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and both >= similarity * (sizes.sum() - both) else out
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    holders, begin = owner[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    ends = np.cumsum(sizes)
    largest = np.bincount(root).argmax()
    for x in np.flatnonzero(root != largest):
        mine = code[ends[x] - sizes[x] : ends[x]]
        length = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.bincount(holders[at], minlength=n)
        hit = (both >= similarity * (sizes[x] + sizes - both)) & (both > 0) & (root != root[x])
        if left is not None:
            hit &= left != left[x]
        for y in np.flatnonzero(hit):
            p, q = top(root[x]), top(root[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(x), int(y)))
    return out


def _compare(placed: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """placed: (node, t, key, size, grp); held: (node, text) -> (a, b), links that join different groups."""
    block = F.greatest(F.lit(float(BLOCK)), 8 * F.sqrt("size"))
    placed = placed.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    sent = placed.withColumn("own", own).withColumn("to", F.explode(spread)).select("node", "t", "key", "to.i", "to.j", (F.col("own") == F.col("to.j")).alias("right"), "grp")
    work = sent.join(held, "node").select("t", "key", "i", "j", "right", "node", "grp", "text")

    def unit_of_work(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        whole = pa.Table.from_batches(parts)
        node, place = np.unique(whole["node"].to_numpy(), return_index=True)  # a row repeated as a whole comes once
        if len(node) < 2:
            return []
        whole = whole.take(place)
        groups = whole["grp"].to_numpy()
        if (groups == groups[0]).all():
            return []
        same = whole["i"][0].as_py() == whole["j"][0].as_py()
        right = None if same else whole["right"].to_numpy()
        return [(int(node[x]), int(node[y])) for x, y in spanning_links(shingle_sets(whole["text"].to_pylist()), groups, similarity, right)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, parts, found = None, [], []
        give_back()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for start, end in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[start])
                if key != now and parts:
                    found += unit_of_work(parts)
                    parts = []
                now = key
                parts.append(batch.slice(start, end - start))
            if len(found) > 10_000:
                yield flush(found)
                found = []
        if parts:
            found += unit_of_work(parts)
        if found:
            yield flush(found)

    keys = ["t", "key", "i", "j"]
    return work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "a long, b long")


def _with_identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit("second"), text).alias("tb"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(ta, tb, component_id, n_texts): for each different text that is not alone, by its two hashes, the least id of its group and how many different texts that has."""
    with scratch() as kept:
        return kept.keep(_groups(docs, id_col, text_col, similarity))


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    rows = _with_identity(docs, id_col, text_col)
    hashes = rows.mapInArrow(_hashed, "id long, ta long, tb long, keys array<long>").where(F.size("keys") > 0)
    classes = hashes.groupBy("ta", "tb").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Both signatures share buckets; a text stands once in each.
    unit = F.col("keys")[F.col("t") % BANDS]
    places = classes.select("node", "keys", F.posexplode("keys").alias("t", "key")).where((F.col("t") < BANDS) | (F.col("key") != unit)).select("node", (F.col("t") % BANDS).alias("t"), "key")
    sizes = places.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = materialize(places.join(sizes, ["t", "key"]), "places")
    # Only texts that share a bucket are fetched, once, for both passes.
    needed = placed.select("node").distinct().join(classes.select("node", "ta", "tb", "least"), "node")
    found = rows.join(needed, (rows["ta"] == needed["ta"]) & (rows["tb"] == needed["tb"]) & rows["id"].eqNullSafe(needed["least"]))
    held = materialize(found.select("node", "text"), "texts")
    first = materialize(_compare(placed.where(F.col("t") < FIRST_BANDS).withColumn("grp", F.col("node")), held, similarity), "links")
    joined_first = components(first).withColumnsRenamed({"id": "node", "component": "grp"})
    labelled = placed.where(F.col("t") >= FIRST_BANDS).join(joined_first, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    mixed = labelled.groupBy("t", "key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("t", "key")
    second = materialize(_compare(labelled.join(mixed, ["t", "key"]), held, similarity), "links")
    # The first pass's groups stand for its links as stars, which need one round however long its chains were.
    stars = joined_first.select(F.col("node").alias("a"), F.col("grp").alias("b"))
    whole = components(stars.union(second)).withColumnsRenamed({"id": "node"})
    named = classes.select("node", "ta", "tb", "least", "copies").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_texts"))
    return materialize(named.join(names, "component").where("n_texts > 1 OR copies > 1").select("ta", "tb", "component_id", "n_texts"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id, n_texts, kept), one row for each document: its group's least id, the group's different texts, whether it stays."""
    found = groups(docs, id_col, text_col, similarity)
    rows = _with_identity(docs, id_col, text_col).drop("text").join(found, ["ta", "tb"], "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_col), component.alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with only the document of least id of each group."""
    found, own = groups(docs, id_col, text_col, similarity), private_prefix(docs.columns, "__nd_")
    gone = found.select(F.col("ta").alias(f"{own}ta"), F.col("tb").alias(f"{own}tb"), F.col("component_id").alias(f"{own}least"))
    text = F.col(text_col)
    same = (F.xxhash64(text) == F.col(f"{own}ta")) & (F.xxhash64(F.lit("second"), text) == F.col(f"{own}tb"))
    joined_ = docs.join(gone, same, "left")
    stays = F.col(f"{own}ta").isNull() | F.col(id_col).cast("long").eqNullSafe(F.col(f"{own}least"))
    return joined_.where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])
