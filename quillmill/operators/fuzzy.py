"""Typo-tolerant matching: re-scoring of hits, and expansion of terms by edit distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.sources.written import written

NAME_WEIGHT, CONTENT_WEIGHT = 0.7, 0.3
THRESHOLD = 0.4
#: The parts of a query that are looked for: a part's errors fit the 32 bits of a lane.
LONGEST_PATTERN = 32
#: A text is searched in blocks of so many characters, and so many blocks are searched side by side, which bounds memory.
BLOCK, LANES = 512, 4096
#: Queries that meet a file's content at once, and bytes of hits up to which they are sent to the files; more are joined.
ASKED, SENT_BYTES = 256, 64 << 20


def least_errors(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """For each (pattern, text) the least number of edits that turn the pattern into some substring of the text. Patterns have 1 to 32 characters.

    Bit-parallel approximate matching (G. Myers, 1999): a column of the edit table is two words of bits, differences of plus and minus one, and a character of
    the text moves it in some fifteen operations however long the pattern is. Blocks of texts, each with its pattern, are the lanes of one array, so these
    operations are numpy's. A best substring is twice the pattern's length at most, so it stands whole in one of the overlapping blocks.
    """
    least = np.array([0 if p in t else len(p) for p, t in pairs], dtype=np.int64)
    patterns = {p: nr for nr, p in enumerate(dict.fromkeys(p for (p, _), n in zip(pairs, least) if n))}
    if not patterns:
        return least
    letters = {c: nr for nr, c in enumerate(sorted(set("".join(patterns))), 1)}  # 0: every character that no pattern holds
    kinds = np.zeros(0x110000, dtype=np.int32)
    kinds[[ord(c) for c in letters]] = list(letters.values())
    at_letter = np.zeros((len(patterns), len(letters) + 1), dtype=np.uint32)
    for p, nr in patterns.items():
        for place, c in enumerate(p):
            at_letter[nr, letters[c]] |= np.uint32(1 << place)

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        last, codes = None, np.zeros(0, dtype=np.int32)
        for nr, (p, t) in enumerate(pairs):
            if least[nr]:
                if t is not last:
                    last, codes = t, kinds[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                for at in range(0, len(codes), BLOCK):
                    yield nr, codes[at : at + BLOCK + 2 * len(p)]

    held: list[tuple[int, np.ndarray]] = []
    for block in blocks():
        held.append(block)
        if len(held) == LANES:
            _search(held, pairs, patterns, at_letter, least)
            held = []
    if held:
        _search(held, pairs, patterns, at_letter, least)
    return least


def _search(lanes: list[tuple[int, np.ndarray]], pairs: Sequence[tuple[str, str]], patterns: dict[str, int], at_letter: np.ndarray, least: np.ndarray) -> None:
    """Lowers ``least`` to what the lanes, blocks of the pairs' texts, hold. A lane that ends early goes on with characters of no pattern, which find nothing better."""
    owner = np.array([nr for nr, _ in lanes])
    wide = np.zeros((len(lanes), max(len(codes) for _, codes in lanes)), dtype=np.int32)
    for row, (_, codes) in zip(wide, lanes):
        row[: len(codes)] = codes
    of_pattern = np.array([patterns[pairs[nr][0]] for nr in owner], dtype=np.intp) * at_letter.shape[1]
    steps, flat = np.ascontiguousarray(wide.T), at_letter.ravel()
    last = np.array([1 << (len(pairs[nr][0]) - 1) for nr in owner], dtype=np.uint32)
    more, fewer = np.full(len(lanes), 0xFFFFFFFF, dtype=np.uint32), np.zeros(len(lanes), dtype=np.uint32)
    errors = np.array([len(pairs[nr][0]) for nr in owner], dtype=np.int8)
    best = errors.copy()
    same, across, up, down, rest = (np.empty_like(more) for _ in range(5))
    at = np.empty_like(of_pattern)
    for kinds in steps:
        np.add(of_pattern, kinds, out=at)
        np.take(flat, at, out=same, mode="clip")
        np.bitwise_and(same, more, out=across)  # across = (((same & more) + more) ^ more) | same
        across += more
        across ^= more
        across |= same
        np.bitwise_or(across, more, out=up)  # up = fewer | ~(across | more)
        np.invert(up, out=up)
        up |= fewer
        np.bitwise_and(more, across, out=down)
        errors += np.bitwise_and(up, last, out=rest).astype(bool).view(np.int8)
        errors -= np.bitwise_and(down, last, out=rest).astype(bool).view(np.int8)
        np.minimum(best, errors, out=best)
        up += up  # a place further
        down += down
        same |= fewer
        np.bitwise_or(same, up, out=more)  # more = down | ~(same | up)
        np.invert(more, out=more)
        more |= down
        np.bitwise_and(up, same, out=fewer)
    np.minimum.at(least, owner, best)


def substring_errors(pattern: str, text: str) -> int:
    """``least_errors`` of one pair."""
    return int(least_errors([(pattern, text)])[0])


def _field_scores(asked: Sequence[Sequence[str]], texts: Sequence[str]) -> list[list[float]]:
    """The scores of each text for each of its queries: 0 for equal texts, else the mean over the query's parts of the errors of the best substring by the
    part's length, 0.001 at least; 1 for an empty text."""
    pairs, shares = [], []
    low = [t.lower() for t in texts]
    for queries, text in zip(asked, low):
        for q in map(str.lower, queries):
            parts = [q[k : k + LONGEST_PATTERN] for k in range(0, len(q), LONGEST_PATTERN)] if text and q != text else []
            pairs += [(p, text) for p in parts]
            shares.append((len(parts), 0.0 if text else 1.0))
    found = least_errors(pairs) / np.array([len(p) for p, _ in pairs]) if pairs else np.zeros(0)
    scores, at = [], 0
    for n, plain in shares:
        scores.append(max(0.001, float(np.mean(found[at : at + n]))) if n else plain)
        at += n
    ends = np.cumsum([0, *map(len, asked)])
    return [scores[a:b] for a, b in zip(ends, ends[1:])]


def fuzzy_scores(asked: Sequence[Sequence[str]], names: Sequence[str | None], contents: Sequence[str | None], threshold: float = THRESHOLD) -> list[list[float | None]]:
    """For each file the scores of the queries that it is asked for. 0 is best; None when neither field is near enough or the query is under two characters."""
    fields = [([t or "" for t in texts], weight) for texts, weight in ((names, NAME_WEIGHT), (contents, CONTENT_WEIGHT))]
    total = [[1.0] * len(queries) for queries in asked]
    near = [[False] * len(queries) for queries in asked]
    for texts, weight in fields:
        for nr, (text, scores) in enumerate(zip(texts, _field_scores(asked, texts))):
            power = weight * round(1 / np.sqrt(max(1, len(text.split()))), 3)
            for k, score in enumerate(scores):
                if score <= threshold:
                    near[nr][k] = True
                    total[nr][k] *= max(score, 1e-9) ** power
    return [[s if ok and len(q) >= 2 else None for s, ok, q in zip(*three)] for three in zip(total, near, asked)]


def fuzzy_score(query: str | None, name: str | None, content: str | None, threshold: float = THRESHOLD) -> float | None:
    """``fuzzy_scores`` of one file and query."""
    return fuzzy_scores([[query or ""]], [name], [content], threshold)[0][0]


def fuzzy_rerank(hits: DataFrame, files: DataFrame, query_col: str = "query", threshold: float = THRESHOLD) -> DataFrame:
    """hits (id and the query among their columns) with fuzzy_score, without those that are not near; give it top results, not whole tables.

    The hits, without contents, are written and gathered by file, up to some ``ASKED`` queries in a row, and sent to the files where they are small enough by a count of
    their bytes: a content is read in its place, once for all its queries, and not shuffled. Larger ones are joined, which shuffles each content once. Hits
    without a query or a file, and queries under two characters, go.
    """
    kept = written(hits.where(F.length(query_col) >= 2), "hits")
    size = kept.agg(F.count_distinct(query_col).alias("queries"), F.sum(F.octet_length(query_col) + 24).alias("bytes")).first()
    slices = size["queries"] // ASKED + 1
    asked = kept.groupBy("id", F.pmod(F.xxhash64(query_col), F.lit(slices)).alias("slice")).agg(F.collect_set(query_col).alias("asked")).drop("slice")
    if (size["bytes"] or 0) <= SENT_BYTES:
        asked = F.broadcast(asked)

    @F.pandas_udf("array<double>")
    def scored(queries: pd.Series, names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_scores([list(q) for q in queries], list(names), list(contents), threshold), dtype=object)

    met = files.select("id", "name", "content").join(asked, "id")
    each = met.select("id", F.arrays_zip(F.col("asked").alias("q"), scored("asked", "name", "content").alias("s")).alias("z")).select("id", F.explode("z").alias("z"))
    near = each.select("id", F.col("z.q").alias(query_col), F.col("z.s").alias("fuzzy_score")).where(F.col("fuzzy_score").isNotNull() & ~F.isnan("fuzzy_score"))
    return kept.join(near, ["id", query_col]).select(*hits.columns, "fuzzy_score")


def _pieces(term, count: int):
    """The term cut into ``count`` pieces of nearly equal length, as (number, place, piece)."""
    n = F.length(term)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda k: F.struct(k.alias("k"), F.floor(k * n / count).cast("int").alias("at"), F.substr(term, F.floor(k * n / count).cast("int") + 1, F.floor((k + 1) * n / count).cast("int") - F.floor(k * n / count).cast("int")).alias("piece")),
    )


def fuzzy_expand_terms(terms: DataFrame, vocabulary: DataFrame, distance: int = 2, least: int = 5) -> DataFrame:
    """(wanted, term, edits): the vocabulary's terms within an edit distance of each wanted term.

    A term cut into distance + 1 pieces keeps one of them through any ``distance`` edits, moved by that many places at
    most. So every vocabulary term offers the substrings a piece could be, and the join is one on equal pieces; no
    vocabulary is compared with itself. Terms shorter than ``least`` are matched as they are.
    """
    count = distance + 1
    wanted = terms.select(F.col("term").alias("wanted")).distinct()
    short = wanted.where(F.length("wanted") < least).join(vocabulary.select("term").distinct(), F.col("wanted") == F.col("term")).select("wanted", "term", F.lit(0).alias("edits"))
    long = wanted.where(F.length("wanted") >= least).withColumn("p", F.explode(_pieces(F.col("wanted"), count))).select("wanted", "p.at", "p.piece", F.length("wanted").alias("n"))
    sizes = long.select(F.length("piece").alias("size"), "at").distinct()  # a few numbers: lengths of pieces and their places
    words = vocabulary.select("term").distinct().where(F.length("term") >= least - distance)
    spread = words.join(F.broadcast(sizes), F.length("term") >= F.col("size"))
    places = F.sequence(F.greatest(F.col("at") - distance, F.lit(0)), F.col("at") + distance)
    offered = spread.select("term", "at", F.explode(F.array_distinct(F.transform(places, lambda p: F.substr("term", p + 1, F.col("size"))))).alias("piece")).where("piece <> ''")
    near = long.join(offered, ["at", "piece"]).where(F.abs(F.length("term") - F.col("n")) <= distance).select("wanted", "term").distinct()
    near = near.withColumn("edits", F.levenshtein("wanted", "term", distance)).where("edits >= 0")
    return short.unionByName(near)
