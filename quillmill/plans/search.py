"""Searches: matching, ranking, filtering and dressing of results, for many queries in one job.

Content stays out of every shuffle: hits carry ids and ranks until the top results are known.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill import schemas
from quillmill.functions.paths import extension
from quillmill.functions.text import snippet_of
from quillmill.operators import filters, match, rank, results
from quillmill.operators.index import build_postings, doc_stats, term_stats, tokenize
from quillmill.operators.unindexed import Texts
from quillmill.sources.writers import PART_ROWS, drawn_bounds, part_of, write_index
from quillmill.sources.written import sent


@dataclass
class Options:
    """Filters of a search; empty values and bounds of 0 are none."""

    file_types: list[str] = field(default_factory=list)
    size_least: int = 0
    size_most: int = 0
    since: str | None = None
    until: str | None = None
    k: int = rank.TOP
    ext_match: str = "file_type"
    dedup: bool = False
    #: Edits within which other words count as the wanted ones; 0: none.
    typos: int = 0


@dataclass
class Index:
    """files, their postings, vocabulary and statistics; ``stems`` says that the terms are stems."""

    files: DataFrame
    postings: DataFrame
    stats: DataFrame
    vocabulary: DataFrame
    stems: bool = False
    #: The bounds of the parts that the postings stand in, if they were written.
    bounds: list[str] | None = None
    #: (doc_id, gone): rows of postings whose segment is below ``gone`` are of a former version of the file; see ``live_index``.
    gone: DataFrame | None = None

    def postings_of(self, expanded: DataFrame) -> DataFrame:
        """The postings in the parts of the terms that are looked for; the numbers of these parts, MOST_PARTS at most, are read first."""
        if not self.bounds:
            return self.postings
        parts = [r[0] for r in expanded.select(part_of(F.col("term"), self.bounds).alias("part")).distinct().collect()]
        return self.postings.where(F.col("part").isin(parts))

    def alive(self, postings: DataFrame) -> DataFrame:
        """Postings without those of former versions of files."""
        gone = self.gone
        return postings if gone is None else postings.join(gone, (postings["doc_id"] == gone["doc_id"]) & (postings["segment"] < gone["gone"]), "left_anti")

    def hits(self, terms: DataFrame, phrases: bool, typos: int = 0, field: str | None = None) -> DataFrame:
        """(query_id, nr, doc_id, f) of the expressions."""
        expanded = match.expand_terms(terms, self.vocabulary, typos)
        postings = self.postings_of(expanded)
        if field:
            postings = postings.where(F.col("field") == field)
        return match.term_hits(expanded, postings, phrases, self.gone)

    @classmethod
    def of(cls, files: DataFrame, stems: bool = False) -> Index:
        """An index that is computed anew in every use; for searches over more than a few files see ``build``."""
        postings = build_postings(files, stems=stems)
        return cls(files, postings, doc_stats(files), term_stats(postings), stems)

    @classmethod
    def build(cls, files: DataFrame, folder: str, stems: bool = False, part_rows: int = PART_ROWS) -> Index:
        """An index written to a folder, which is what searches should read: postings are counted once and read by column and part."""
        bounds = drawn_bounds(files, lambda some: build_postings(some, stems=stems), part_rows)
        write_index(None, build_postings(files, stems=stems), doc_stats(files), folder, part_rows, bounds)
        return cls.read(files, folder, stems)

    @classmethod
    def read(cls, files: DataFrame, folder: str, stems: bool = False) -> Index:
        read = lambda schema, name: files.sparkSession.read.schema(schema).parquet(f"{folder}/{name}")
        bounds = sorted(r["bound"] for r in read("bound string", "bounds").collect())
        return cls(files, read(schemas.POSTINGS_IN_PARTS, "postings"), read(schemas.DOC_STATS, "doc_stats"), read(schemas.VOCABULARY, "vocabulary"), stems, bounds)


#: What results have of their files.
ABOUT = ["path", "name", "size", "hash", "file_type", "updated_at"]


def _allowed(files: DataFrame, options: Options) -> DataFrame:
    """The files that may be results."""
    slim = filters.filter_supported(files)
    slim = filters.filter_file_types(slim, options.file_types)
    slim = filters.filter_size_range(slim, options.size_least, options.size_most)
    return filters.filter_date_range(slim, options.since, options.until)


def _slim(files: DataFrame, options: Options) -> DataFrame:
    """The files that may be results, without their content."""
    return _allowed(files, options).select(F.col("id").alias("doc_id"), *ABOUT)


def search(index: Index | Texts, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """Top results of each query (query_id, query): words are prefixes and all required, with OR any, without those after NOT; name:, path:, ext:.
    A quoted phrase, and the parts of a word like foo-bar, are found in a row only, have a frequency of their own, and stand after NOT as well.

    Of a query with name: only that part is matched, with names. Columns: query_id, id, path, name, size, hash, file_type,
    updated_at, rank, match_type. A search that is made once can do without an index: give ``Texts``, which are looked at in their place.
    """
    options = options or Options()
    unindexed = isinstance(index, Texts)
    if unindexed and options.typos:
        raise ValueError("typos are found in the vocabulary of an index")
    parts = match.split_operators(filters.split_query_fields(queries.where(filters.valid_query(F.col("query")))), "remaining")
    named = F.col("name_query").isNotNull()
    # Which kinds of query there are, from the queries alone: the others need no branch of the plan.
    several = lambda c: F.exists(F.regexp_extract_all(c, F.lit(match.WORD), F.lit(0)), lambda w: F.size(tokenize(w)) > 1)
    phrases = F.coalesce(several(F.col("wanted")) | several(F.col("excluded")), F.lit(False)) | F.coalesce(several(F.col("name_query")), F.lit(False))
    kinds = parts.agg(F.count_if(named).alias("names"), F.count_if(~named).alias("others"), F.count_if(F.col("excluded") != "").alias("excluded"), F.count_if(phrases).alias("phrases")).first()

    def ranked_by(terms: DataFrame, asked: DataFrame, field: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """The files that match, with their ranks; asked: (query_id, is_any)."""
        if unindexed:
            any_of = {r["query_id"] for r in asked.where("is_any").collect()}
            return _allowed(rank.rank_texts(index, terms, any_of, field, excluded, [*ABOUT, "is_supported"]), options).drop("is_supported")
        number = terms.groupBy("query_id").agg(F.count_distinct("nr").alias("wanted")).join(asked, "query_id")
        return rank.rank_hits(index.hits(terms, bool(kinds["phrases"]), options.typos, field), number, index.stats)

    content = parts.where(~named & (F.col("wanted") != ""))
    excluded = match.query_terms(content.where("excluded <> ''"), "excluded", index.stems) if kinds["excluded"] else None
    if kinds["others"] or not unindexed:
        ranked = ranked_by(match.query_terms(content, "wanted", index.stems), content.select("query_id", "is_any"), excluded=excluded).withColumn("match_type", F.lit("content"))
    if excluded is not None and not unindexed:
        worse = index.hits(excluded, bool(kinds["phrases"]))
        ranked = ranked.join(worse.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    if kinds["names"]:
        names = parts.where(named)
        by_name = ranked_by(match.query_terms(names, "name_query", index.stems), names.select("query_id", F.lit(False).alias("is_any")), "name")
        by_name = by_name.withColumn("match_type", F.lit("filename"))
        ranked = ranked.unionByName(by_name) if kinds["others"] else by_name
    hits = ranked if unindexed else ranked.join(_slim(index.files, options), "doc_id")
    hits = hits.join(parts.select("query_id", "path_query", "ext_filters"), "query_id")
    hits = hits.where(F.col("path_query").isNull() | F.contains(F.lower("path"), F.lower("path_query")))
    kind = F.col("file_type") if options.ext_match == "file_type" else F.substr(extension(F.col("path")), F.lit(2))
    hits = hits.where((F.size("ext_filters") == 0) | F.array_contains("ext_filters", kind))
    whole = unindexed and options.k > rank.TOP and options.k >= index.files.count()  # then no query has more results
    top = (hits if whole else rank.top_k_per_query(hits, options.k)).withColumnRenamed("doc_id", "id")
    top = top.select("query_id", "id", "path", "name", "size", "hash", "file_type", "updated_at", "rank", "match_type")
    return results.dedup_by_hash(top) if options.dedup else top


def search_with_regex(index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """``search``, where a query may begin with a regular expression, /re/ words: of what its words find, the files whose path or
    content matches in any case. Nothing for a pattern that cannot be read, or without words.

    The patterns are collected to be checked, as queries are typed by users; contents are read for top results alone.
    """
    head = r"(?s)^/(.+?)/\s*"
    parts = queries.withColumns({"pattern": F.regexp_extract("query", head, 1), "query": F.regexp_replace("query", head, "")})
    typed = [r["pattern"] for r in parts.where("pattern <> ''").select("pattern").distinct().collect()]
    bad = [p for p in typed if not filters.valid_pattern(queries.sparkSession, p)]
    found = search(index, parts.where(~F.col("pattern").isin(bad)), options)
    patterns = parts.where("pattern <> ''").select("query_id", F.concat(F.lit("(?i)"), "pattern").alias("pattern"))
    plain = found.join(patterns, "query_id", "left_anti")
    held = with_content(found.join(patterns, "query_id"), index.files).where(F.regexp_like("path", F.col("pattern")) | F.regexp_like("content", F.col("pattern")))
    return plain.unionByName(held.select(*plain.columns))


def search_by_filename(index: Index | Texts, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """Top results whose name holds all words of the query."""
    return search(index, queries.withColumn("query", F.concat(F.lit('name:"'), F.replace("query", F.lit('"'), F.lit("")), F.lit('"'))), options)


def search_document_as_query(index: Index, documents: DataFrame, options: Options | None = None) -> DataFrame:
    """(query_id, id, n_tokens): files that hold all words of each given text, the shortest first."""
    options = options or Options()
    words = match.document_words(documents, index.vocabulary)
    found = match.match_document(words, index.alive(index.postings_of(words))).join(_slim(index.files, options).select("doc_id"), "doc_id").join(index.stats, "doc_id")
    top = rank.top_k_per_query(found, options.k, [F.col("n_tokens"), F.col("doc_id")])
    return top.select("query_id", F.col("doc_id").alias("id"), "n_tokens")


def run_saved_searches(index: Index, saved: DataFrame, options: Options | None = None) -> DataFrame:
    """Results of each saved query under its name. saved: (query_id, name, query)."""
    found = search(index, saved.select("query_id", "query"), options)
    return found.join(saved.select("query_id", F.col("name").alias("saved_name")), "query_id")


def with_content(top: DataFrame, files: DataFrame) -> DataFrame:
    """Top results with the content of their files; the last step, on few rows.

    Results are written and, where their bytes allow it, sent to the files: contents stay where they are read. Of more results, both sides are shuffled by file.
    """
    met = files.select("id", "content").join(sent(top, "top"), "id")
    return met.select("id", *[c for c in top.columns if c != "id"], "content")


def keywords(queries: DataFrame) -> DataFrame:
    """(query_id, keywords): what snippets are to show of each query: its words and phrases in their order, without operators, quotes, stars, fields and what stands after NOT.
    Of a query with name: that part's words."""
    parts = match.split_operators(filters.split_query_fields(queries), "remaining")
    asked = F.coalesce("name_query", "wanted")
    words = F.filter(F.regexp_extract_all(F.trim(asked), F.lit(match.WORD), F.lit(0)), lambda w: ~F.upper(w).isin("AND", "OR"))
    return parts.select("query_id", F.filter(F.transform(words, lambda w: F.regexp_replace(w, r'^"|"?\*?$', "")), lambda w: w != "").alias("keywords"))


def results_job(index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """From queries to what people read of their results: (query_id, nr, ..., snippet), the columns of ``search`` with the place of a result among its query's and a
    snippet around the first keyword that its content holds, null where it holds none as it is written.

    Matching, ranking, the cut to the top results and (``Options.dedup``) the removal of repeated files see no content; each file's content is then read once, in its
    place, for all queries that found it, and leaves as a snippet. A query without results has no rows. For documents see ``writers.export_by_query``.
    """
    found = search(index, queries, options)
    nr = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))
    shown = with_content(found.withColumn("nr", nr).join(keywords(queries), "query_id"), index.files)
    return shown.select("query_id", "nr", *[c for c in found.columns if c != "query_id"], snippet_of(F.col("content"), F.col("keywords")).alias("snippet"))
