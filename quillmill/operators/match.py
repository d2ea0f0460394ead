"""Which files match which queries: many queries at once, against the postings.

A query's expressions are rows (query_id, nr, p, n, term, kind), one for each token, kind being 'prefix' or 'exact'. Every operator gives
(query_id, doc_id) rows without repeats. Postings are only joined with the terms that the queries name. For searches that are made once, ``Texts`` can stand in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import unindexed
from quillmill.operators.fuzzy import fuzzy_expand_terms
from quillmill.operators.index import FIELDS, stem_terms, tokenize
from quillmill.operators.unindexed import Texts
from quillmill.sources.written import written

#: A quoted phrase, or what stands between spaces.
WORD = r'"[^"]+"\*?|\S+'
#: An even number of quotes follows: what stands before is not inside of quotes.
_OUTSIDE = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def query_terms(queries: DataFrame, query_col: str = "query", stems: bool = False) -> DataFrame:
    """(query_id, nr, p, n, term, kind) of the words of queries: a bare word is a prefix, a starred or quoted one exact; AND and OR are left out.

    A word of several tokens (foo-bar) and a quoted phrase are one expression of n tokens in a row, p being the place of each; of a bare word's only the last is a prefix.
    A quoted word is never an operator. For an index of stems, give ``stems``: a word then stands for its stem.
    """
    words = F.filter(F.regexp_extract_all(F.trim(query_col), F.lit(WORD), F.lit(0)), lambda w: ~F.upper(w).isin("AND", "OR"))
    rows = queries.select("query_id", F.posexplode(words).alias("nr", "word"))
    fixed = F.endswith("word", F.lit("*")) | F.startswith("word", F.lit('"'))
    rows = rows.select("query_id", F.col("nr").cast("long").alias("nr"), fixed.alias("fixed"), tokenize(F.col("word")).alias("ts"))
    rows = rows.select("query_id", "nr", "fixed", F.size("ts").alias("n"), F.posexplode("ts").alias("p", "term"))
    terms = rows.select("query_id", "nr", "p", "n", "term", F.when(F.col("fixed") | (F.col("p") < F.col("n") - 1), "exact").otherwise("prefix").alias("kind"))
    return terms.join(stem_terms(terms), "term").select("query_id", "nr", "p", "n", F.col("stem").alias("term"), "kind") if stems else terms


def expand_terms(terms: DataFrame, vocabulary: DataFrame, typos: int = 0) -> DataFrame:
    """(query_id, nr, p, n, term): each token of an expression with every term of the vocabulary that it stands for, and with ``typos`` those within so many edits.

    vocabulary: the index's (a term once), or postings. Prefixes are matched with the vocabulary, not the postings; they are joined on their first two characters, so that
    the comparison is an equi-join whatever the number of queries.
    """
    key = ["query_id", "nr", "p", "n"]
    exact = terms.where("kind = 'exact'").select(*key, "term")
    heads = terms.where("kind = 'prefix'").select(*key, F.col("term").alias("head"))
    words = vocabulary.select("term").distinct() if "doc_id" in vocabulary.columns else vocabulary.select("term")
    two = lambda c: F.substring(c, 1, 2)
    long = heads.where(F.length("head") >= 2).join(words, two(F.col("head")) == two(F.col("term"))).where(F.startswith("term", F.col("head")))
    short = heads.where(F.length("head") == 1).join(words, F.col("head") == F.substring("term", 1, 1))
    out = exact.unionByName(long.select(*key, "term")).unionByName(short.select(*key, "term"))
    if typos:
        near = fuzzy_expand_terms(terms, words, typos).withColumnRenamed("term", "near")
        out = out.unionByName(terms.join(near, F.col("term") == F.col("wanted")).select(*key, F.col("near").alias("term")))
    return out.distinct()


def _in_a_row(found: Column, n: Column) -> Column:
    """How often the n tokens of an expression stand in a row in a field. found: an array of (field, p, positions).

    A token at place p of the expression, found at place q, votes for a start at q - p; a start that every token votes for counts. The places of
    one token's terms are joined, as a prefix stands for several terms.
    """

    def starts(field: str, p: Column) -> Column:
        own = F.filter(found, lambda x: (x["field"] == field) & (x["p"] == p))
        return F.array_distinct(F.flatten(F.transform(own, lambda x: F.transform(x["positions"], lambda q: q - p))))

    def times(field: str) -> Column:
        return F.size(F.aggregate(F.sequence(F.lit(1), n - 1), starts(field, F.lit(0)), lambda so_far, p: F.array_intersect(so_far, starts(field, p))))

    return sum((times(f) for f in FIELDS[1:]), times(FIELDS[0]))


def term_hits(expanded: DataFrame, postings: DataFrame, phrases: bool = True, gone: DataFrame | None = None) -> DataFrame:
    """(query_id, nr, doc_id, f): how often a file holds each expression, over all terms it stands for: the one join with the postings
    that matching and ranking share. An expression of several tokens counts where they stand in a row in one field.

    ``phrases`` false: no expression has several tokens, and positions are not read. A file's row of a phrase gathers what it has of the phrase's own tokens.
    gone: (doc_id, gone), for postings of several segments: those of a file in segments below its ``gone`` do not count.
    """
    key = ["query_id", "nr", "doc_id"]
    columns = ["term", "doc_id", "tf", *(["field", "positions"] if phrases else []), *(["segment"] if gone is not None else [])]
    joined = expanded.join(postings.select(*columns), "term")
    if gone is not None:
        joined = joined.join(gone, (joined["doc_id"] == gone["doc_id"]) & (joined["segment"] < gone["gone"]), "left_anti")
    if not phrases:
        return joined.groupBy(*key).agg(F.sum("tf").cast("double").alias("f"))
    many = F.col("n") > 1
    held = joined.groupBy(*key, "n").agg(F.sum(F.when(~many, F.col("tf"))).alias("one"), F.collect_list(F.when(many, F.struct("field", "p", "positions"))).alias("found"))
    # Without every token of the phrase there is nothing to intersect.
    whole = F.when(F.size(F.array_distinct(F.transform("found", lambda x: x["p"]))) == F.col("n"), _in_a_row(F.col("found"), F.col("n")))
    return held.select(*key, F.when(many, whole).otherwise(F.col("one")).cast("double").alias("f")).where("f > 0")


def _hits(terms: DataFrame, postings: DataFrame, field: str | None) -> DataFrame:
    """(query_id, nr, doc_id) without repeats."""
    if field:
        postings = postings.where(F.col("field") == field)
    return term_hits(expand_terms(terms, postings), postings).select("query_id", "nr", "doc_id")


def match_all(terms: DataFrame, postings: DataFrame | Texts, field: str | None = None) -> DataFrame:
    """Files that hold every expression of the query."""
    if isinstance(postings, Texts):
        return unindexed.match(terms, postings, field)
    wanted = terms.groupBy("query_id").agg(F.count_distinct("nr").alias("wanted"))
    counted = _hits(terms, postings, field).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(wanted, "query_id").where("n = wanted").select("query_id", "doc_id")


def match_any(terms: DataFrame, postings: DataFrame | Texts, field: str | None = None) -> DataFrame:
    """Files that hold any expression of the query."""
    if isinstance(postings, Texts):
        return unindexed.match(terms, postings, field, any_of=True)
    return _hits(terms, postings, field).select("query_id", "doc_id").distinct()


def match_not(matched: DataFrame, excluded_terms: DataFrame, postings: DataFrame, field: str | None = None) -> DataFrame:
    """Matched files without those that hold an excluded expression of the same query."""
    return matched.join(match_any(excluded_terms, postings, field), ["query_id", "doc_id"], "left_anti")


def match_prefix(terms: DataFrame, postings: DataFrame) -> DataFrame:
    return match_all(terms.withColumn("kind", F.lit("prefix")), postings)


def match_exact_term(terms: DataFrame, postings: DataFrame) -> DataFrame:
    return match_all(terms.withColumn("kind", F.lit("exact")), postings)


def match_field(terms: DataFrame, postings: DataFrame | Texts, field: str = "name") -> DataFrame:
    return match_all(terms, postings, field)


def match_all_but(terms: DataFrame, excluded_terms: DataFrame, postings: DataFrame | Texts, field: str | None = None) -> DataFrame:
    """``match_all`` and ``match_not`` in one: of texts, each is looked at once for both."""
    if isinstance(postings, Texts):
        return unindexed.match(terms, postings, field, excluded=excluded_terms)
    return match_not(match_all(terms, postings, field), excluded_terms, postings, field)


def match_phrase(phrases: DataFrame, postings: DataFrame | Texts, phrase_col: str = "phrase") -> DataFrame:
    """Files with the tokens of a phrase in a row in one field.

    A token at place p of a phrase, found at place q, votes for a start at q - p; a start with a vote of every token is a match.
    """
    tokens = phrases.select("query_id", F.posexplode(tokenize(F.col(phrase_col))).alias("p", "term"), F.size(tokenize(F.col(phrase_col))).alias("n"))
    if isinstance(postings, Texts):
        return unindexed.match(tokens.withColumns({"nr": F.lit(0), "kind": F.lit("exact")}), postings)
    found = tokens.join(postings.select("term", "doc_id", "field", "positions"), "term")
    votes = found.select("query_id", "doc_id", "field", "n", "p", F.explode("positions").alias("q")).withColumn("start", F.col("q") - F.col("p"))
    return votes.groupBy("query_id", "doc_id", "field", "start", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n").select("query_id", "doc_id").distinct()


def document_words(documents: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, term, n_docs, wanted): the different words of whole texts, of those whose words are all in the vocabulary: the others match nothing."""
    words = documents.select("query_id", F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("term"))
    wanted = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    met = words.join(vocabulary.select("term", "n_docs").where("n_docs > 0"), "term")
    known = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("known")).join(wanted, "query_id").where("known = wanted").select("query_id", "wanted")
    return met.join(known, "query_id")


#: Candidates of document queries whose ids are sent to the postings; more are joined.
SENT = 1_000_000


def match_document(words: DataFrame, postings: DataFrame) -> DataFrame:
    """A whole text as query: (query_id, doc_id) of the files that hold all of its different words.

    Relational division, the rarest word first: its files are the candidates, and the other words' postings are read for candidates alone, before anything is
    shuffled. So what is shuffled is bound by the postings of each text's rarest word and its candidates' own words, not by the postings of all words.
    words: as ``document_words`` gives them.
    """
    rarest = words.groupBy("query_id").agg(F.min(F.struct("n_docs", "term")).alias("r")).select("query_id", F.col("r.term").alias("term"))
    candidates = written(rarest.join(postings.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct(), "candidates")
    ids = candidates.select("doc_id").distinct()
    held = postings.select("term", "doc_id").join(F.broadcast(ids) if candidates.count() <= SENT else ids, "doc_id", "left_semi").distinct()
    hits = words.join(held, "term").join(candidates, ["query_id", "doc_id"], "left_semi")
    return hits.groupBy("query_id", "doc_id", "wanted").agg(F.count(F.lit(1)).alias("n")).where("n = wanted").select("query_id", "doc_id")


def split_operators(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """wanted, excluded and any: the words and quoted phrases of a query by the operators AND, OR and NOT before them. Operators inside of quotes are words;
    a quote without its like is none."""
    q = F.trim(F.col(query_col))
    odd = F.length(F.regexp_replace(q, '[^"]', "")) % 2 == 1
    q = F.when(odd, F.trim(F.regexp_replace(q, '"([^"]*)$', " $1"))).otherwise(q)
    not_ = rf'(?i)(?:^|\s)NOT\s+("[^"]+"\*?|[^\s"]+){_OUTSIDE}'
    excluded = F.regexp_extract_all(q, F.lit(not_), F.lit(1))
    rest = F.regexp_replace(q, not_, " ")
    is_any: Column = F.regexp_like(rest, F.lit(rf"(?i)\sOR\s{_OUTSIDE}"))
    return queries.withColumns({"wanted": F.trim(F.regexp_replace(rest, rf"(?i)\s(OR|AND)(?=\s){_OUTSIDE}", " ")), "excluded": F.array_join(excluded, " "), "is_any": is_any})
