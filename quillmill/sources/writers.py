"""The index and the exports of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill import schemas
from quillmill.functions.text import csv_escape, format_size, html_escape
from quillmill.operators.index import term_stats
from quillmill.operators.rank import numbered
from quillmill.sources.written import written

CSV_HEADER = "\ufefffile name,path,type,size,modified,match type"


#: Postings of a part, as many parts as that makes within MOST_PARTS, and terms drawn to place the bounds between them.
PART_ROWS, MOST_PARTS, DRAWN = 500_000, 2048, 50_000
#: Files, about, whose postings place the bounds; of fewer all do.
DRAWN_FILES = 4000


def drawn_bounds(files: DataFrame, postings_of: Callable[[DataFrame], DataFrame], part_rows: int = PART_ROWS, id_col: str = "id") -> list[str]:
    """``bounds_of`` an index of files that is yet to be written, by the postings of some ``DRAWN_FILES`` files, the same whenever they are drawn: bounds only say in which folder a
    posting stands, so it is enough that parts have about the same size."""
    every = max(1, files.count() // DRAWN_FILES)
    drawn = files.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0) if every > 1 else files
    return bounds_of(written(term_stats(postings_of(drawn)), "drawn"), max(1, part_rows // every))


def bounds_of(vocabulary: DataFrame, part_rows: int = PART_ROWS) -> list[str]:
    """The first terms of all parts but the first, in order, so that parts have about equally many postings.

    Terms are drawn with a probability in proportion to their postings, some ``DRAWN`` at most; one with more than a drawn term's share counts as several.
    """
    total = vocabulary.agg(F.sum("n_docs")).first()[0] or 0
    parts = min(MOST_PARTS, total // part_rows + 1)
    if parts < 2:
        return []
    share = max(1.0, total / DRAWN)
    weight = F.floor(F.col("n_docs") / share + (F.pmod(F.xxhash64("term"), F.lit(1 << 20)) / float(1 << 20)))
    drawn = sorted((r["term"], r["w"]) for r in vocabulary.select("term", weight.alias("w")).where("w > 0").collect())
    bounds, so_far, whole = [], 0, sum(w for _, w in drawn)
    for term, w in drawn:
        if so_far >= whole * (len(bounds) + 1) / parts:
            bounds.append(term)
            while so_far + w >= whole * (len(bounds) + 1) / parts:  # a term of several shares ends several parts
                bounds.append(term)
        so_far += w
    return sorted({*bounds})


def part_of(term: Column, bounds: list[str]) -> Column:
    """How many of the bounds are not behind the term: its part, by a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) <= term), at + s).otherwise(at))


def write_index(files: DataFrame | None, postings: DataFrame, doc_stats: DataFrame, folder: str, part_rows: int = PART_ROWS, bounds: list[str] | None = None) -> None:
    """Parquet tables: postings, the vocabulary with its counts, the files' lengths, and the bounds of the postings' parts.

    Postings stand in folders by ranges of the alphabet with about ``part_rows`` rows each, so that a search opens the parts its words lie in, a prefix's words beside each other; they are
    sorted, so that a term's rows are read from few row groups, and rebalanced, so that the part of a term that most files hold is cut over several tasks.
    Give no files where they are kept elsewhere: their content is not written twice then. ``bounds``: those of an index that this one is to be like, or as ``drawn_bounds`` gives them; without them all postings are worked out once more.
    """
    spark = postings.sparkSession
    if files is not None:
        files.write.mode("overwrite").parquet(f"{folder}/files")
    if bounds is None:
        bounds = bounds_of(written(term_stats(postings), "vocabulary"), part_rows)
    spark.createDataFrame([(b,) for b in bounds], "bound string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/bounds")
    parted = postings.withColumn("part", part_of(F.col("term"), bounds).cast("int"))
    parted.hint("rebalance", "part").sortWithinPartitions("part", "term", "doc_id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    # Out of the written postings, so that no text is read for it.
    term_stats(spark.read.schema(schemas.POSTINGS_IN_PARTS).parquet(f"{folder}/postings")).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    doc_stats.write.mode("overwrite").parquet(f"{folder}/doc_stats")


def _text(c: Column, missing: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def _when(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def _csv_value() -> Column:
    cells = [csv_escape(c) for c in (F.col("name"), F.col("path"), _text(F.col("file_type")), format_size(F.col("size")), _when(F.col("updated_at")), _text(F.col("match_type")))]
    return F.concat_ws(",", *cells)


def _html_value(snippet: str | None) -> Column:
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    known = [html_escape(F.col("path")), html_escape(_text(F.col("file_type"))), format_size(F.col("size")), _when(F.col("updated_at")), html_escape(_text(F.col("match_type")))]
    about = F.concat(*[part("span", c) for c in known])
    below = F.coalesce(part("blockquote", F.col(snippet)), F.lit("")) if snippet else F.lit("")
    return F.concat(part("dt", html_escape(F.col("name"))), part("dd", F.concat(about, below)))


def _txt_value(nr: Column) -> Column:
    third = F.concat(F.lit("type: "), _text(F.col("file_type"), "-"), F.lit(" | size: "), format_size(F.col("size")), F.lit(" | modified: "), _when(F.col("updated_at")), F.lit(" | match: "), _text(F.col("match_type"), "-"))
    return F.concat(F.lit("["), nr, F.lit("] "), F.col("name"), F.lit("\npath: "), F.col("path"), F.lit("\n"), third)


def csv_lines(results: DataFrame) -> DataFrame:
    """One CSV line for each result: name, path, type, size, modified, match type."""
    return results.select(_csv_value().alias("value"))


def html_rows(results: DataFrame, snippet: str | None = None) -> DataFrame:
    """An item of a definition list for each result: its name, what is known of it, and its snippet if there is one."""
    return results.select(_html_value(snippet).alias("value"))


def _entries(results: DataFrame, order: list[Column]) -> DataFrame:
    placed = numbered(results.orderBy(*order).select(_txt_value(F.lit("")).alias("value")), "__nr")
    return placed.select("__nr", F.concat(F.lit("["), F.col("__nr"), F.substr("value", F.lit(2))).alias("value"))


def txt_entries(results: DataFrame, order: list[Column]) -> DataFrame:
    """Numbered entries of three lines each, by the order given; numbers are dealt without bringing the results together."""
    return _entries(results, order).select("value")


def quote_entries(quotes: DataFrame, markdown: bool = True) -> DataFrame:
    """Quote cards as Markdown quotations or as text."""
    if markdown:
        value = F.concat(F.lit("## Quote "), F.col("nr"), F.lit("\n**Line**: "), F.col("line_number"), F.lit("\n\n> "), "before", F.lit("**"), "keyword", F.lit("**"), "after", F.lit("\n"))
    else:
        value = F.concat(F.lit("[Quote "), F.col("nr"), F.lit("] line "), F.col("line_number"), F.lit("\n..."), "before", "keyword", "after", F.lit("...\n"))
    return quotes.select(value.alias("value"))


def _html_head(title: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="UTF-8"><title>'), html_escape(title), F.lit("</title></head><body>\n<dl>"))


_HTML_FOOT = "</dl>\n</body></html>"
_RULE = "\n" + "-" * 80


def export_csv(results: DataFrame, folder: str) -> None:
    """A file with byte-order mark, header and lines ended by CR LF. An export is one document, written by one task."""
    spark = results.sparkSession
    head = spark.createDataFrame([(CSV_HEADER,)], "value string")
    head.union(csv_lines(results)).coalesce(1).write.mode("overwrite").text(folder, lineSep="\r\n")


def export_html(results: DataFrame, folder: str, title: str = "", snippet: str | None = None) -> None:
    spark = results.sparkSession
    head = spark.range(1).select(_html_head(F.lit(title)).alias("value"))
    foot = spark.range(1).select(F.lit(_HTML_FOOT).alias("value"))
    head.union(html_rows(results, snippet)).union(foot).coalesce(1).write.mode("overwrite").text(folder)


def export_txt(results: DataFrame, folder: str, order: list[Column]) -> None:
    entries = _entries(results, order).repartition(1).sortWithinPartitions("__nr")
    entries.select(F.concat("value", F.lit(_RULE)).alias("value")).write.mode("overwrite").text(folder)


def export_quotes(quotes: DataFrame, folder: str, markdown: bool = True) -> None:
    quote_entries(quotes, markdown).coalesce(1).write.mode("overwrite").text(folder)


def export_by_query(results: DataFrame, folder: str, kind: str, order: list[Column], key: str = "query_id", title: Column | None = None, snippet: str | None = None) -> None:
    """A document (kind: csv, html or txt) for each query, in a folder of its own, ``key=<query>``, all written in parallel.

    Its lines are those of ``export_csv``, ``export_html`` (title: an expression of its rows) and ``export_txt``. A document is one file of one task, whose rows are a
    query's results: as many as the search keeps of a query at most. The head and the foot go with its first and last row, so a query without results has no document.
    """
    own = W.partitionBy(key)
    rows = results.withColumns({"__nr": F.row_number().over(own.orderBy(*order)), "__n": F.count(F.lit(1)).over(own)})
    if kind == "csv":
        line, head, foot, end = _csv_value(), F.lit(CSV_HEADER), None, "\r\n"
    elif kind == "html":
        line, head, foot, end = _html_value(snippet), _html_head(title if title is not None else F.lit("")), F.lit(_HTML_FOOT), "\n"
    elif kind == "txt":
        line, head, foot, end = F.concat(_txt_value(F.col("__nr")), F.lit(_RULE)), None, None, "\n"
    else:
        raise ValueError(f"no such kind of document: {kind}")
    if head is not None:
        line = F.concat(F.when(F.col("__nr") == 1, F.concat(head, F.lit(end))).otherwise(F.lit("")), line)
    if foot is not None:
        line = F.concat(line, F.when(F.col("__nr") == F.col("__n"), F.concat(F.lit(end), foot)).otherwise(F.lit("")))
    lines = rows.select(key, "__nr", line.alias("value"))
    lines.repartition(key).sortWithinPartitions(key, "__nr").drop("__nr").write.mode("overwrite").partitionBy(key).text(folder, lineSep=end)
