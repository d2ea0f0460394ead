"""Text for people: snippets, highlights, quote cards, sizes, escapes; and values out of JSON, CSV and XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = "[。！？；\\n.?!]"
BEFORE, AFTER = 40, 60
QUOTE_LEAST, QUOTE_MOST = 100, 200
#: Characters beside an occurrence in which its quote is looked for first, more than QUOTE_MOST; occurrences of a line that are worked on together.
NEAR, RUN = 2 * QUOTE_MOST, 256


def regex_escape(text: Column) -> Column:
    """Backslashes before the characters that mean something in a regular expression."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _any_case(text: Column) -> Column:
    return F.concat(F.lit("(?iu)("), regex_escape(text), F.lit(")"))


def _replace(text: Column, pattern: Column, replacement: Column) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def html_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def csv_escape(text: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_size(size: Column) -> Column:
    """'0 B', '1.5 KB', up to TB, with two decimals at most; '-' for null and negative sizes."""
    out = F.lit("-")
    scaled = lambda unit: F.regexp_replace(F.format_string("%.2f", F.round(size.cast("double") / float(1024**unit), 2)), r"\.?0+$", "")
    known = F.when(size == 0, F.lit("0 B")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        known = known.when(size < 1024 ** (k + 1), F.concat(scaled(k), F.lit(f" {unit}")))
    return F.when(size.isNull() | (size < 0), out).otherwise(known.otherwise(F.concat(scaled(4), F.lit(" TB"))))


def highlight(text: Column, query: Column, before: str = "**", after: str | None = None) -> Column:
    """Every occurrence of query in any case between markers; the text itself for an empty query."""
    after = before if after is None else after
    quote = lambda m: m.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(F.coalesce(query, F.lit("")) == "", text).otherwise(_replace(text, _any_case(query), F.lit(f"{quote(before)}$1{quote(after)}")))


def highlight_words(text: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Any word of a query marked in a text; quotes and the words AND, OR, NOT of the query are left out."""
    plain = F.regexp_replace(F.regexp_replace(query, '"', " "), r"(?i)\b(AND|OR|NOT)\b", " ")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(words, regex_escape), "|"), F.lit(")"))
    return F.when(F.size(words) == 0, text).otherwise(_replace(text, pattern, F.lit(f"{before}$1{after}")))


def _around(content: Column, word: Column) -> Column:
    """What stands around the first occurrence of word in any case, every occurrence marked; null if there is none."""
    at = F.instr(F.lower(content), F.lower(word))
    start, end = F.greatest(at - 1 - BEFORE, F.lit(0)), F.least(F.length(content), at - 1 + F.length(word) + AFTER)
    cut = F.substring(content, start + 1, end - start)
    cut = F.replace(F.replace(cut, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), cut, F.when(end < F.length(content), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, highlight(cut, word, "<mark>", "</mark>"))


def snippet(content: Column, keywords: list[Column]) -> Column:
    """Around the first keyword, in the order given, that occurs: 40 characters before it, 60 after, marked; null if none does."""
    return F.coalesce(*[_around(content, w) for w in keywords])


def snippet_of(content: Column, keywords: Column) -> Column:
    """``snippet`` of an array of keywords, of which each row has its own; empty keywords are none."""
    low = F.lower(content)
    return _around(content, F.get(F.filter(keywords, lambda w: (w != "") & F.contains(low, F.lower(w))), 0))


def context_snippet(content: Column, query: Column, around: int = 50) -> Column:
    """So many characters on both sides of the first occurrence, '...' where it is cut; '' if there is none."""
    at = F.instr(F.lower(content), F.lower(query))
    start, end = F.greatest(at - 1 - around, F.lit(0)), F.least(F.length(content), at - 1 + F.length(query) + around)
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(content, start + 1, end - start), F.when(end < F.length(content), F.lit("...")).otherwise(F.lit("")))
    return F.when(at > 0, cut).otherwise(F.lit(""))


def first_match_line(content: Column, query: Column) -> Column:
    """The number, from 1, of the first line that holds query in any case; null if none does."""
    lines = F.split(F.lower(content), "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lower(query))), True)
    return F.nullif(at, F.lit(0))


def count_sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def sentence_start(before: Column, sentences: int = 2) -> Column:
    """The end of a text from its so-many-th last sentence end on; all of it if it has fewer."""
    tail = F.regexp_extract(before, f"(?s)^.*{SENTENCE_END}((?:[^。！？；\\n.?!]*{SENTENCE_END}){{{sentences - 1}}}[^。！？；\\n.?!]*)$", 1)
    return F.trim(F.when(count_sentences(before) < sentences, before).otherwise(tail))


def sentence_end(after: Column, sentences: int = 2) -> Column:
    """The start of a text up to its so-many-th sentence end; all of it if it has fewer."""
    head = F.regexp_extract(after, f"(?s)^((?:[^。！？；\\n.?!]*{SENTENCE_END}){{{sentences}}})", 1)
    return F.trim(F.when(count_sentences(after) < sentences, after).otherwise(head))


def quote_cards(files: DataFrame, keyword: Column, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, nr, before, keyword, after, line_number): every occurrence of keyword in each line, with a sentence or two around it.

    Occurrences in a line do not overlap. A side is its last (first) two sentences; if that is under 100 characters and the
    line has more, its last (first) one instead, or the whole side if that one is empty; then at most 200 characters.

    Nothing is worked out on a whole line for each of its occurrences: they are taken ``RUN`` at a time, with the text around them, and a side is looked for in the ``NEAR`` characters
    beside the keyword, which hold it if they hold two sentence ends or 200 characters of text.
    """
    lines = files.where(F.col(content_col).isNotNull() & (F.trim(keyword) != "")).select(F.col(id_col).alias("id"), keyword.alias("q"), F.posexplode(F.split(content_col, "\n", -1)).alias("line", "text"))
    lines = lines.where(F.contains(F.lower("text"), F.lower("q")))
    # The pieces between occurrences give their places: each piece and each keyword before it.
    pieces = F.split(F.lower("text"), F.concat(F.lit("(?u)"), regex_escape(F.lower("q"))), -1)
    n = F.length("q")
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda g: F.length(g) + n)  # from the end of an occurrence to the end of the next one
    lines = lines.withColumn("gaps", gaps)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("gaps") - 1) / RUN).cast("int")), lambda b: F.slice("gaps", b * RUN + 1, F.lit(RUN)))
    lines = lines.withColumn("runs", runs)
    running = lambda values, first: F.aggregate(values, F.array(first), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + g)))
    starts = running(F.transform("runs", lambda r: F.aggregate(r, F.lit(0), lambda a, g: a + g)), F.lit(0))
    # Outer, as rows would else be filtered by the arrays' sizes first, for which these would be made twice.
    found = lines.withColumn("starts", starts).select("id", "q", "line", "text", "starts", F.posexplode_outer("runs").alias("run", "gaps"))
    # The ends of a run's occurrences, less the keyword: their places in the line, from 0.
    found = found.withColumn("ats", F.transform(F.slice(running(F.col("gaps"), F.get("starts", F.col("run"))), F.lit(2), F.size("gaps")), lambda end: end - n)).drop("starts", "gaps")
    low = F.greatest(F.element_at("ats", 1) - NEAR, F.lit(0))
    found = found.withColumns({"low": low, "size": F.length("text"), "part": F.substring("text", low + 1, F.element_at("ats", -1) + n + NEAR - low)})

    def near(at: Column, k: Column) -> Column:
        here = at - F.col("low")
        left, right = F.substring("part", F.greatest(here - NEAR, F.lit(0)) + 1, F.least(here, F.lit(NEAR))), F.substring("part", here + n + 1, F.lit(NEAR))
        return F.struct((F.col("run") * RUN + k + 1).alias("k"), at.alias("at"), F.substring("part", here + 1, n).alias("keyword"), left.alias("l"), right.alias("r"))

    def enough(side: Column) -> Column:
        return (F.length(F.trim(side)) >= QUOTE_MOST) | (F.size(F.split(side, SENTENCE_END, 3)) == 3)

    def sides(o: Column) -> Column:
        left = F.when((o["at"] <= NEAR) | enough(o["l"]), o["l"]).otherwise(F.substring("text", 1, o["at"]))
        right = F.when((o["at"] + n + NEAR >= F.col("size")) | enough(o["r"]), o["r"]).otherwise(F.substr("text", o["at"] + n + 1))
        return F.struct(o["k"].alias("k"), o["keyword"].alias("keyword"), left.alias("l"), right.alias("r"))

    def cut(o: Column) -> Column:
        """Lengths of each side's pieces between sentence ends, from the keyword on."""
        ls, rs = F.transform(F.split(F.reverse(o["l"]), SENTENCE_END, 3), F.length), F.transform(F.split(o["r"], SENTENCE_END, 3), F.length)
        return F.struct(*[o[c].alias(c) for c in ("k", "keyword", "l", "r")], ls.alias("ls"), rs.alias("rs"))

    end = lambda side, n: F.substring(side, -n, n)  # noqa: E731  (F.right has its argument three times)

    def one_and_two(o: Column) -> Column:
        (l, ls), (r, rs) = (o["l"], o["ls"]), (o["r"], o["rs"])
        two = F.when(F.size(ls) == 3, end(l, F.get(ls, 0) + F.get(ls, 1) + 1)).otherwise(l), F.when(F.size(rs) == 3, F.left(r, F.get(rs, 0) + F.get(rs, 1) + 2)).otherwise(r)
        one = F.when(F.size(ls) > 1, end(l, F.get(ls, 0))).otherwise(l), F.when(F.size(rs) > 1, F.left(r, F.get(rs, 0) + 1)).otherwise(r)
        return F.struct(*[o[c].alias(c) for c in ("k", "keyword", "l", "r")], *[F.trim(c).alias(f) for c, f in zip((*two, *one), ("l2", "r2", "l1", "r1"))])

    def card(o: Column) -> Column:
        def side(whole: Column, two: Column, one: Column) -> Column:
            short = (F.length(two) < QUOTE_LEAST) & (F.length(whole) > F.length(two))
            return F.when(short, F.coalesce(F.nullif(one, F.lit("")), whole)).otherwise(two)

        before, after = end(side(o["l"], o["l2"], o["l1"]), F.lit(QUOTE_MOST)), F.substring(side(o["r"], o["r2"], o["r1"]), 1, QUOTE_MOST)
        return F.struct(o["k"].alias("k"), before.alias("before"), o["keyword"].alias("keyword"), after.alias("after"))

    # One step for each, so that no step's value is worked out again where the next one uses it twice.
    cards = F.transform("ats", near)
    for step in (sides, cut, one_and_two, card):
        cards = F.transform(cards, step)
    cards = F.filter(cards, lambda o: (F.length(o["before"]) > 0) | (F.length(o["after"]) > 0))
    return found.select("id", "line", F.explode_outer(cards).alias("o")).where("o IS NOT NULL").select("id", "line", "o.*", (F.col("line") + 1).alias("line_number"))


def json_values(text: Column) -> Column:
    return F.map_values(F.from_json(text, "map<string,string>"))


def csv_cells(text: Column) -> Column:
    return F.flatten(F.transform(F.split(text, "\r?\n"), lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c))))


def xml_items(text: Column, element: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)<{element}(?:\\s[^>]*)?>(.*?)</{element}>"), 1)


def subsequence_match(query: Column, target: Column) -> Column:
    """All characters of query occur in target in their order."""
    pattern = F.array_join(F.transform(F.filter(F.split(F.lower(query), ""), lambda c: c != ""), regex_escape), ".*")
    return F.rlike(F.lower(target), F.concat(F.lit("(?s)"), pattern))


def fuzzy_score_simple(query: Column, target: Column) -> Column:
    """100 equal, 80 contained, 50 all characters occur, else the share that do times 30, rounded half up."""
    q, t = F.lower(query), F.lower(target)
    chars = F.filter(F.split(q, ""), lambda c: c != "")
    hits = F.size(F.filter(chars, lambda c: F.contains(t, c)))
    share = F.when(F.size(chars) == 0, F.lit(0)).otherwise(F.floor(hits * 30.0 / F.size(chars) + 0.5))
    return F.when(q == t, 100).when(F.contains(t, q), 80).when(hits == F.size(chars), 50).otherwise(share).cast("int")
