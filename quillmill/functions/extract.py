"""Plain text out of markup formats, as column expressions.

The order of the replacements and their patterns are fixed values: results depend on both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.paths import extension

SPACE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Fixed values.
HTML_STEPS = [
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&amp;", "&"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&#39;", "'"),
    (SPACE + "+", " "),
]
RTF_STEPS = [
    (r"(?i)\\[a-z]+\d*\s?", ""),
    (r"(?i)\\'[0-9a-f]{2}", ""),
    (r"\\[{}]", ""),
    (r"\\\n", "\n"),
    (r"\{\\[^}]*\\par\}", "\n"),
    (r"(?i)\\[a-z]+\s", " "),
    (r"\{([^}]*)\}", "$1"),
    (r"\\[^a-z{}\s][0-9]*", ""),
    (r"\n{3,}", "\n\n"),
]
MAIL_STEPS = [
    (r"--[^\r\n]+", "---"),
    (r"(?i)Content-Type:[^\r\n]+", ""),
    (r"(?i)Content-Transfer-Encoding:[^\r\n]+", ""),
    (r"(?m)---\s*$", "\n"),
    (r"=\r?\n", ""),
]
MAIL_HEADERS = (r"(?m)^[A-Za-z-]+:[^\r\n]+", "")
MAIL_MARKUP = [(r"(?is)<html[^>]*>.*?</html>", ""), (r"(?is)<head[^>]*>.*?</head>", "")]
MARKUP_STEPS = [(r"<[^>]+>", " "), (r"(?i)&nbsp;", " "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&amp;", "&")]


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments dropped, tags turned into spaces, six entities decoded, white space collapsed."""
    return F.trim(_apply(html, HTML_STEPS))


def _bodies(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), _trim), lambda t: t != "")


def svg_to_text(svg: Column) -> Column:
    """The title, then the text elements, then the tspans, joined by spaces."""
    has_title = F.regexp_like(svg, F.lit(r"(?i)<title[^>]*>[^<]+</title>"))
    title = F.when(has_title, F.array(_trim(F.regexp_extract(svg, r"(?i)<title[^>]*>([^<]*)</title>", 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(title, _bodies(F.regexp_replace(svg, "(?i)<svg[^>]*>", ""), r"(?i)<text[^>]*>([^<]*)</text>"), _bodies(svg, r"(?i)<tspan[^>]*>([^<]*)</tspan>")), " ")


def rtf_to_text(rtf: Column) -> Column:
    return _trim(_apply(rtf, RTF_STEPS))


def quoted_printable(text: Column) -> Column:
    """=XX turned into the character of that number."""
    pieces = F.split(text, "=(?=[0-9A-Fa-f]{2})", -1)
    decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "ISO-8859-1"), F.substr(p, F.lit(3)))))
    return F.array_join(decoded, "")


def _header(mail: Column, name: str) -> Column:
    pattern = rf"(?im)^{name}:[^\S\n]*(\S.*)?$"
    return F.when(F.regexp_like(mail, F.lit(pattern)), F.concat(F.lit(f"{name}: "), _trim(F.regexp_extract(mail, pattern, 1))))


def eml_to_text(mail: Column) -> Column:
    """Subject and sender lines, then the body after the first blank line without part headers and markup."""
    windows, unix = F.instr(mail, "\r\n\r\n"), F.instr(mail, "\n\n")
    start = F.when((windows > 0) & ((unix == 0) | (windows < unix)), windows + 4).when(unix > 0, unix + 2).otherwise(F.lit(1))
    body = _apply(F.substr(mail, start), MAIL_STEPS)
    body = F.regexp_replace(quoted_printable(body), *MAIL_HEADERS)
    body = _trim(F.regexp_replace(_apply(body, MAIL_MARKUP + MARKUP_STEPS), SPACE + "{2,}", " "))
    return F.concat_ws("\n", _header(mail, "Subject"), _header(mail, "From"), F.nullif(body, F.lit("")))


def _message_texts(message: Column) -> Column:
    at = F.instr(message, "\n\n")
    body = F.when(at > 0, F.substr(message, at + 2)).otherwise(message)
    body = F.regexp_replace(_apply(body, MARKUP_STEPS), *MAIL_HEADERS)
    body = _trim(F.regexp_replace(body, SPACE + "{2,}", " "))
    return F.array_compact(F.array(_header(message, "Subject"), F.nullif(body, F.lit(""))))


def _messages(mailbox: Column) -> Column:
    return F.filter(F.split(mailbox, "\nFrom ", -1), lambda m: _trim(m) != "")


def mbox_to_text(mailbox: Column) -> Column:
    """Each message's subject and body, joined by lines of three dashes."""
    return F.array_join(F.flatten(F.transform(_messages(mailbox), _message_texts)), "\n---\n")


def mbox_split(mailboxes: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, nr, text): one row for each message of each mailbox."""
    rows = mailboxes.select(F.col(id_col).alias("id"), F.posexplode(_messages(F.col(text_col))).alias("nr", "message"))
    return rows.select("id", "nr", F.array_join(_message_texts(F.col("message")), "\n---\n").alias("text"))


def fb2_to_text(book: Column) -> Column:
    """The text of the elements of the body, then the names of the images."""
    body = F.regexp_extract(book, r"(?is)<body[^>]*>(.*)</body>", 1)
    images = F.transform(F.regexp_extract_all(book, F.lit(r'<binary[^>]+id="([^"]+)"'), 1), lambda n: F.concat(F.lit("[Image: "), n, F.lit("]")))
    return F.when(F.regexp_like(book, F.lit(r"(?is)<body[^>]*>.*</body>")), F.array_join(F.concat(_bodies(body, r"<[^>]+>([^<]*)</[^>]+>"), images), "\n")).otherwise(F.lit(""))


# Which extractor reads which extensions; helper formats are read from bytes.
PLAIN = "txt md markdown mdown json xml csv yaml yml log ini cfg conf srt vtt nfo rst tex msg".split()
BY_EXTENSION = {"html htm": html_to_text, "svg": svg_to_text, "rtf": rtf_to_text, "eml": eml_to_text, "mbox": mbox_to_text, "fb2": fb2_to_text}


def extract_text(path: Column, text: Column) -> Column:
    """The text of a file by its extension; '' for an unknown one and for null text."""
    ext = F.substr(extension(path), F.lit(2))
    out = F.when(ext.isin(*PLAIN), text)
    for names, function in BY_EXTENSION.items():
        out = out.when(ext.isin(*names.split()), function(text))
    return F.coalesce(out, F.lit(""))
