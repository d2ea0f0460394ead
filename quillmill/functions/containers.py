"""Text out of zipped files: XML families, and archives with their members. Spark has no reader for these; stdlib zipfile runs in tasks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.extract import extract_text

MEMBER_MOST = 50 * 1024 * 1024
DEPTH_MOST = 3
_ODF = (r"content\.xml", r"<text:[pwhs][^>]*>([^<]*)</text:[pwhs]>", "\n")
# Which members of a family hold text, what encloses it, and what joins a member's pieces.
FAMILIES = {
    "pptx": (r"ppt/slides/slide(\d+)\.xml", r"<a:t[^>]*>([^<]*)</a:t>", " "),
    "odt": _ODF,
    "ods": _ODF,
    "odp": _ODF,
    "xps": (r".*\.fpage", (r'(?i)<Glyphs[^>]*UnicodeString="([^"]*)"[^>]*>', r"(?i)<Run[^>]*>([^<]*)</Run>"), "\n"),
    "vsdx": (r".*\.xml", r"(?i)<a:t>([^<]*)</a:t>", " | "),
    "pages": (r"index\.xml", r"<(?:sf:)?s\b[^>]*>([^<]*)<", " "),
}
ARCHIVE_MEMBERS = frozenset("txt md markdown mdown json xml csv html htm svg rtf eml mbox".split())


def _open(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data)) if data and data[:4] == b"PK\x03\x04" else None
    except (zipfile.BadZipFile, ValueError):
        return None


def _read(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes; none above the limit or when it is damaged."""
    try:
        return b"" if info.file_size > MEMBER_MOST else archive.read(info)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, ValueError):
        return b""


def _plain(markup: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", markup)).strip()


# The characters that a chapter may name, in the order in which they are replaced.
NAMED = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')]


def _chapter(markup: str) -> str:
    """A chapter's text without scripts, styles and tags, its named characters decoded, runs of white space as one space."""
    for tag in ("script", "style"):
        markup = re.sub(rf"(?is)<{tag}[^>]*>.*?</{tag}>", "", markup)
    text = re.sub(r"<[^>]+>", " ", markup)
    for name, character in NAMED:
        text = re.sub(f"(?i){name}", character, text)
    return re.sub(r"\s{2,}", " ", text).strip()


def _epub(archive: zipfile.ZipFile) -> str:
    """The chapters in the order of the spine of the package that the container names, a blank line between them."""
    names = {i.filename: i for i in archive.infolist()}
    container = names.get("META-INF/container.xml")
    named = re.search(r'full-path="([^"]+)"', _read(archive, container).decode("utf-8", "replace")) if container else None
    package = names.get(named[1]) if named else None
    if package is None:
        return ""
    opf, base = _read(archive, package).decode("utf-8", "replace"), posixpath.dirname(package.filename)
    items = {m[1]: h[1] for tag in re.findall(r"<item\b[^>]*>", opf) if (m := re.search(r'\bid="([^"]*)"', tag)) and (h := re.search(r'\bhref="([^"]*)"', tag))}
    wanted = [posixpath.normpath(posixpath.join(base, items[r])) for r in re.findall(r'<itemref\b[^>]*\bidref="([^"]*)"', opf) if r in items]
    return "\n\n".join(t for n in wanted if n in names and (t := _chapter(_read(archive, names[n]).decode("utf-8", "replace"))))


def zipped_xml_text(ext: str, data: bytes) -> str:
    """The text of one file of a zipped-XML family; '' for an unreadable one."""
    archive = _open(data)
    if archive is None:
        return ""
    if ext == "epub":
        return _epub(archive)
    member, piece, joiner = FAMILIES[ext]
    found = [(int(m[1]) if m.groups() else 0, i) for i in archive.infolist() if (m := re.fullmatch(member, i.filename))]
    texts = []
    for _, info in sorted(found, key=lambda x: (x[0], x[1].filename)):
        page = _read(archive, info).decode("utf-8", "replace")
        words = [w.strip() for p in (piece if isinstance(piece, tuple) else (piece,)) for w in re.findall(p, page)]
        if words := [w for w in words if w]:
            texts.append(joiner.join(words))
    return (" | " if ext == "vsdx" else "\n").join(texts)


def archive_members(data: bytes, depth: int = 1) -> Iterator[tuple[str, str]]:
    """(name, text) of each text member, nested archives included down to DEPTH_MOST."""
    archive = _open(data)
    if archive is None:
        return
    for info in archive.infolist():
        name = posixpath.basename(info.filename)
        ext = name.rpartition(".")[2].lower()
        if info.is_dir() or not name or name[0] in "._":
            continue
        if ext == "zip" and depth < DEPTH_MOST:
            yield from archive_members(_read(archive, info), depth + 1)
        elif ext in ARCHIVE_MEMBERS and (text := _plain(_read(archive, info).decode("utf-8", "replace"))):
            yield info.filename, text


def zip_xml_to_text(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, text) of zipped-XML files, from their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [zipped_xml_text(p.rpartition(".")[2].lower(), c or b"") for p, c in zip(frame["path"], frame["content"])]})

    known = F.lower(F.substring_index(path_col, ".", -1)).isin(*FAMILIES, "epub")
    return files.where(known).select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, "path string, text string")


def expand_zip(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, nr, member, text): one row for each text member of each archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"]):
                rows = [(p, k, name, text) for k, (name, text) in enumerate(archive_members(c or b""))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "nr", "member", "text"])

    zips = files.where(F.lower(path_col).endswith(".zip")).select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    return zips.mapInPandas(run, "path string, nr int, member string, text string")


def archive_text(members: DataFrame) -> DataFrame:
    """(path, text): the members of ``expand_zip`` put together, each under its name."""
    piece = F.concat(F.lit("["), F.col("member"), F.lit("]\n"), F.col("text"))
    grouped = members.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("nr", piece.alias("piece")))).alias("pieces"))
    return grouped.select("path", F.array_join("pieces.piece", "\n---\n").alias("text"))


def _opened_text(path: pd.Series, content: pd.Series) -> pd.Series:
    """The text of a zipped file; null where there is no content."""

    def one(p: str, c: bytes | None) -> str | None:
        if c is None:
            return None
        ext = p.rpartition(".")[2].lower()
        return "\n---\n".join(f"[{name}]\n{text}" for name, text in archive_members(c)) if ext == "zip" else zipped_xml_text(ext, c)

    return pd.Series([one(p, c) for p, c in zip(path, content)], dtype="object")


def file_text(path: Column, content: Column) -> Column:
    """The text of a file of any known kind, from its bytes: zipped XML and archives are opened, everything else is read as UTF-8
    text and routed by its extension; '' for an unknown kind or unreadable bytes. Bytes of zipped files alone leave the JVM."""
    zipped = F.lower(F.substring_index(path, ".", -1)).isin(*FAMILIES, "epub", "zip")
    opened = F.pandas_udf(_opened_text, "string")(F.when(zipped, path), F.when(zipped, content))
    return F.when(zipped, F.coalesce(opened, F.lit(""))).otherwise(extract_text(path, F.decode(content, "UTF-8")))


def extract_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, text) of files, in one pass over them."""
    return files.select(F.col(path_col).alias("path"), file_text(F.col(path_col), F.col(content_col)).alias("text"))
