"""Names, extensions, categories and places of files, from their paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of each extension.
FILE_TYPES = {
    "text": "txt md markdown mdown json xml csv yaml yml log ini cfg conf srt vtt nfo rst tex",
    "html": "html htm",
    "svg": "svg",
    "docx": "doc docx wps pages",
    "xlsx": "xls xlsx et numbers ots",
    "pptx": "ppt pptx wpp dps key otp",
    "pdf": "pdf",
    "xps": "xps",
    "rtf": "rtf",
    "chm": "chm",
    "odf": "odt ods odp",
    "epub": "epub",
    "zip": "zip 7z tar gz bz2",
    "rar": "rar",
    "email": "mbox eml pst msg",
    "ebook": "mobi azw3 fb2",
    "diagram": "vsd vsdx odg",
    "chart": "odc",
    "image": "jpg jpeg png gif webp bmp tiff tif",
    "media": "mp3 flac ogg wav aac m4a mp4 avi mkv mov wmv flv webm",
}
# The groups by which scans are switched on and off.
SCAN_GROUPS = {
    "documents": "doc docx xls xlsx ppt pptx rtf chm wps wpp et dps",
    "pdf": "pdf xps",
    "text": "txt md markdown mdown json xml csv html htm svg yaml yml log ini cfg conf srt vtt nfo rst tex mobi azw3 fb2 vsd vsdx pages",
    "odf": "odt ods odp epub numbers key odg odc ots otp",
    "archives": "zip rar 7z tar gz bz2",
    "email": "mbox eml pst msg",
    "media": "jpg jpeg png gif webp bmp tiff tif mp3 flac ogg wav aac m4a mp4 avi mkv mov wmv flv webm",
}


def _lookup(groups: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for name, words in groups.items() for w in words.split() for x in (w, name)]
    return F.element_at(F.create_map(*pairs), key)


def normalized(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(normalized(path), "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; '.' without one, '/' for a file of the root."""
    p = normalized(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(F.coalesce(F.nullif(F.regexp_extract(p, r"(?s)^(.*)/", 1), F.lit("")), F.lit("/")))


def extension(path: Column) -> Column:
    """'.txt' in lower case; '' without one. A name's leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?s)(?<=.)\.[^.]*$", "")


def volume(path: Column) -> Column:
    """'D:' of a Windows path, '/Users' of a Unix one."""
    p = normalized(path)
    return F.when(p.rlike("^[A-Za-z]:"), F.substring(p, 1, 2)).otherwise(F.regexp_extract(p, "^(/[^/]*)", 1))


def is_hidden(path: Column) -> Column:
    return F.startswith(basename(path), F.lit("."))


def file_type(ext: Column) -> Column:
    """The category of an extension without its dot; 'unsupported' for an unknown one."""
    return F.coalesce(_lookup(FILE_TYPES, ext), F.lit("unsupported"))


def scan_group(ext: Column) -> Column:
    """The scan group of an extension without its dot, null for an unknown one."""
    return _lookup(SCAN_GROUPS, ext)


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last; the root is the empty string and not among them."""
    parts = F.split(normalized(path), "/", -1)
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda d: d != "")
