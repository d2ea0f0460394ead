"""Predicates and filters on files and queries."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import paths

# Fixed values.
SYSTEM_FOLDERS = ("$RECYCLE.BIN", "System Volume Information", "RECYCLER")
ALWAYS_SKIPPED = "node_modules"
HASH_MOST = 100 * 1024 * 1024
TEXT_MOST, PDF_MOST = 100 * 1024 * 1024, 50 * 1024 * 1024


def with_file_fields(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Normalised path, name, ext, file_type and is_supported from the path."""
    path = F.col(path_col)
    ext = F.substr(paths.extension(path), F.lit(2))
    out = files.withColumns({"name": paths.basename(path), "ext": ext, path_col: paths.normalized(path)})
    return out.withColumns({"file_type": paths.file_type(F.col("ext")), "is_supported": paths.file_type(F.col("ext")) != "unsupported"})


def content_hash(content: Column, size: Column) -> Column:
    """MD5 of the content of files that are neither empty nor of 100 MB and more."""
    return F.when((size > 0) & (size < HASH_MOST), F.md5(content))


def filter_hidden_system(files: DataFrame, hidden: bool = False, system: bool = False, path_col: str = "path") -> DataFrame:
    """Without files in or under hidden (unless ``hidden``) and system (unless ``system``) folders and node_modules."""
    parts = F.split(paths.normalized(F.col(path_col)), "/", -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(folders, lambda p: p == ALWAYS_SKIPPED)
    if not hidden:
        bad = bad | F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", ".."))
    if not system:
        bad = bad | F.exists(folders, lambda p: p.isin(*SYSTEM_FOLDERS))
    return files.where(~bad)


def filter_categories(files: DataFrame, enabled: dict[str, bool], ext: Column) -> DataFrame:
    """Without extensions whose scan group is switched off; unknown extensions stay."""
    off = [g for g, on in enabled.items() if not on]
    return files.where(~F.coalesce(paths.scan_group(ext).isin(*off), F.lit(False))) if off else files


def limited_content(content: Column, size: Column, ext: Column) -> Column:
    """'' instead of the content of files too large to read (PDF has a smaller limit)."""
    return F.when(size > F.when(ext == "pdf", PDF_MOST).otherwise(TEXT_MOST), "").otherwise(content)


def apply_skip_rules(files: DataFrame, rules: DataFrame, path_col: str = "path") -> DataFrame:
    """Without files that an enabled rule matches: by end of the path (ext), by name, or by a part of the path, in any case.

    Rules are written by hand and few: a file is compared with each of them, so this is no join for tables of rules.
    """
    low, name = F.lower(F.col(path_col)), F.lower(paths.basename(F.col(path_col)))
    on = rules.where("enabled").select(F.col("type").alias("__t"), F.lower("pattern").alias("__p"))
    hit = ((F.col("__t") == "ext") & F.endswith(low, F.col("__p"))) | ((F.col("__t") == "name") & (name == F.col("__p"))) | ((F.col("__t") == "path") & F.contains(low, F.col("__p")))
    return files.join(on, hit, "left_anti")


def filter_file_types(files: DataFrame, types: list[str]) -> DataFrame:
    return files.where(F.col("file_type").isin(*types)) if types else files


def filter_size_range(files: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """A bound of 0 is no bound."""
    if least > 0:
        files = files.where(F.col("size") >= least)
    return files.where(F.col("size") <= most) if most > 0 else files


def filter_date_range(files: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Bounds are compared as text: until '2024-01-05' leaves that day out."""
    text = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")
    if since:
        files = files.where(text >= since)
    return files.where(text <= until) if until else files


def filter_path_contains(files: DataFrame, part: str) -> DataFrame:
    return files.where(F.contains(F.lower("path"), F.lower(F.lit(part))))


def filter_ext(files: DataFrame, names: list[str], match: str = "file_type") -> DataFrame:
    """Files of any of the names: of their categories, or with match='extension' of the extensions themselves."""
    value = F.col("file_type") if match == "file_type" else F.substr(paths.extension(F.col("path")), F.lit(2))
    return files.where(value.isin(*[n.lower() for n in names])) if names else files


def filter_supported(files: DataFrame) -> DataFrame:
    return files.where("is_supported")


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM, which matches it, can read the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def regex_filter(hits: DataFrame, pattern: str) -> DataFrame:
    """Hits whose path or content matches, in any case; none for an invalid pattern."""
    if not valid_pattern(hits.sparkSession, pattern):
        return hits.limit(0)
    return hits.where(F.col("path").rlike("(?i)" + pattern) | F.col("content").rlike("(?i)" + pattern))


def secondary_filter(hits: DataFrame, part: str) -> DataFrame:
    return hits.where(F.contains(F.lower("path"), F.lower(F.lit(part))) | F.contains(F.lower("name"), F.lower(F.lit(part))))


def split_query_fields(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """name_query, path_query (null without one), ext_filters and remaining out of name:, path: and ext: in a query."""
    q = F.col(query_col)
    exts = F.transform(F.regexp_extract_all(q, F.lit(r"(?i)\bext:([a-z0-9]+)\b"), 1), F.lower)
    rest = F.regexp_replace(q, r"(?i)\bext:[a-z0-9]+\b", "")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_extract(q, rf'(?i)\b{name}:("[^"]+"|\S+)', 1), '^"|"$', ""), F.lit(""))

    rest = F.regexp_replace(rest, r'(?i)\b(name|path):("[^"]+"|\S+)', "")
    return queries.withColumns({"name_query": field("name"), "path_query": field("path"), "ext_filters": exts, "remaining": F.trim(F.regexp_replace(rest, r"\s+", " "))})


def clean_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def valid_query(query: Column) -> Column:
    return F.coalesce((F.trim(F.regexp_replace(query, r"\s+", " ")) != "") & (F.length(query) <= 500), F.lit(False))
