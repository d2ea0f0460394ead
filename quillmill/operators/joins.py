"""Hits with their files, tags of files, files of folders, change roots, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.paths import ancestors, normalized
from quillmill.sources.written import sent


def fts_join(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the columns of their files; do it after the top results are chosen: few hits are sent to the files, whose contents are read in their place."""
    met = files.withColumnRenamed("id", "doc_id").join(sent(hits, "hits"), "doc_id")
    return met.select("doc_id", *[c for c in hits.columns if c != "doc_id"], *[c for c in files.columns if c != "id"])


def tags_for_files(paths: DataFrame, file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_path, tag_id, name, color) of the given paths."""
    wanted = file_tags.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return wanted.join(tags.select(F.col("id").alias("tag_id"), "name", "color"), "tag_id").select("file_path", "tag_id", "name", "color")


def files_with_tag(file_tags: DataFrame, tag_id: int) -> DataFrame:
    return file_tags.where(F.col("tag_id") == tag_id).select("file_path").distinct()


def all_file_tags(file_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_path, tags): each path's tags in order of name; one entry for each tag of a file."""
    joined = file_tags.join(tags.select(F.col("id").alias("tag_id"), "name", "color"), "tag_id")
    return joined.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("name", "tag_id", "color"))).alias("tags"))


def assign_to_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder_path, id, size) for each file and each folder above it: an equi-join on the directories of the path."""
    above = files.select("id", "size", F.explode(ancestors(F.col("path"))).alias("dir"))
    known = folders.select(F.col("path").alias("folder_path"), F.regexp_replace(normalized(F.col("path")), "/+$", "").alias("dir"))
    return above.join(known, "dir").select("folder_path", "id", "size")


def orphan_files(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files under none of the folders."""
    return files.join(assign_to_folders(files, folders).select("id").distinct(), "id", "left_anti")


def cleanup_orphans(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files without the orphans; without any folder nothing is removed."""
    some = folders.limit(1).select(F.lit(True).alias("some"))
    kept = files.join(assign_to_folders(files, folders).select("id").distinct(), "id", "left_semi")
    return kept.unionByName(files.join(some, F.lit(True), "left_anti"))


def filter_monitored_roots(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """Events whose path starts with a watched root; the roots are settings, a few rows, and each event is compared with all of them."""
    return changes.join(roots.select(F.col("root").alias("__root")), F.startswith("path", F.col("__root")), "left_semi")


def resolve_parent_paths(journal: DataFrame, folders: DataFrame, root: str = "/") -> DataFrame:
    """journal with path: the folder of its parent id, or the volume's root, and its name. folders: (parent_id, folder)."""
    joined = journal.join(folders, "parent_id", "left")
    return joined.withColumn("path", F.concat(F.regexp_replace(F.coalesce("folder", F.lit(root)), "/+$", ""), F.lit("/"), F.col("file_name"))).drop("folder")


def lookup_content(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, content) of the given paths."""
    return files.select("path", "content").join(paths.select(normalized(F.col("path")).alias("path")).distinct(), "path", "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): inserted, updated (hash or content differs), unchanged or deleted."""
    state = lambda d, p: d.select("path", F.col("hash").alias(f"{p}_hash"), F.xxhash64("content").alias(f"{p}_content"), F.lit(True).alias(f"{p}_there"))
    both = state(old, "o").join(state(new, "n"), "path", "full")
    same = F.col("o_hash").eqNullSafe(F.col("n_hash")) & F.col("o_content").eqNullSafe(F.col("n_content"))
    change = F.when(F.col("o_there").isNull(), "inserted").when(F.col("n_there").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    return both.select("path", change.alias("change"))
