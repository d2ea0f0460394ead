"""Table maintenance: each operator gives the new table; write it to a new place and switch over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions.paths import ancestors, basename, normalized
from quillmill.operators.stats import folder_stats


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__nr", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__nr = 1").drop("__nr")


#: New rows are numbered within so many parts, so that no row waits for all others' numbers.
PARTS = 4096


def with_new_ids(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with an id above the largest one of files: unique, with gaps, and the same whenever it is computed, as it follows from the paths alone."""
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
    place = F.row_number().over(W.partitionBy(part).orderBy("path"))
    return rows.withColumn("__nr", place.cast("long") * PARTS + part).crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("__nr")).drop("__nr", "__top")


def upsert_files(files: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """files with the batch's rows inserted or updated by path: id and created_at stay, updated_at is now; the last row of a path wins.

    The batch's paths are looked up among the ids and paths of files, so that no content is shuffled to find them.
    """
    values = [c for c in files.columns if c not in ("id", "path", "created_at", "updated_at")]
    new = _last(batch, ["path"], order).select("path", F.struct(*values).alias("__new"))
    met = files.select("id", "path").join(new, "path", "right")
    out = files.join(met.where("id IS NOT NULL").select("id", "__new"), "id", "left")
    columns = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in values}
    columns["updated_at"] = F.when(F.col("__new").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at")
    kept = out.select(*[columns.get(c, F.col(c)) for c in files.columns])
    added = with_new_ids(met.where("id IS NULL").drop("id"), files).select("id", "path", "__new.*").withColumns({"created_at": now, "updated_at": now})
    return kept.unionByName(added.select(*files.columns))


def update_content(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Content replaced by path; blank content is ignored. contents: (path, content), a path once."""
    new = contents.where(F.trim("content") != "").select("path", F.col("content").alias("__content"))
    return files.join(new, "path", "left").withColumn("content", F.coalesce("__content", "content")).select(*files.columns)


def rename_file(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Path and name of renamed files. renames: (old_path, new_path)."""
    moved = renames.select(F.col("old_path").alias("path"), normalized(F.col("new_path")).alias("__new"))
    out = files.join(moved, "path", "left")
    return out.withColumns({"name": F.when(F.col("__new").isNotNull(), basename(F.col("__new"))).otherwise(F.col("name")), "path": F.coalesce("__new", "path")}).select(*files.columns)


def rename_folder(files: DataFrame, renames: DataFrame) -> DataFrame:
    """The folder part of the paths of all descendants; of nested renames the deepest counts. renames: (old_folder, new_folder)."""
    above = files.select("id", F.explode(ancestors(F.col("path"))).alias("old_folder"))
    best = above.join(renames, "old_folder").groupBy("id").agg(F.max(F.struct(F.length("old_folder").alias("n"), "new_folder")).alias("__r"))
    out = files.join(best, "id", "left")
    return out.withColumn("path", F.when(F.col("__r").isNotNull(), F.concat("__r.new_folder", F.substr("path", F.col("__r.n") + 1))).otherwise(F.col("path"))).select(*files.columns)


def except_deleted(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """files without the given paths."""
    return files.join(deleted.select("path"), "path", "left_anti").select(*files.columns)


def delete_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files without what is below the folders."""
    below = files.select("id", F.explode(ancestors(F.col("path"))).alias("dir")).join(folders.select(F.col("path").alias("dir")), "dir", "left_semi").select("id")
    return files.join(below.distinct(), "id", "left_anti")


def upsert_folder_stats(folders: DataFrame, files: DataFrame, now: Column, full: bool = False) -> DataFrame:
    """folders with counts, sizes and the time of the scan."""
    counted = folder_stats(files, folders).withColumnsRenamed({"file_count": "__n", "total_size": "__s"})
    out = folders.join(counted, "path").withColumns({"file_count": F.col("__n"), "total_size": F.col("__s"), "last_scan_at": now})
    if full:
        out = out.withColumn("last_full_scan_at", now)
    return out.select(*folders.columns)


def insert_ignore(pairs: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with those new ones that it lacks."""
    return pairs.unionByName(new.dropDuplicates(keys).join(pairs.select(*keys), keys, "left_anti").select(*pairs.columns))


def tag_upsert(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags with the new ones, unique by trimmed name; a known name takes the new color. new: (id, name, color)."""
    fresh = _last(new.withColumn("name", F.trim("name")).where("name <> ''"), ["name"], "id").select("name", F.col("color").alias("__color"), F.col("id").alias("__id"))
    both = tags.join(fresh, "name", "full")
    return both.select(F.coalesce("id", "__id").alias("id"), "name", F.coalesce("__color", "color").alias("color"))


def tag_update(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """Names and colors changed by id; null keeps the old value. changes: (id, name, color)."""
    new = changes.select("id", F.nullif(F.trim("name"), F.lit("")).alias("__name"), F.col("color").alias("__color"))
    out = tags.join(new, "id", "left")
    return out.withColumns({"name": F.coalesce("__name", "name"), "color": F.coalesce("__color", "color")}).select(*tags.columns)


def tag_delete(tags: DataFrame, file_tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given tag ids."""
    return tags.join(gone.select("id"), "id", "left_anti").select(*tags.columns), file_tags.join(gone.select(F.col("id").alias("tag_id")), "tag_id", "left_anti").select(*file_tags.columns)


def remove_file_tag(file_tags: DataFrame, pairs: DataFrame) -> DataFrame:
    return file_tags.join(pairs.select("file_path", "tag_id"), ["file_path", "tag_id"], "left_anti").select(*file_tags.columns)
