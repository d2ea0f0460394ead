"""Change-journal records: reason masks, file times, directory events; and rules read from settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the reason mask and of the attributes, and the distance of 1601 from 1970.
DATA_OVERWRITE, DATA_TRUNCATION = 0x1, 0x4
FILE_CREATE, FILE_DELETE = 0x1000000, 0x2000000
RENAMED_OLD, RENAMED_NEW = 0x4000000, 0x8000000
DIRECTORY = 0x10
FILETIME_SHIFT_MS = 11_644_473_600_000
BITS = {"rename_old": RENAMED_OLD, "rename_new": RENAMED_NEW, "created": FILE_CREATE, "deleted": FILE_DELETE, "modified": DATA_OVERWRITE | DATA_TRUNCATION}


def is_directory(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(DIRECTORY).cast("long")) != 0


def decode_reason_mask(reason: Column, is_dir: Column) -> Column:
    """The events of a mask in a fixed order: rename_old, rename_new, created, deleted, modified (not of directories)."""
    has = lambda name: reason.bitwiseAND(F.lit(BITS[name]).cast("long")) != 0
    events = [F.when(has(n), F.lit(n)) for n in ("rename_old", "rename_new", "created", "deleted")]
    return F.array_compact(F.array(*events, F.when(has("modified") & ~is_dir, F.lit("modified"))))


def filetime_to_ts(filetime: Column) -> Column:
    """100-nanosecond ticks since 1601 to a timestamp of whole milliseconds."""
    return F.timestamp_millis(F.floor(filetime.cast("decimal(20,0)") / 10_000).cast("long") - FILETIME_SHIFT_MS)


def map_dir_event(event: Column, is_dir: Column) -> Column:
    return F.when(is_dir & (event == "created"), "folder_created").when(is_dir & (event == "deleted"), "folder_deleted").when(is_dir & (event == "renamed"), "folder_renamed").otherwise(event)


RULES = "array<struct<name:string,type:string,pattern:string,enabled:boolean>>"


def parse_skip_rules(text: Column) -> Column:
    """An array of rules from JSON text; empty for null, blank and invalid text."""
    return F.coalesce(F.from_json(text, RULES), F.array().cast(RULES))


def valid_skip_rule(rule: Column) -> Column:
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(rule["name"]) & filled(rule["pattern"]) & F.coalesce(rule["type"].isin("ext", "name", "path"), F.lit(False))


def valid_saved_name(name: Column) -> Column:
    return F.coalesce(F.length(F.trim(name)).between(1, 100), F.lit(False))
