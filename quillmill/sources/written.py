"""Intermediate tables in the folder that driver and executors share, and their removal.

A written table cuts the lineage: a lost executor costs a reread, not a recomputation. Tables written inside of ``with scratch()`` go at its end but for
those that are kept; all others when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that are sent to the other side of a join; more are joined by a shuffle.
SENT_BYTES = 64 << 20

_LEFT: list[str] = []
_OPEN: list[scratch] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names; only a local session may name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    (_OPEN[-1].made if _OPEN else _LEFT).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def sent(df: DataFrame, name: str) -> DataFrame:
    """df, written, and to be sent to the other side of a join if its rows are few by a count of their bytes."""
    kept = written(df, name)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns)))).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(kept) if size <= SENT_BYTES else kept


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for held in (_LEFT, *(s.made for s in _OPEN)):
        if path in held:
            held.remove(path)


class scratch:
    """See above; ``keep`` hands a table on to the scratch around this one, or to the end of the process."""

    def __enter__(self) -> scratch:
        self.made: list[str] = []
        _OPEN.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.made.remove(df._written_path)
        around = _OPEN.index(self) - 1
        (_OPEN[around].made if around >= 0 else _LEFT).append(df._written_path)
        return df

    def __exit__(self, *_) -> None:
        spark = SparkSession.getActiveSession()
        _OPEN.remove(self)
        for path in list(self.made) if spark else []:
            remove(spark, path)


@atexit.register
def _tidy() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_LEFT) if spark else []:
        remove(spark, path)
