"""What the operators of this subpackage share: input tables, written intermediate tables, hashing in numpy."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables that nothing has deleted yet and that no scratch holds; they go when the process ends.
_LEFT: list[str] = []
_OPEN: list[scratch] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that comes in fewer pieces than there are cores (a file of one row group is one piece) is dealt out first; a large one is not."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is written there goes like a table of ``materialize``."""
    path = f"{shared_dir(spark)}/quillmill-{name}-{uuid.uuid4().hex[:12]}"
    (_OPEN[-1].made if _OPEN else _LEFT).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and a value that is not
    deterministic (a generated id) is fixed. ``drop``, the end of a ``scratch`` or that of the process removes the files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmill_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize``; call it only when all that reads it has been written."""
    path = getattr(df, "_quillmill_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for held in (_LEFT, *(o.made for o in _OPEN)):
        if path in held:
            held.remove(path)


class scratch:
    """``with scratch() as s``: the tables written inside are deleted at its end, but for those given to ``s.keep``, which go on to
    the scratch around it. Operators return lazily, so what their result still reads is kept."""

    def __enter__(self) -> scratch:
        self.made: list[str] = []
        _OPEN.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = df._quillmill_path
        self.made.remove(path)
        around = _OPEN.index(self) - 1
        (_OPEN[around].made if around >= 0 else _LEFT).append(path)
        return df

    def __exit__(self, *_) -> None:
        spark = SparkSession.getActiveSession()
        _OPEN.remove(self)
        for path in list(self.made) if spark else []:
            _delete(spark, path)


@atexit.register
def _tidy() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_LEFT) if spark else []:
        _delete(spark, path)


def free_name(taken: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of the taken ones (case aside)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def private_prefix(taken: list[str], start: str) -> str:
    """start, with as many underscores before it as it takes that no taken name begins so (case aside): for an operator's own columns."""
    while any(t.lower().startswith(start.lower()) for t in taken):
        start = "_" + start
    return start


def give_back() -> None:
    """Hand what a worker no longer uses back to the system: workers are used again, and those that wait would hold it beside the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of ``column``, one row at least; bounds a worker's memory."""
    give_back()  # what the worker's former task left
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


MASK = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.empty(0, dtype=np.uint64)
_INV = np.empty(0, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            pow_, inv = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            pow_[0] = inv[0] = 1
            _POW, _INV = np.multiply.accumulate(pow_), np.multiply.accumulate(inv)
    return _POW, _INV


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A byte's value is first mixed, so that sums of powers do not cancel for related bytes.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


#: Bytes outside words of letters: ASCII bytes that are not letters. Bytes of longer characters count as letters.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def word_hashes(data: bytes, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word (run of bytes not ``outside``: not ASCII white space), without a loop over words."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~outside[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0, dtype=np.uint64)
    pow_, inv = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = _BYTE[raw]
        total *= pow_[: len(raw)]
        np.cumsum(total, out=total)
        before = np.where(start > 0, total[start - 1], U(0))
        hashed = (total[end - 1] - before) * inv[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return start, end, mix(hashed)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k word hashes; of the whole when there are fewer words; none when there are none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * U(0xFF51AFD7ED558CCD) + words[i : len(words) - k + 1 + i])
    return out


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8, a line feed after each, and where each ends; null is empty."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    return b"\n".join([*parts, b""]), np.cumsum([len(p) + 1 for p in parts])


def held_out(id_: Column) -> Column:
    """True for rows whose crc32 of the id as text leaves 2 when divided by 4; never used for learning."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))
