"""Shared pieces: durable intermediate tables, columnar shuffle blocks and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
#: Bytes of text that the vectorised scanners handle at once; long documents are never cut, they make a chunk of their own.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local master, as in tests, gets one of its own where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terseflow-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/terseflow-{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_PATH_OF: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage is cut, executors may be lost, and Catalyst sees the true size."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[found] = path
    return found


def remove(table: DataFrame) -> None:
    """Delete what materialize() wrote; nothing that is read from it may be left to run."""
    spark, path = table.sparkSession, _PATH_OF.pop(table)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


# -- columns of any name -------------------------------------------------------------------------------------------


def found_at(names: list[str], name: str) -> int:
    """The place of a column: of the very name, else of the same but for case."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


class Names:
    """The names of a table whose columns are called c0, c1 and so on for a while, so that none clashes or needs quoting."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def of(self, name: str) -> str:
        return f"c{found_at(self.names, name)}"

    def restore(self, df: DataFrame, changed: dict[str, Column] | None = None, new: dict[str, Column] | None = None) -> DataFrame:
        """The columns under their old names, those of `changed` with new values, then the `new` ones; a column of the table that is called as a new one is left out."""
        changed = {found_at(self.names, k): v for k, v in (changed or {}).items()}
        taken = {n.lower() for n in new or {}}
        old = [changed.get(i, F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*old, *[c.alias(n) for n, c in (new or {}).items()])


def neutral(df: DataFrame) -> tuple[DataFrame, Names]:
    """`df` with its columns called c0, c1 and so on, and the way back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), Names(df.columns)


def named(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns alone, whatever else the table has."""
    plain, names = neutral(df)
    return plain.select(*[F.col(names.of(w)).alias(w) for w in wanted])


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of whole texts of at most `size` bytes, unless the session asks for smaller ones: two tasks' batches must fit beside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if found <= 0 or found > size:
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Memory that Arrow and the C library hold for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, which gives back what it held at its end: workers wait for their next task beside a heap that needs the room."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# -- columnar shuffle blocks ---------------------------------------------------------------------------------------
#
# Hundreds of millions of (hash, id) records are cheaper to shuffle as a few column blocks per map task and reducer
# than as rows: Spark moves and compresses the blocks, NumPy sorts them.

BLOCK_SCHEMA = "part int, block binary"


def pack(part: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Records by target partition; one block of whole columns for each partition."""
    order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    sorted_columns = [c[order] for c in columns]
    ids, blocks = [], []
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if a < b:
            ids.append(p)
            blocks.append(np.uint64(b - a).tobytes() + b"".join(c[a:b].tobytes() for c in sorted_columns))
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])


def unpack(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> list[np.ndarray]:
    """All records of this task's blocks, column by column."""
    found: list[list[np.ndarray]] = [[] for _ in dtypes]
    for batch in batches:
        for block in batch.column(batch.schema.get_field_index("block")):
            raw = block.as_buffer()
            n, at = int(np.frombuffer(raw, np.uint64, 1)[0]), 8
            for k, d in enumerate(dtypes):
                found[k].append(np.frombuffer(raw, d, n, at))
                at += n * np.dtype(d).itemsize
    return [np.concatenate(x) if x else np.empty(0, d) for x, d in zip(found, dtypes)]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U64(33)) % U64(parts)).astype(np.int32)


def by_part(df: DataFrame, parts: int) -> DataFrame:
    """Each block to the task of its number."""
    return df.repartitionById(parts, F.col("part"))


# -- text as byte buffers ------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows of about CHUNK_BYTES. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 64)
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, U64(0x100000001B3), U64))])
    return _POWERS


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and one more). Words are runs of bytes outside `separator`; they end with their row."""
    rows = len(offsets) - 1
    inside = ~separator[raw]
    if not inside.any():
        return np.empty(0, U64), np.zeros(rows + 1, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] |= inside[firsts]
    starts = np.flatnonzero(start)
    number = np.cumsum(start)  # of the word that a byte is in, from 1
    position = np.arange(len(raw)) - starts[np.maximum(number - 1, 0)]
    table = powers(int(np.max(np.diff(np.append(starts, len(raw))))) + 1)
    value = (raw.astype(U64) + U64(1)) * table[np.maximum(position, 0)]
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, offsets)


def segment_index(first: np.ndarray) -> np.ndarray:
    """For the bounds of segments: the segment number of each element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
