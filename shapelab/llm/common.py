"""Pieces that several operators share: checkpoints, byte views, word splits."""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
from contextlib import contextmanager
from functools import wraps
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes that end a word in the white-space split [^\x20\x09-\x0D]+.
WHITE = b" \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a local master may do with a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shapelab-checkpoint-"))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _dropping_shuffles(spark: SparkSession):
    """While it holds, a query's shuffle files go as soon as the query has ended."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def measured_broadcasts(run):
    """run(df, ...), while which a table is broadcast, through the driver, only for the size it
    was measured to have: estimates know neither how far rows will be expanded nor how well a
    Parquet file is compressed.  What is expanded after a measurement needs unbroadcast()."""
    fixed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

    @wraps(run)
    def bounded(df, *args, **named):
        conf = df.sparkSession.conf
        limit = conf.get(measured, None) or conf.get(fixed)
        with _setting(df.sparkSession, measured, limit), _setting(df.sparkSession, fixed, "-1"):
            return run(df, *args, **named)

    return bounded


def unbroadcast(df: DataFrame) -> DataFrame:
    """df, whose next join broadcasts neither side."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Compute df now, keep it in the shared checkpoint folder and cut its lineage; for
    what a result still reads when the operator has returned."""
    ensure_checkpoint_dir(df.sparkSession)
    with _dropping_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Compute df now into a Parquet table in the shared checkpoint folder, until release()."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stashed_at = path
    return kept


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that stash() gave."""
    for df in frames:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let no Arrow batch on its way to Python pass limit bytes (one row may), however long
    texts are; the session keeps the setting, since results are computed later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > limit:
        spark.conf.set(key, str(limit))


def trim() -> None:
    """Give freed memory of this process back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux") and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """run(batches), whose worker gives memory back before and after the task."""

    def tidy(batches):
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidy


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, from one pass over that column alone."""
    return int(df.select(F.sum(F.octet_length(column))).first()[0] or 0)


def held_out(column: str, parts: int, part: int):
    """True where crc32(id as text) mod parts is part; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def hashed_sample(df: DataFrame, key: str, fraction: float, seed: int):
    """Keep about the given fraction of rows, by a hash of the key and not by place."""
    if fraction >= 1:
        return df
    cut_at = int(fraction * 2**31)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31)) < cut_at)


# --- byte views -----------------------------------------------------------


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; a null reads as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int):
    """Row ranges of at most limit bytes each; one row over the limit stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def row_slices(batches, limit: int, column: str = "text"):
    """Arrow batches cut into pieces whose text column has at most limit bytes."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = utf8_view(batch.column(batch.schema.get_field_index(column)))
            for a, b in spans(offsets, limit):
                yield batch.slice(a, b - a)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


# --- words and their hashes -----------------------------------------------


def odd_powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 2**64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row) of every word of concatenated texts; a row ends a word too."""
    n, rows = len(data), len(offsets) - 1
    inside = np.zeros(n + 2, bool)
    np.logical_not(_IS_WHITE[data], out=inside[1 : n + 1])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.repeat(np.arange(rows), np.diff(np.searchsorted(starts, offsets)))


class WordHasher:
    """Splits concatenated texts at white space and hashes each word to 64 bits.  Memory
    beyond the bounds of the words is that of one piece of PIECE bytes."""

    PIECE = 1 << 20

    def __init__(self, seed: int = 0):
        self.seed = seed
        base = (_ODD + 2 * seed) % 2**64 | 1
        self.powers, self.back = odd_powers(base, self.PIECE), odd_powers(pow(base, -1, 2**64), self.PIECE)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, start, end, row) of every word; offsets are those of the rows."""
        starts, ends, row = word_bounds(data, offsets)
        code = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            low = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, low + self.PIECE, side="right")))
            piece = data[low : ends[b - 1]]
            if len(piece) > self.PIECE:  # one word, which no other path hashes
                code[a] = xxhash.xxh64_intdigest(piece.tobytes(), self.seed)
            else:
                sums = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * self.powers[: len(piece)], out=sums[1:])
                code[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * self.back[starts[a:b] - low]
            a = b
        return mix64(code ^ ((ends - starts).astype(np.uint64) << np.uint64(40)) ^ np.uint64(self.seed)), starts, ends, row


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of width codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += codes[j : j + n] * np.uint64(pow(base, j + 1, 2**64))
    return mix64(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return np.minimum(have[:n], have[width - span : width - span + n])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pack_rows(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.int64).tobytes()


def unpack_rows(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)
