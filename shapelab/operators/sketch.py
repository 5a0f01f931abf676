"""Distinct counts by HyperLogLog with 2**14 registers, bit by bit reproducible.

Each Arrow batch keeps the largest rank of each register, so at most 16,384 rows a
column leave a task, and registers merge by max across tasks, tables and runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14
REGISTERS = 1 << PRECISION
ERROR = 0.008125
# Fixed values of the hash: FNV-1a's offset and prime, and the two finalizer multipliers.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def hash_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FNV-1a of each row, then the finalizer; rows advance together byte by byte."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    begin, size = offsets[:-1][order], size[order]
    h = np.full(len(order), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for j in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -j, side="left"))
        h[:live] = (h[:live] ^ data[begin[:live] + j]) * prime
    out = np.empty(len(h), np.uint64)
    out[order] = h
    for shift, factor in ((30, MULTIPLIERS[0]), (27, MULTIPLIERS[1])):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def ranks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(register, rank): the top bits name the register, the first 1 after them the rank."""
    rest = h << np.uint64(PRECISION)
    width = np.zeros(len(rest), np.int64)  # bit length of rest
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(s) != 0
        width += np.where(big, s, 0)
        rest = np.where(big, rest >> np.uint64(s), rest)
    width += rest != 0
    return (h >> np.uint64(64 - PRECISION)).astype(np.int64), np.minimum(65 - PRECISION, 64 - width + 1)


def registers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, register, rank, seen): the sketch of each column as rows."""

    def run(batches):
        for batch in batches:
            for c in columns:
                values = batch.column(c).drop_null()
                if not len(values):
                    continue
                raw = values.buffers()
                offsets = np.frombuffer(raw[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
                data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
                at, rank = ranks(hash_bytes(data, offsets))
                top = np.zeros(REGISTERS, np.int64)
                np.maximum.at(top, at, rank)
                hit = np.flatnonzero(top)
                seen = np.zeros(len(hit), np.int64)
                seen[0] = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(hit)), pa.array(hit), pa.array(top[hit]), pa.array(seen)], names=["column_name", "register", "rank", "seen"])

    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    rows = text.mapInArrow(run, "column_name string, register long, rank long, seen long")
    return rows.groupBy("column_name", "register").agg(F.max("rank").alias("rank"), F.sum("seen").alias("seen"))


def estimate(sketch: DataFrame) -> DataFrame:
    """(column_name, distinct_count): the estimator, never above the values seen."""
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    one = sketch.groupBy("column_name").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("used"), F.sum("seen").alias("seen"))
    zeros = F.lit(m) - F.col("used")
    raw = F.lit(alpha * m * m) / (F.col("s") + zeros)
    est = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / zeros)).otherwise(raw)
    return one.select("column_name", F.least(F.floor(est + 0.5), F.col("seen")).cast("long").alias("distinct_count"))


def distinct_hll(df: DataFrame, columns: list[str]) -> DataFrame:
    return estimate(registers(df, columns))
