"""Exact top-k search by distributed histogram selection.

Components become floor(64 * x).  Queries and candidates are packed into blocks
of one dimension; every pair of a query block and a candidate block is scored by
one matrix product, and no score is stored.  Instead each pass counts scores per
query in buckets: first of 2**16 scores, then the bucket that holds the k-th
highest score in buckets of 2**8, then in single scores.  So the k-th value of
every query becomes known exactly.  A last pass keeps what lies above it, and of
those equal to it the smallest ids of each block, and ranks them.

A block reports only buckets down to its own k-th score, since the k-th score of
all rows cannot be lower, so a histogram has at most k entries for each query and
block, however many rows tie.

Defined results: null vectors and vectors with null or non-finite components take
no part, nor do rows without an id; vectors meet those of the same dimension;
rows that share the query's id are its own; equal scores rank by id, a repeated
query id asks once, with its least vector, and repeated candidates count as often
as they stand.
Only the key and vector are read, so other columns may have any names; an empty table
gives an empty result.  Scores have 64 bits: products beyond them wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pack_rows, unpack_rows

QUERY_BLOCK = 512
ROW_BLOCK = 4096
LEVELS = (16, 8, 0)


def quantized(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, dim, v): usable rows as arrays of longs."""
    usable = F.col(key).isNotNull() & F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.size(column).alias("dim"), F.transform(column, lambda x: F.floor(x.cast("double") * 64)).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, part, ids, data): blocks of up to size rows of one dimension, as bytes."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                flat = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), d)
                held.setdefault(int(d), []).append((ids[at], flat))
                if sum(len(x[0]) for x in held[int(d)]) >= size:
                    yield from flush(int(d), held.pop(int(d)))
        for d, parts in held.items():
            yield from flush(d, parts)

    def flush(d, parts):
        ids, flat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for a in range(0, len(ids), size):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([pack_rows(ids[a : a + size])], pa.binary()), pa.array([pack_rows(flat[a : a + size].reshape(-1))], pa.binary())], names=["dim", "ids", "data"])

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where no sum can reach 2**53, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _pairs(frame: DataFrame, schema: str, work) -> DataFrame:
    """work(query ids, query vectors, known columns, row ids, row vectors) for every pair of blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qi, ci = unpack_rows(row["q_ids"]), unpack_rows(row["ids"])
                q, c = unpack_rows(row["q_data"]).reshape(len(qi), row["dim"]), unpack_rows(row["data"]).reshape(len(ci), row["dim"])
                known = [unpack_rows(row[x]) for x in ("edge", "above") if x in row]
                s = scores(q, c)
                own = qi[:, None] == ci[None, :]
                yield work(qi, s, own, known, ci)

    return frame.mapInArrow(run, schema)


def _tops(score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which scores of each row of the matrix reach its k-th highest."""
    low = np.where(own, np.iinfo(np.int64).min, score)
    if low.shape[1] > k:
        kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        return ~own & (low >= kth[:, None])
    return ~own


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", column: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query row."""
    rows = quantized(vectors, key, column)
    asked = rows.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    queries = cut(blocks(asked, query_block).withColumn("block", F.monotonically_increasing_id()))
    candidates = cut(blocks(rows, row_block).withColumn("row_block", F.monotonically_increasing_id()))
    total = max(1, candidates.count() * max(1, queries.count()))
    # The stated query set against all rows, in blocks: one row for each pair of blocks.
    q = queries.select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    asked = queries.groupBy("dim").agg(F.collect_list("block").alias("each"))
    pairing = candidates.select("dim", "row_block").join(asked, "dim").select("row_block", F.explode("each").alias("block"))
    parts = max(1, min(total, 4 * vectors.sparkSession.sparkContext.defaultParallelism))

    def joined(known: DataFrame | None) -> DataFrame:
        asked = q if known is None else q.join(known, "block")
        return pairing.join(asked, "block").join(candidates.drop("dim"), "row_block").repartition(max(parts, total // 64), "block", "row_block")

    known = None
    for shift in LEVELS:

        def count(qi, s, own, seen, ci, shift=shift):
            top = _tops(s, own, k)
            value = s >> shift
            if seen:
                edge, above = seen  # buckets of the level before, and the rows above them
                top &= (s >> seen_shift) == edge[:, None]
            r, c = np.nonzero(top)
            both = np.rec.fromarrays([r, value[r, c]])
            uniq, n = np.unique(both, return_counts=True) if len(r) else (both, np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(qi[uniq.f0] if len(r) else np.zeros(0, np.int64)), pa.array(uniq.f1 if len(r) else np.zeros(0, np.int64)), pa.array(n.astype(np.int64))], names=["query_id", "bucket", "n"])

        seen_shift = LEVELS[LEVELS.index(shift) - 1] if known is not None else 64
        histogram = _pairs(joined(known), "query_id long, bucket long, n long", count).groupBy("query_id", "bucket").agg(F.sum("n").alias("n"))
        before = None if known is None else placed
        placed = cut(_kth(histogram, before, k))
        known = _per_block(queries, placed)

    def keep(qi, s, own, seen, ci):
        edge, above = seen
        r, c = np.nonzero(~own & (s >= edge[:, None]))
        order = np.lexsort((ci[c], -s[r, c], r))
        r, c = r[order], c[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[rank < k], c[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ci[c]), pa.array(s[r, c])], names=["query_id", "vec_id", "score"])

    kept = _pairs(joined(known), "query_id long, vec_id long, score long", keep)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, k)
    ranked = kept.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))


def _kth(histogram: DataFrame, before: DataFrame | None, k: int) -> DataFrame:
    """(query_id, edge, above): the bucket that holds the k-th highest score, and how many
    lie above it; the lowest bucket where there are fewer than k."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("bucket"))
    base = histogram.withColumn("above", F.lit(0)) if before is None else histogram.join(before.select("query_id", "above"), "query_id")
    run = base.withColumn("reach", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("above"))
    hit = F.when((F.col("reach") >= k), F.struct((-F.col("bucket")).alias("low"), (F.col("reach") - F.col("n")).alias("above")))
    least = F.struct((-F.col("bucket")).alias("low"), (F.col("reach") - F.col("n")).alias("above"))
    one = run.groupBy("query_id").agg(F.coalesce(F.min(hit), F.max(least)).alias("x"))
    return one.select("query_id", (-F.col("x.low")).alias("edge"), F.col("x.above").cast("long").alias("above"))


def _per_block(queries: DataFrame, placed: DataFrame) -> DataFrame:
    """edge and above of each query block's rows, in the order of the block."""
    ids = queries.select("block", "ids").mapInArrow(_listed, "block long, at int, query_id long")
    both = ids.join(placed, "query_id", "left").fillna({"edge": 2**62, "above": 0})
    lists = both.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "edge", "above"))).alias("x"))
    return lists.select("block", F.col("x.edge").alias("e"), F.col("x.above").alias("a")).mapInArrow(_packed, "block long, edge binary, above binary")


def _listed(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_rows(row["ids"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "at", "query_id"])


def _packed(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([pack_rows(np.array(row["e"], np.int64))], pa.binary()), pa.array([pack_rows(np.array(row["a"], np.int64))], pa.binary())], names=["block", "edge", "above"])
