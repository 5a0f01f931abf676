"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes.

A feature is the presence of a byte n-gram (4 to 6 bytes, A-Z lower-cased) in
the whole text, hashed to 2**BITS buckets.  On a bounded sample of labelled rows
the smoothed log ratio of the two classes' document frequencies is taken for
every bucket; the buckets with the largest weight of evidence are kept, each
feature's value is its log ratio, and a logistic regression is fitted on these.

Defined results: null and empty texts score the bias alone; a training set that
lacks one of the classes gives that class's probability as the score of all, one
without rows 0.  Texts of any length are scored whole, block by block; repeated rows
get equal scores, as do texts that hold the same n-grams; buckets of equal evidence
are taken in their order.  A document with labels of both kinds counts under both.
An empty table gives an empty result; other columns pass through, but for one called
score, which the score replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, distinct, lean, lower_ascii, release, row_slices, stash, utf8_view

SIZES = (4, 5, 6)
BITS = 22
SLICE = 4 << 20
BLOCK = 1 << 20
_SALTS = {4: 0x9E3779B97F4A7C15, 5: 0xC2B2AE3D27D4EB4F, 6: 0xD6E8FEB86659FD93}


def present(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, of the buckets that keep marks; n-grams do not
    cross rows.  Works through blocks, so a very long text needs no more memory."""
    pairs = [np.zeros(0, np.int64)]
    most = max(SIZES)
    for a in range(0, len(data), BLOCK):
        n = min(BLOCK, len(data) - a)
        view = np.zeros(n + most - 1, np.uint64)
        piece = lower_ascii(data[a : a + n + most - 1])
        view[: len(piece)] = piece
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, a + n, side="left"))
        cuts = np.clip(offsets[first : last + 1], a, a + n)
        row = np.repeat(np.arange(first, last), np.diff(cuts))
        room = np.repeat(offsets[first + 1 : last + 1], np.diff(cuts)) - np.arange(a, a + n)
        value = np.zeros(n, np.uint64)
        for size in range(1, most + 1):
            value = (value << np.uint64(8)) | view[size - 1 : size - 1 + n]
            if size in SIZES:
                bucket = ((value * np.uint64(_SALTS[size])) >> np.uint64(64 - BITS)).astype(np.int64)
                at = np.flatnonzero(room >= size if keep is None else (keep[bucket] & (room >= size)))
                pairs.append(distinct((row[at] << BITS) | bucket[at]))
    both = distinct(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


def frequency_rows(batches):
    """Document frequencies (bucket, toxic count, clean count) of each Arrow slice."""
    for batch in row_slices(batches, SLICE):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        row, bucket = present(*utf8_view(batch.column("text")))
        ones = np.bincount(bucket, toxic[row], minlength=1 << BITS)
        every = np.bincount(bucket, minlength=1 << BITS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(ones[at].astype(np.int64)), pa.array((every[at] - ones[at]).astype(np.int64))],
            names=["bucket", "toxic", "clean"],
        )


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        if self.weights:
            out[np.fromiter(self.weights, np.int64)] = np.fromiter(self.weights.values(), np.float64)
        return out


def fit(rows, columns, labels, width, ratio, l2=1e-5, rounds=600):
    """Logistic regression on presence times log ratio, by accelerated gradient steps."""
    values = ratio[columns]
    weigh = np.full(len(labels), 1 / max(len(labels), 1))
    norm = np.bincount(rows, values**2, minlength=len(labels)) + 1
    step = 1 / (0.25 * np.sum(weigh * norm) + l2)
    w, b, pw, pb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(1, rounds + 1):
        mom = (t - 1) / (t + 2)
        vw, vb = w + mom * (w - pw), b + mom * (b - pb)
        margin = np.bincount(rows, values * vw[columns], minlength=len(labels)) + vb
        err = weigh * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        gw = np.bincount(columns, values * err[rows], minlength=width) + l2 * vw / 2
        pw, pb = w, b
        w, b = vw - step * gw, vb - step * err.sum()
    return w * ratio, b


def labelled_sample(docs: DataFrame, labels: DataFrame, docs_per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, toxic) of about docs_per_class labelled rows of each class, with no
    text shuffled where Spark finds the table of drawn ids small enough to broadcast, as the
    parameter makes it."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    share = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / sizes.get(1, 1))).otherwise(min(1.0, docs_per_class / sizes.get(0, 1)))
    drawn = stash(labels.where(draw < share))
    sample = stash(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(drawn, "doc_id"))
    release(drawn)
    return sample


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2500, features: int = 3000, least_docs: int = 8, least_z: float = 5.0, seed: int = 11) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic).  docs_per_class bounds the labelled rows.  Of
    their n-grams those that tell the classes apart by chance are left out (fewer than
    least_docs documents, or frequencies less than least_z standard errors apart), and the
    `features` with the most evidence are fitted: with thousands of rows and millions of
    n-grams a fit to all of them learns the sample by heart."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, docs_per_class, seed)
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        release(sample)
        return Model({}, 10.0 if n1 else -10.0)
    p, q = (F.col("toxic") + 1) / F.lit(n1 + 2.0), (F.col("clean") + 1) / F.lit(n0 + 2.0)
    seen = sample.mapInArrow(lean(frequency_rows), "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pooled = (F.col("toxic") + F.col("clean") + 1) / F.lit(n1 + n0 + 2.0)
    z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / max(n1, 1) + 1 / max(n0, 1)))
    rated = seen.where((F.col("toxic") + F.col("clean") >= least_docs) & (z >= least_z)).select("bucket", F.log(p / q).alias("ratio"), (F.abs(p - q) * F.abs(F.log(p / q))).alias("evidence"))
    top = rated.orderBy(F.desc("evidence"), "bucket").limit(features).toArrow()
    chosen, ratio = top["bucket"].to_numpy(), top["ratio"].to_numpy()
    order = np.argsort(chosen)
    chosen, ratio = chosen[order], ratio[order]

    def sparse(batches):
        keep = np.zeros(1 << BITS, bool)
        keep[chosen] = True
        for batch in row_slices(batches, SLICE):
            row, bucket = present(*utf8_view(batch.column("text")), keep)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.searchsorted(chosen, bucket).astype(np.int32)))],
                names=["doc_id", "toxic", "has"],
            )

    kind = dict(sample.dtypes)["doc_id"]
    got = sample.mapInArrow(lean(sparse), f"doc_id {kind}, toxic int, has array<int>").toArrow().sort_by("doc_id")
    release(sample)
    labels = got["toxic"].to_numpy().astype(np.float64)
    has = got["has"].combine_chunks()
    cuts = has.offsets.to_numpy()
    columns = has.values.to_numpy()[cuts[0] : cuts[-1]]
    rows = np.repeat(np.arange(len(labels)), np.diff(cuts))
    weights, bias = fit(rows, columns, labels, len(chosen), ratio)
    return Model({int(c): float(w) for c, w in zip(chosen, weights)}, float(bias))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """All columns of docs but text, and score (0 to 1) in place of a column of that name."""
    weights, bias = model.weights, model.bias
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    carried = [c for c in docs.columns if c not in ("text", "score")]
    rows = docs.select(*carried, F.col("text"))
    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in carried)

    def run(batches):
        weights, bias = shared.value
        table = Model(weights, bias).table()
        keep = table != 0
        for batch in row_slices(batches, SLICE):
            row, bucket = present(*utf8_view(batch.column("text")), keep)
            margin = np.bincount(row, table[bucket], minlength=batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=[*carried, "score"])

    return rows.mapInArrow(lean(run), f"{kinds}{', ' if carried else ''}score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, as they are; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        weights, bias = shared.value
        table = Model(weights, bias).table()
        keep = table != 0
        for batch in row_slices(batches, SLICE):
            row, bucket = present(*utf8_view(batch.column("text")), keep)
            margin = np.bincount(row, table[bucket], minlength=batch.num_rows) + bias
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
