"""How long a change may take: cost models, buckets, calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The model of each operation, the bucket edges in ms, the rebuild rate.
MODELS = {"catalog_only": "constant", "table_rewrite": "linear", "constraint_validation": "linear", "btree_build": "n_log_n", "index_concurrently": "n_log_n"}
EDGES = [(100.0, "instant"), (1000.0, "fast"), (10000.0, "noticeable"), (60000.0, "slow")]
WORST = "outage"
BYTES_PER_MS = 52428.8
LEAST_BASIS_ROWS, MOST_RATIO = 1000, 10_000


def bucket(ms: Column) -> Column:
    out = None
    for edge, name in EDGES:
        out = F.when(ms < edge, name) if out is None else out.when(ms < edge, name)
    return out.otherwise(WORST)


def model(op: Column) -> Column:
    out = None
    for name, kind in MODELS.items():
        out = F.when(op == name, kind) if out is None else out.when(op == name, kind)
    return out.otherwise("linear")


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def predicted_ms(op: Column, basis_rows: Column, basis_ms: Column, declared: Column) -> Column:
    b, ms, d = basis_rows.cast("double"), basis_ms.cast("double"), declared.cast("double")
    line = F.when(b <= 0, ms * d).otherwise(ms * F.try_divide(d, b))
    grow = F.when(b <= 1, ms * d).otherwise(ms * F.try_divide(d * log2(F.greatest(F.lit(2.0), d)), b * log2(F.greatest(F.lit(2.0), b))))
    kind = model(op)
    out = F.when(ms <= 0, 0.0).when(d <= 0, ms).when(kind == "constant", ms).when(kind == "n_log_n", grow).otherwise(line)
    return out * F.when(op == "index_concurrently", 2.0).otherwise(1.0)


def reindex_ms(size: Column) -> Column:
    return F.greatest(F.lit(0.0), size.cast("double") / F.lit(BYTES_PER_MS))


def usable(basis_rows: Column, basis_ms: Column, declared: Column) -> Column:
    """Whether a measured basis may be carried on to the declared rows."""
    near = (basis_rows >= LEAST_BASIS_ROWS) | (declared <= basis_rows * MOST_RATIO)
    return F.coalesce((basis_ms > 0) & (basis_rows > 0) & near, F.lit(False))


def work(op: Column, rows: Column) -> Column:
    n, kind = rows.cast("double"), model(op)
    return F.when(kind == "constant", 1.0).when((kind == "n_log_n") & (n > 1), n * log2(F.greatest(F.lit(1.0), n))).otherwise(n)


def calibrated_ms(op: Column, rows1: Column, ms1: Column, rows2: Column, ms2: Column, declared: Column) -> Column:
    """The line through two measurements at the declared work, never below 0; null where
    both did the same work."""
    w1, w2 = work(op, rows1), work(op, rows2)
    slope = F.try_divide(ms2.cast("double") - ms1.cast("double"), w2 - w1)
    line = F.greatest(F.lit(0.0), slope * work(op, declared) + ms1.cast("double") - slope * w1)
    return F.when(model(op) == "constant", F.greatest(ms1, ms2).cast("double")).when(w1 != w2, line)
