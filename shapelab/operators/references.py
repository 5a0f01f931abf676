"""Foreign keys: fan-out of parents and orphan fraction of children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round6
from .profile import sampled


def fanout(child: DataFrame, fk: str, fraction: float = 1.0) -> DataFrame:
    """Children for each referenced value: mean, p50, p95, max.  A sample takes parents,
    by a hash of the key, and counts all children of each."""
    rows = child.where(F.col(fk).isNotNull())
    if fraction < 1:
        rows = rows.where(sampled(F.col(fk), fraction))
    counts = rows.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("parents"),
        round6(F.avg("n")).alias("mean"),
        round6(F.expr("percentile(n, 0.5)")).alias("p50"),
        round6(F.expr("percentile(n, 0.95)")).alias("p95"),
        F.max("n").alias("max"),
    )


def orphan_fraction(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Share of children whose parent is missing.  Children are counted by key first, so a
    hot key crosses the shuffle once for each task; parents are made distinct, so repeated
    parent keys do not multiply children."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(key).alias("k")).distinct().withColumn("hit", F.lit(1))
    both = counts.join(keys, "k", "left")
    total, lost = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0))
    return both.agg(total.alias("children"), lost.alias("orphans"), round6(F.coalesce(F.try_divide(lost, total), F.lit(0.0))).alias("orphan_fraction"))
