"""Foreign keys of generated rows: how many children each parent gets, and which.

The counts of all parents follow from four facts (mean, p50, p95, max).  They are a
DataFrame over parent ordinals; the total is met exactly by water-filling, in closed
form from a histogram of counts, and children find their parent by a range lookup on
cumulative counts.  Nothing the size of the parents reaches the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


@dataclass
class Shape:
    """Fan-out facts with fallbacks: p50 from mean, mean from p50, p95 and max from below."""

    mean: float | None = None
    p50: float | None = None
    p95: float | None = None
    max: float | None = None

    def full(self, children: int, parents: int) -> tuple[float, float, float, float]:
        p50 = self.p50 if self.p50 is not None else self.mean
        mean = self.mean if self.mean is not None else p50
        if mean is None or mean <= 0:
            mean = p50 = children / max(parents, 1)
        p50 = p50 or mean
        p95 = max(self.p95 if self.p95 is not None else p50, p50)
        return mean, p50, p95, max(self.max if self.max is not None else p95, p95)


def _half_up(x: float) -> int:
    return int(x + 0.5)


def plan_rows(declared: int, scale: float = 1.0, cap: int | None = None) -> int:
    """Rows to make: none of an empty table, else the scaled number, at least one."""
    if declared <= 0:
        return 0
    n = max(1, int(declared * (scale if scale > 0 else 1.0)))
    return min(n, cap) if cap else n


def target_counts(spark: SparkSession, children: int, parents: int, declared: int, shape: Shape) -> DataFrame:
    """(rank, n): children of each parent that has any, in ascending order, summing to children."""
    mean, p50, p95, most = shape.full(children, parents)
    used = min(max(_half_up(children / mean), 1), parents)
    whale = min(max(_half_up(most * children / max(declared, 1)), 1), children)
    body = min(max(int(0.95 * used), 0), used - 1)
    q = (F.col("rank") + 0.5) / F.lit(float(max(body, 1)))
    low = max(1.0, 2 * p50 - p95)
    lower = F.lit(low) + (F.lit(p50) - F.lit(low)) * q / 0.5
    upper = F.lit(p50) * F.pow(F.lit(p95 / p50), (q - 0.5) / 0.5)
    raw = F.when(F.col("rank") < body, F.when(q <= 0.5, lower).otherwise(upper)).when(F.col("rank") < used - 1, F.lit(p95)).otherwise(F.lit(float(whale)))
    rows = spark.range(used).withColumnRenamed("id", "rank").withColumn("n", F.greatest(F.lit(1), F.floor(raw + 0.5)).cast("long"))
    return _reconciled(rows, used, children)


def _reconciled(rows: DataFrame, used: int, children: int) -> DataFrame:
    """Meets the total: a deficit goes round the body from the bottom, a surplus is taken
    evenly from the top while a count is above one, and the last parent takes the rest."""
    total = rows.agg(F.sum("n")).first()[0]
    body = used - 1
    if total < children and body:
        each, more = divmod(children - total, body)
        return rows.withColumn("n", F.when(F.col("rank") < body, F.col("n") + each + F.when(F.col("rank") < more, 1).otherwise(0)).otherwise(F.col("n")))
    if total < children:
        return rows.withColumn("n", F.lit(children))
    if total > children:
        surplus = total - children
        # Passes taken off: p whole passes remove sum(min(n - 1, p)); found from the distinct counts.
        sizes = sorted((r[0], r[1]) for r in rows.where(F.col("rank") < body).groupBy("n").count().collect())  # counts take few distinct values
        removed = lambda p: sum(min(n - 1, p) * k for n, k in sizes)
        top = max([n for n, _ in sizes], default=1)
        lo, hi = 0, top
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if removed(mid) <= surplus else (lo, mid - 1)
        left = surplus - removed(lo)
        cut = rows.withColumn("n", F.when(F.col("rank") < body, F.greatest(F.lit(1), F.col("n") - lo)).otherwise(F.col("n")))
        if left:
            open_ = sum(k for n, k in sizes if n - 1 > lo)
            if open_:
                # Counts ascend with rank, so those above one are the last of the body.
                cut = cut.withColumn("n", F.when((F.col("rank") < body) & (F.col("rank") >= body - min(left, open_)) & (F.col("n") > 1), F.col("n") - 1).otherwise(F.col("n")))
                left -= min(left, open_)
            if left:
                cut = cut.withColumn("n", F.when(F.col("rank") >= body, F.greatest(F.lit(1), F.col("n") - left)).otherwise(F.col("n")))
        return cut
    return rows


def cumulative(counts: DataFrame) -> DataFrame:
    """counts with `first`, the number of children before each rank; sums run block by block."""
    blocks = counts.withColumn("block", F.floor(F.col("rank") / BLOCK))
    before = blocks.groupBy("block").agg(F.sum("n").alias("s"))
    starts = before.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "base")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("inner", inner).join(starts, "block").select("rank", "n", (F.col("base") + F.col("inner")).alias("first"))


def orphan_ranks(placed: DataFrame, children: int, fraction: float) -> Column:
    """The smallest groups whose rows make up the fraction; never all of them."""
    return (F.col("first") + F.col("n") <= F.lit(_half_up(children * fraction))) & F.lit(fraction > 0)


def assign(spark: SparkSession, children: int, parents: int, declared: int | None = None, shape: Shape | None = None, orphan_fraction: float = 0.0) -> DataFrame:
    """(child, parent): the parent ordinal of each child; orphans get ordinals from `parents` on."""
    if parents <= 0 or children <= 0:
        return spark.range(0).select(F.col("id").alias("child"), F.lit(None).cast("long").alias("parent"))
    if shape is None:
        lost = _half_up(children * orphan_fraction)
        rows = spark.range(children).withColumnRenamed("id", "child")
        return rows.select("child", F.when(F.col("child") < lost, F.lit(parents) + F.col("child")).otherwise(F.col("child") % parents).alias("parent"))
    placed = cumulative(target_counts(spark, children, parents, declared or children, shape))
    groups = placed.withColumn("parent", F.when(orphan_ranks(placed, children, orphan_fraction), F.lit(parents) + F.col("rank")).otherwise(F.col("rank")))
    # A large group is cut, so that no task makes all children of one parent.
    parts = groups.select("parent", "first", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}"))).alias("part"))
    parts = parts.select("parent", (F.col("first") + F.col("part") * BLOCK).alias("low"), F.least(F.col("first") + F.col("n"), F.col("first") + (F.col("part") + 1) * BLOCK).alias("high"))
    return parts.repartition("low").select(F.explode(F.sequence("low", F.col("high") - 1)).alias("child"), "parent")
