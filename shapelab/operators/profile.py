"""Facts of tables, from one aggregation over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import round6
from ..plans.facts import local

HISTOGRAM_BUCKETS = 16
SKEW_RATIO = 4.0
ESCALATION_RATIO = 0.95
ESCALATION_ROWS = 50_000_000
RANK = {"exact": 3, "measured": 2, "estimated": 1, "declared": 0, "absent": -1}


def category(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BinaryType):
        return "bytea"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "other"


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union(df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(tables.items()))


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def column_facts(df: DataFrame, table: str) -> DataFrame:
    """One row for each column: counts, null fraction, range, length.  The table is read
    once, whatever its number of columns."""
    rows = F.count("*")
    out = []
    for field in df.schema.fields:
        c, kind = field.name, category(field.dataType)
        text = F.length(c) if kind == "text" else F.octet_length(c) if kind == "bytea" else F.lit(None).cast("int")
        stamp = lambda x: F.date_format(x(c), "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "temporal" else F.lit(None).cast("string")  # noqa: B023, E731
        value = _number(c) if kind == "numeric" else F.lit(None).cast("double")
        out.append(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.lit(kind).alias("category"),
                rows.alias("row_count"),
                F.count(c).alias("non_null"),
                round6(F.coalesce(F.try_divide(rows - F.count(c), rows), F.lit(0.0))).alias("null_fraction"),
                F.min(value).alias("min_value"),
                F.max(value).alias("max_value"),
                round6(F.avg(value)).alias("mean_value"),
                stamp(F.min).alias("min_time"),
                stamp(F.max).alias("max_time"),
                F.min(text).cast("long").alias("min_length"),
                F.max(text).cast("long").alias("max_length"),
                round6(F.avg(text)).alias("mean_length"),
            )
        )
    return df.agg(F.array(*out).alias("facts")).select(F.inline("facts"))


def length_p95(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Nearest-rank 95th percentile of lengths, over every value."""
    facts = [F.struct(F.lit(c).alias("column_name"), F.expr(f"percentile_disc(0.95) within group (order by length({c}))").cast("long").alias("p95")) for c in columns]
    return df.agg(F.array(*facts).alias("f")).select(F.lit(table).alias("table_name"), F.inline("f"))


def distinct_counts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Exact distinct counts, one grouped count for each column: distinct values shuffle
    after a map-side combine, and no row is expanded once for each column."""
    return union(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("non_null")).select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "distinct_count", "non_null") for c in columns)


def uniqueness(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Whether a value repeats, and how many rows are more than the distinct values."""
    counts = distinct_counts(df, table, columns)
    return counts.select("table_name", "column_name", (F.col("distinct_count") == F.col("non_null")).alias("is_unique"), (F.col("non_null") - F.col("distinct_count")).alias("duplicate_rows"))


def should_escalate(distinct: Column, rows: Column, proven: Column, cap: int = ESCALATION_ROWS) -> Column:
    """An estimated distinct count close to the rows, unproven, on a table below the cost
    cap (0: the default; below 0: no cap)."""
    cap = cap or ESCALATION_ROWS
    within = F.lit(True) if cap < 0 else rows <= F.lit(cap)
    return F.coalesce((rows > 0) & (distinct / rows > F.lit(ESCALATION_RATIO)) & ~proven & within, F.lit(False))


def _which(x: Column, edges: list[float], first: int = 0) -> Column:
    """How many of the sorted edges lie below x, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(x > F.lit(edges[mid]), _which(x, edges[mid + 1 :], first + mid + 1)).otherwise(_which(x, edges[:mid], first))


def order_values(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column_no, total, points): the exact values around each share of a column's order.

    Approximate percentiles close around the shares cut the values into a few slots; counts
    of the slots (a row each) tell which slots hold the wanted places, and only the values of
    those, about 0.2 % of the rows for a share, are counted, shuffled and put in order.  The
    places are exact whatever the cuts; what reaches the driver is bounded by the shares."""
    spark = df.sparkSession
    near = sorted({min(max(p + e, 0.0), 1.0) for p in shares for e in (-0.001, 0.001)})
    number = [F.col(c).cast("double") for c in columns]
    cuts = [sorted({v for v in x or () if v == v}) for x in df.agg(*[F.percentile_approx(x, near).alias(f"c{i}") for i, x in enumerate(number)]).first()]
    each = lambda keep: F.array(*[F.struct(F.lit(i).alias("column_no"), x.alias("v"), _which(x, cuts[i]).alias("slot")) for i, x in enumerate(number) if keep is None or keep[i]])
    rows = df.select(F.inline(each(None))).where(F.col("v").isNotNull())
    sizes = {}
    for r in rows.groupBy("column_no", "slot").agg(F.count("*").alias("n")).collect():  # slots of cuts
        sizes.setdefault(r.column_no, []).append((r.slot, r.n))
    wanted, totals = [], []
    for i, slots in sorted(sizes.items()):
        n = sum(k for _, k in slots)
        totals.append((i, n))
        places = sorted({x for p in shares for x in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
        before = 0
        for slot, k in sorted(slots):
            wanted += [(i, slot, before, x) for x in places if before <= x < before + k]
            before += k
    if not wanted:
        return spark.range(0).select(F.lit(0).alias("column_no"), F.lit(0).cast("long").alias("total"), F.create_map().cast("map<bigint,double>").alias("points"))
    at = local(spark, wanted, "column_no int, slot int, base long, place long")
    held = {i: sorted({s for c, s, _, _ in wanted if c == i}) for i in sizes}
    rows = df.select(F.inline(each([i in held for i in range(len(columns))])))
    some = reduce(lambda a, b: a | b, [(F.col("column_no") == i) & F.col("slot").isin(s) for i, s in held.items()])
    counts = rows.where(F.col("v").isNotNull() & some).groupBy("column_no", "slot", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column_no", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto).join(F.broadcast(at), ["column_no", "slot"])  # two places a share
    hit = placed.where((F.col("base") + F.col("upto") > F.col("place")) & (F.col("base") + F.col("upto") - F.col("n") <= F.col("place")))
    points = hit.groupBy("column_no").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("points"))  # two places a share
    return local(spark, totals, "column_no int, total long").join(points, "column_no")


def histogram(df: DataFrame, table: str, columns: list[str], buckets: int = HISTOGRAM_BUCKETS) -> DataFrame:
    """Equi-depth bounds by continuous percentiles, and whether the widths are skewed; a column
    without values has no bounds."""
    shares = [i / buckets for i in range(buckets + 1)]
    names = local(df.sparkSession, list(enumerate(columns)), "column_no int, column_name string")
    at = [(F.col("total") - 1) * F.lit(p) for p in shares]
    point = lambda x: F.element_at("points", x.cast("long"))
    low = [point(F.floor(x)) for x in at]
    bounds = [a + (point(F.least(F.floor(x) + 1, F.col("total") - 1)) - a) * (x - F.floor(x)) for a, x in zip(low, at)]
    rows = names.join(order_values(df, columns, shares).select("column_no", F.array(*bounds).alias("raw")), "column_no", "left")
    widths = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.element_at("raw", (i + 1).cast("int")) - F.element_at("raw", i.cast("int"))))
    rows = rows.withColumn("widths", widths)
    median, most = F.element_at("widths", buckets // 2 + 1), F.element_at("widths", buckets)
    skew = F.when(median <= 0, most > 0).otherwise(F.try_divide(most, median) >= SKEW_RATIO)
    return rows.select(F.lit(table).alias("table_name"), "column_name", F.transform("raw", round6).alias("bounds"), F.coalesce(skew, F.lit(False)).alias("is_skewed"))


def partition_skew(df: DataFrame, table: str, key: Column) -> DataFrame:
    parts = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return parts.agg(F.count("*").alias("partitions"), F.sum("n").alias("row_count"), round6(F.max("n") / F.sum("n")).alias("skew")).select(F.lit(table).alias("table_name"), "partitions", "row_count", "skew")


def value_sets(df: DataFrame, table: str, columns: list[str], most: int = 50) -> DataFrame:
    """Values and their shares for columns of at most `most` distinct values.  Only the
    first most + 1 groups by order are looked at, so a wide column costs no more."""

    def one(c):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
        few = counts.orderBy("value").limit(most + 1)
        total = df.agg(F.count(c).alias("total"))
        grouped = few.agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v")).where(F.col("k") <= most).crossJoin(total)  # one row each
        return grouped.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "total", F.inline("v")).withColumn("frequency", round6(F.col("n") / F.col("total")))

    return union(one(c) for c in columns)


def k_gate(sets: DataFrame, k: int = 20, most: int = 50) -> DataFrame:
    """Which value sets may be published: few values, each held by k rows at least."""
    held = F.round(F.col("frequency") * F.col("total"))
    return sets.groupBy("table_name", "column_name").agg(F.count("*").alias("distinct_count"), F.min(held).cast("long").alias("least"), ((F.count("*") <= most) & (F.min(held) >= k)).alias("allowed"))


def sampled(key: Column, fraction: float) -> Column:
    """A deterministic sample by key: the same rows on every run and in every engine."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long") % 10000 < F.lit(int(fraction * 10000))


def facts_long(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, fact, value, confidence): the facts as one long table."""
    c = column_facts(df, table)
    names = ["non_null", "null_fraction", "min_value", "max_value", "mean_value", "min_length", "max_length", "mean_length"]
    pairs = F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("double").alias("value")) for n in names])
    return c.select("table_name", "column_name", F.inline(pairs)).where(F.col("value").isNotNull()).withColumn("confidence", F.lit("exact"))
