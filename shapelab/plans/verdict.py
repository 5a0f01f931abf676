"""From findings to PASS, WARN or FAIL, never stronger than the facts allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import Facts, rank

NAMES = ["PASS", "WARN", "FAIL"]
EXIT = {"PASS": 0, "WARN": 1, "FAIL": 2}


def fact_ranks(facts: Facts) -> DataFrame:
    """(path, rank) of every fact; of several orphan facts of a column the weakest counts."""
    t = facts.tables.select(F.concat_ws(".", "table_name", F.lit("rows")).alias("path"), rank(F.col("rows_conf")).alias("rank"))
    parts = [("null_fraction", "nulls_conf"), ("unique", "unique_conf"), ("range", "range_conf")]
    for name, conf in parts:
        t = t.union(facts.columns.select(F.concat_ws(".", "table_name", "column_name", F.lit(name)), rank(F.col(conf))))
    t = t.union(facts.refs.select(F.concat_ws(".", "table_name", "column_name", F.lit("orphan_fraction")), rank(F.col("orphan_conf"))))
    t = t.union(facts.tables.select("table_name", rank(F.col("rows_conf"))))  # a bare table stands for its rows
    return t.groupBy("path").agg(F.min("rank").alias("rank"))


def wanted():
    return F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warn", 1).when(F.col("severity").isin("info", "") | F.col("severity").isNull(), 0).otherwise(1)


def capped(findings: DataFrame, ranks: DataFrame, ground_truth: bool = False) -> DataFrame:
    """findings with `confidence` (that of the weakest fact each rests on; 3 if none), `weakest`
    (the path of that fact) and `verdict` (0 to 2).  A pass that rests on less than a measurement becomes a warning."""
    numbered = findings.withColumn("row", F.monotonically_increasing_id()).withColumn("row", F.xxhash64("code", "idx", "table_name", "column_name", "message"))
    rests = numbered.select("row", F.explode("depends_on").alias("path")).join(ranks, "path", "left")
    known = F.coalesce("rank", F.lit(-1))
    weakest = rests.groupBy("row").agg(F.min(known).alias("confidence"), F.min_by("path", F.struct(known, "path")).alias("weakest"))
    rows = numbered.join(weakest, "row", "left").withColumn("confidence", F.coalesce("confidence", F.lit(3))).drop("row")
    want = wanted()
    verdict = want if ground_truth else F.when((want == 0) & (F.col("confidence") < 2), 1).otherwise(want)
    rows = rows.withColumn("verdict", verdict)
    lifted = (F.col("severity") == "info") & (F.col("verdict") == 1)
    rows = rows.withColumn("severity", F.when(lifted, "warn").otherwise(F.col("severity")))
    return rows.where(~((F.col("severity") == "info") & (F.col("verdict") == 0)))


def owners(paths: DataFrame, tables: DataFrame) -> DataFrame:
    """(path, table_name, rest) of paths(path): the longest table name that a path begins with,
    by equality with each of its heads, and what follows it."""
    parts = F.split("path", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    found = paths.select("path").distinct().select("path", F.explode(heads).alias("table_name")).join(tables.select("table_name").distinct(), "table_name")
    best = found.groupBy("path").agg(F.max_by("table_name", F.length("table_name")).alias("table_name"))
    return best.select("path", "table_name", F.expr("substring(path, length(table_name) + 2)").alias("rest"))


def resolvable(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """capped rows with `resolve`: the table or column whose facts an exact profile would raise;
    null where the weakest fact is measured already."""
    of = owners(rows.select(F.col("weakest").alias("path")).where(F.col("path").isNotNull()), tables)
    about = F.when(F.col("rest").isin("", "rows"), F.col("owner")).otherwise(F.concat_ws(".", "owner", F.substring_index("rest", ".", 1)))
    found = of.select(F.col("path").alias("weakest"), F.col("table_name").alias("owner"), "rest").select("weakest", about.alias("resolve"))
    return rows.join(found, "weakest", "left").withColumn("resolve", F.when(F.col("confidence") < 2, F.col("resolve")))


def combined(rows: DataFrame, failed: bool = False, timed_out: bool = False) -> DataFrame:
    """One row: the worst verdict, with the floors of a failed or timed-out run."""
    floor = 2 if failed else 1 if timed_out else 0
    return rows.agg(F.greatest(F.coalesce(F.max("verdict"), F.lit(0)), F.lit(floor)).alias("v"), F.count("*").alias("findings")).select(F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("v") + 1).alias("verdict"), F.col("v").alias("exit_code"), "findings")
