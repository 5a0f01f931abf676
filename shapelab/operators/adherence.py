"""How far sessions kept the rules of work: describe before writing, validate before asking
for review, and no review asked for over a verdict that is no pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round6


def scored(events: DataFrame) -> DataFrame:
    """events(rule_label, session, seq, type, verdict) -> one row a session.  What a session
    never does, it does not do wrong."""
    kind = F.col("type")
    judged = F.when(kind == "validate", F.coalesce("verdict", F.lit("")))
    before = Window.partitionBy("rule_label", "session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("judged", judged).withColumn("latest", F.last("judged", ignorenulls=True).over(before))
    first = lambda name: F.min(F.when(kind == name, F.col("seq")))
    passed = F.coalesce(F.col("latest") == "PASS", F.lit(False))
    per = rows.groupBy("rule_label", "session").agg(
        first("describe_shape").alias("described"),
        first("write_sql").alias("wrote"),
        first("validate").alias("validated"),
        first("open_pr").alias("asked"),
        F.coalesce(F.min(F.when(kind == "open_pr", passed)), F.lit(True)).alias("no_hand_waved"),
        F.coalesce(F.max(F.col("judged") != "PASS"), F.lit(False)).alias("failed_once"),
        F.max_by("latest", "seq").alias("ended"),
    )
    ordered = lambda a, b: F.col(b).isNull() | F.coalesce(F.col(a) < F.col(b), F.lit(False))
    out = per.select("rule_label", "session", ordered("described", "wrote").alias("describe_first"), ordered("validated", "asked").alias("validate_first"), "no_hand_waved", (F.col("failed_once") & F.coalesce(F.col("ended") == "PASS", F.lit(False))).alias("loop_closed"))
    kept = sum((F.col(c).cast("int") for c in ("describe_first", "validate_first", "no_hand_waved")), F.lit(0))
    return out.withColumn("adherence", kept / F.lit(3.0))


def summary(events: DataFrame) -> DataFrame:
    """(rule_label, sessions, adherence_mean, closure_rate)."""
    return scored(events).groupBy("rule_label").agg(F.count("*").alias("sessions"), round6(F.avg("adherence")).alias("adherence_mean"), round6(F.avg(F.col("loop_closed").cast("double"))).alias("closure_rate"))
