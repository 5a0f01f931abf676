"""Classes of text values, decided by shares over all values of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The expressions of the twelve classes.
CLASSES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "ipv6": r"^[0-9a-fA-F:]+:[0-9a-fA-F:]+$",
    "hostname": r"^([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$",
    "phone": r"^\+?[0-9][0-9\s().-]{6,}$",
    "hex": r"^(0x)?[0-9a-fA-F]+$",
    "base64": r"^[A-Za-z0-9+/]+={0,2}$",
    "slug": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?",
    "numeric_string": r"^-?\d+(\.\d+)?$",
}
STRONG = ["email", "url", "uuid", "ipv4", "iso_date"]
WEAK = ["hostname", "numeric_string", "ipv6", "phone", "slug", "hex", "base64"]
DOMINANT, PROSE, ENUM_MOST = 0.95, 0.5, 32


def is_prose(value: Column) -> Column:
    return F.contains(value, F.lit(" ")) & value.rlike("[A-Za-z]")


def class_shares(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One pass: for each column the non-empty values, their share in every class, prose."""
    out = []
    for c in columns:
        v = F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
        share = lambda test, v=v: F.coalesce(F.try_divide(F.sum(F.when(test, 1).otherwise(0)), F.count(v)), F.lit(0.0))
        out.append(F.struct(F.lit(c).alias("column_name"), F.count(v).alias("non_empty"), *[share(v.rlike(p)).alias(k) for k, p in CLASSES.items()], share(is_prose(v)).alias("prose")))
    return df.agg(F.array(*out).alias("x")).select(F.lit(table).alias("table_name"), F.inline("x"))


def format_class(shares: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """The class of each column: the first strong one that dominates, few values, the first
    weak one that dominates, prose, else opaque."""
    rows = shares.join(distinct.select("table_name", "column_name", "distinct_count"), ["table_name", "column_name"], "left") if distinct is not None else shares.withColumn("distinct_count", F.lit(None).cast("long"))
    pick = F.when(F.col("non_empty") == 0, "opaque")
    for k in STRONG:
        pick = pick.when(F.col(k) >= DOMINANT, k)
    pick = pick.when(F.col("distinct_count").between(1, ENUM_MOST), "enum_like")
    for k in WEAK:
        pick = pick.when(F.col(k) >= DOMINANT, k)
    pick = pick.when(F.col("prose") >= PROSE, "free_text").otherwise("opaque")
    return rows.select("table_name", "column_name", pick.alias("format_class"))
