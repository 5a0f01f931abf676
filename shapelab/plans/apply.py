"""What a change would meet in the data: Spark enforces no constraint, so each is a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "idx int, kind string, table_name string, violations long"


def check_rows(statements: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """(idx, kind, table_name, violations) of every statement that the rows can break; a
    statement on an unknown table or column is skipped with null violations.  Statements are
    parsed actions: dicts with idx, kind, table_name, column_name, columns, detail, op, number."""
    out = []
    for s in statements:
        df = tables.get((s.get("table_name") or "").split(".")[-1])
        names = [c for c in [s.get("column_name"), *(s.get("columns") or [])] if c]
        one = None
        if df is not None and all(c in df.columns for c in names):
            one = _violations(s, df, tables)
        if one is None:
            one = _none(df, tables)
        if one is not None:
            out.append(one.select(F.lit(s["idx"]).cast("int").alias("idx"), F.lit(s["kind"]).alias("kind"), F.lit(s.get("table_name")).alias("table_name"), F.col("violations").cast("long").alias("violations")))
    return reduce(DataFrame.union, out)


def _none(df, tables):
    any_df = df if df is not None else next(iter(tables.values()), None)
    return None if any_df is None else any_df.sparkSession.range(1).select(F.lit(None).cast("long").alias("violations"))


def _violations(s: dict, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame | None:
    kind = s["kind"]
    if kind == "set_not_null":
        return df.agg(F.count(F.when(F.col(s["column_name"]).isNull(), 1)).alias("violations"))
    if kind in ("add_unique", "add_primary_key", "create_unique_index"):
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(s["columns"])]
        counts = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s["columns"]])).groupBy(*keys).agg(F.count("*").alias("rows_of_key"))
        return counts.agg(F.count(F.when(F.col("rows_of_key") > 1, 1)).alias("violations"))
    if kind == "add_fk":
        parent = tables.get((s.get("detail") or "").split(".")[-1])
        if parent is None:
            return None
        key = s.get("parent_column") or parent.columns[0]
        counts = df.where(F.col(s["column_name"]).isNotNull()).groupBy(F.col(s["column_name"]).alias("k")).agg(F.count("*").alias("rows_of_key"))
        return counts.join(parent.select(F.col(key).alias("k")).distinct(), "k", "left_anti").agg(F.coalesce(F.sum("rows_of_key"), F.lit(0)).alias("violations"))
    if kind == "add_check" and s.get("op"):
        c, k = F.col(s["column_name"]), F.lit(s["number"])
        holds = {">": c > k, ">=": c >= k, "<": c < k, "<=": c <= k}[s["op"]]
        return df.agg(F.count(F.when(~holds, 1)).alias("violations"))
    return None
