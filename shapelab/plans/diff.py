"""Differences: a schema against the expected one, and a script against a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names that mean the same.
SYNONYMS = {"int": "integer", "int4": "integer", "int8": "bigint", "int2": "smallint", "bool": "boolean", "varchar": "character varying", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "float8": "double precision", "float4": "real", "decimal": "numeric", "bpchar": "character", "char": "character"}


def normal_type(kind: Column) -> Column:
    base = F.trim(F.regexp_extract(F.lower(kind), r"^([^(]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(F.lower(kind), r"(\(.*)$", 1), r"\s", "")
    names = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.concat(F.coalesce(names[base], base), rest)


def drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """expected and live(table_name, column_name, data_type, nullable) -> (object, problem,
    want, got).  A missing table is told once; extra tables are no drift."""
    e_tables, l_tables = expected.select("table_name").distinct(), live.select("table_name").distinct()
    none = F.lit(None).cast("string")
    gone = e_tables.join(l_tables, "table_name", "left_anti").select(F.col("table_name").alias("object"), F.lit("missing table").alias("problem"), none.alias("want"), none.alias("got"))
    e = expected.join(l_tables, "table_name", "left_semi").select("table_name", "column_name", normal_type(F.col("data_type")).alias("want"), F.col("nullable").alias("e_null"))
    n = live.join(e_tables, "table_name", "left_semi").select("table_name", "column_name", normal_type(F.col("data_type")).alias("got"), F.col("nullable").alias("l_null"))
    both = e.join(n, ["table_name", "column_name"], "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("got").isNull(), "missing column"),
            F.when(F.col("want").isNull(), "extra column"),
            F.when(F.col("want") != F.col("got"), "type"),
            F.when(~F.col("e_null") & F.col("l_null"), "nullable"),
        )
    )
    rows = both.select(F.concat_ws(".", "table_name", "column_name").alias("object"), F.explode(problems).alias("problem"), "want", "got")
    return gone.unionByName(rows)


def plan_items(statements: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """statements(idx, kind, table_name, column_name) against tables(table_name) and
    columns(table_name, column_name): ok, conflict or missing-target."""
    t = tables.select("table_name").distinct().withColumn("has_table", F.lit(True))
    c = columns.select("table_name", "column_name").distinct().withColumn("has_column", F.lit(True))
    rows = statements.join(t, "table_name", "left").join(c, ["table_name", "column_name"], "left")
    there, column = F.coalesce("has_table", F.lit(False)), F.coalesce("has_column", F.lit(False))
    needs = F.col("kind").isin("set_not_null", "create_index", "create_unique_index", "add_check", "add_fk", "add_unique", "add_primary_key")
    status = F.when(F.col("kind") == "add_column", F.when(~there, "missing-target").when(column, "conflict").otherwise("ok")).when(needs & ~there, "missing-target").when((F.col("kind") == "drop_table") & ~there, "conflict").otherwise("ok")
    return rows.select("idx", "kind", "table_name", "column_name", status.alias("status"))


def violations(columns: DataFrame) -> DataFrame:
    """What a publisher of facts got wrong: columns(table_name, column_name, category,
    has_range, unique_conf, confidence) -> (object, rule)."""
    rules = F.array_compact(
        F.array(
            F.when((F.col("category") == "text") & F.col("has_range"), "range on text"),
            F.when(F.col("unique_conf").isNotNull() & (F.col("unique_conf") != "exact"), "unique must be exact"),
            F.when(~F.col("confidence").isin("exact", "measured", "estimated", "declared"), "unknown confidence"),
        )
    )
    return columns.select(F.concat_ws(".", "table_name", "column_name").alias("object"), F.explode(rules).alias("rule"))
