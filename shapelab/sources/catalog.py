"""Structure of tables as DataFrames: names, columns, samples, declared constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round6
from ..operators.profile import category, union

SAMPLE_VALUES, SAMPLE_ROWS, LEAST_SHARE = 500, 20_000, 0.0001


def list_tables(spark: SparkSession, path: str) -> list[str]:
    """Tables of a folder of parquet tables, in order, by the store's own listing."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet") and not n.startswith(("_", ".")))


def columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, data_type, category, nullable)."""
    rows = [(t, i, f.name, f.dataType.simpleString(), category(f.dataType), f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, category string, nullable boolean")


def value_sample(df: DataFrame, table: str, column: str, most: int = SAMPLE_VALUES) -> DataFrame:
    """At most `most` values as text, the same on every run: those with the least hashes."""
    text = F.col(column).cast("string")
    rows = df.where(text.isNotNull()).select(text.alias("value")).withColumn("h", F.sha2("value", 256))
    return rows.orderBy("h").limit(most).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value")


def sample_share(rows: int, target: int = SAMPLE_ROWS) -> float:
    """Share of rows that a sampled scan takes."""
    return 1.0 if rows <= target else max(LEAST_SHARE, target / rows)


def planner_stats(df: DataFrame, table: str, names: list[str], key: str, share: float) -> DataFrame:
    """Null share and approximate distinct count from a hash sample of rows: n_distinct is
    a count, or minus its share of the rows where most values differ."""
    taken = df.where(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000)) if share < 1 else df
    parts = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), round6(F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0))).alias("null_frac"), F.when(F.approx_count_distinct(c, 0.01) > 0.1 * F.count("*"), -F.least(F.lit(1.0), F.approx_count_distinct(c, 0.01) / F.count("*"))).otherwise(F.approx_count_distinct(c, 0.01).cast("double")).alias("n_distinct")) for c in names]
    return taken.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def distinct_from_stats(n_distinct: Column, rows: Column) -> Column:
    """A count, a share of the rows if negative, unknown if 0."""
    return F.when(n_distinct > 0, n_distinct.cast("long")).when(n_distinct < 0, F.floor(-n_distinct * rows + 0.5).cast("long"))


def binary_lengths(df: DataFrame, table: str, names: list[str]) -> DataFrame:
    out = [F.struct(F.lit(c).alias("column_name"), F.min(F.octet_length(c)).cast("long").alias("min_bytes"), F.max(F.octet_length(c)).cast("long").alias("max_bytes"), round6(F.avg(F.octet_length(c))).alias("mean_bytes")) for c in names]
    return df.agg(F.array(*out).alias("x")).select(F.lit(table).alias("table_name"), F.inline("x"))


def proven_unique(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns that a declared key proves unique: a key of one column, or a unique index of one
    plain column without predicate and expressions.  constraints(table_name, kind, columns),
    indexes(table_name, is_unique, columns, expressions, predicate)."""
    keys = constraints.where(F.col("kind").isin("primary_key", "unique") & (F.size("columns") == 1)).select("table_name", F.col("columns")[0].alias("column_name"))
    ix = indexes.where(F.col("is_unique") & (F.size("columns") == 1) & (F.col("expressions") == 0) & F.col("predicate").isNull()).select("table_name", F.col("columns")[0].alias("column_name"))
    return union([keys, ix]).distinct()
