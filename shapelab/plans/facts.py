"""Facts about a schema as normalized DataFrames, with the confidence of each."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

RANKS = {"exact": 3, "measured": 2, "estimated": 1, "declared": 0, "absent": -1}
TABLES = "table_name string, row_count long, rows_conf string"
COLUMNS = "table_name string, column_name string, data_type string, nullable boolean, null_fraction double, nulls_conf string, is_unique boolean, unique_conf string, min_value double, max_value double, range_conf string"
REFS = "table_name string, column_name string, parent_table string, parent_column string, on_delete string, fan_mean double, fan_max double, orphan_fraction double, orphan_conf string"
INDEXES = "table_name string, index_name string, bytes long, bloat double"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local table: Spark knows its size and runs no job to read it."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


def again(df: DataFrame) -> DataFrame:
    """The few rows of df as a local table, so that what reads them runs no joins again."""
    return df.sparkSession.createDataFrame(df.toArrow())


def rank(confidence: Column) -> Column:
    out = None
    for name, value in RANKS.items():
        out = F.when(confidence == name, value) if out is None else out.when(confidence == name, value)
    return out.otherwise(-1)


@dataclass
class Facts:
    tables: DataFrame
    columns: DataFrame
    refs: DataFrame
    indexes: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, tables=(), columns=(), refs=(), indexes=()) -> Facts:
        """Rows as dicts of the fields above; what is missing is null."""
        frame = lambda rows, schema: local(spark, [tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema)
        return cls(frame(tables, TABLES), frame(columns, COLUMNS), frame(refs, REFS), frame(indexes, INDEXES))

    def exact(self) -> Facts:
        """All facts as ground truth, ranges included."""
        raised = lambda df, *names: df.withColumns({n: F.when(F.col(n).isNotNull(), F.lit("exact")) for n in names})
        return Facts(raised(self.tables, "rows_conf"), raised(self.columns, "nulls_conf", "unique_conf", "range_conf"), raised(self.refs, "orphan_conf"), self.indexes)


def resolve(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """statements with `known`, the full table name: the exact one, else the only one whose
    unqualified name it is."""
    names = tables.select(F.col("table_name").alias("full"), F.element_at(F.split("table_name", r"\."), -1).alias("short"))
    lone = names.groupBy("short").agg(F.count("*").alias("n"), F.first("full").alias("only")).where("n = 1").select("short", "only")
    both = statements.join(names.select("full").distinct(), F.col("table_name") == F.col("full"), "left").join(lone, F.col("table_name") == F.col("short"), "left")
    return both.withColumn("known", F.coalesce("full", "only")).drop("full", "short", "only")
