"""The skeleton of JSON columns: paths and leaf types, no values.

Every document is flattened to (path, type) pairs level by level until nothing is left
inside, and the pairs are united over the table; a path that is a leaf in one
document and a container in another is `mixed`, which absorbs everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaf_types(df: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """(path, kind) pairs with their number, of all levels or of the first few;
    unparseable values are left out."""
    doc = F.try_parse_json(F.col(column))
    frontier = df.select(F.lit("$").alias("path"), doc.alias("v")).where(F.col("v").isNotNull())
    out, level = None, 0
    while True:
        kind = F.schema_of_variant("v")
        shape = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
        typed = frontier.withColumn("kind", shape)
        here = typed.groupBy("path", "kind").agg(F.count("*").alias("n"))
        out = here if out is None else out.unionByName(here)
        level += 1
        inner = typed.where(F.col("kind").isin("object", "array"))
        if level == levels or (levels is None and inner.isEmpty()):
            break
        inner.createOrReplaceTempView("shapelab_json_frontier")
        frontier = df.sparkSession.sql(
            "SELECT CASE WHEN kind = 'object' THEN concat(path, '.', key) ELSE concat(path, '[]') END AS path, value AS v "
            "FROM shapelab_json_frontier, LATERAL variant_explode(v)"
        )
    return out.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def skeleton(df: DataFrame, column: str, levels: int | None = None) -> DataFrame:
    """(path, leaf): sorted leaf types joined by a bar; a structural conflict is `mixed`."""
    kinds = leaf_types(df, column, levels).groupBy("path").agg(F.sort_array(F.collect_set("kind")).alias("k"))
    inner = F.exists("k", lambda x: x.isin("object", "array"))
    return kinds.select("path", F.when(inner & (F.size("k") > 1), "mixed").otherwise(F.array_join("k", "|")).alias("leaf"))
