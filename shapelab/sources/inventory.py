"""Declared structure: constraints, indexes, references, extensions and partitions, from
catalog rows whose keys are column numbers.

A catalog is metadata: thousands of rows.  Its inputs are

    attributes(table_name, number, column_name, data_type)
    constraints(table_name, name, kind, validated, nulls_not_distinct, keys, expression)
    references(table_name, name, keys, parent_table, parent_keys, on_delete, on_update, validated)
    indexes(table_name, name, method, is_unique, predicate, bytes, key_count,
            parts array<struct<number, expression, opclass, descending, nulls_first>>)
    edges(parent, child) and sizes(table_name, rows, bytes) of partitions

and a null opclass is the default one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round6


def estimated_rows(planned: Column) -> Column:
    """The planner's number of rows; one that was never analysed says -1 and counts as 0."""
    return F.greatest(F.coalesce(planned, F.lit(0.0)), F.lit(0.0)).cast("long")


def _named(rows: DataFrame, attributes: DataFrame, table: str, keys: str, out: str) -> DataFrame:
    """rows with `out`, the names of the column numbers in `keys`, in their order."""
    at = attributes.select(F.col("table_name").alias("__t"), F.col("number").alias("__n"), F.col("column_name").alias("__c"))
    each = rows.select(F.col("table_name").alias("__o"), F.col("name").alias("__k"), F.col(table).alias("__t"), F.posexplode(keys).alias("__p", "__n"))
    names = each.join(at, ["__t", "__n"]).groupBy("__o", "__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__c"))), lambda x: x["__c"]).alias(out))  # the keys of one constraint
    return rows.join(names, (F.col("table_name") == F.col("__o")) & (F.col("name") == F.col("__k")), "left").drop("__o", "__k")


def constraint_inventory(constraints: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_name, name, kind, columns, validated, nulls_distinct, expression): a check has an
    expression and no columns; nulls_distinct is told of unique constraints only."""
    kind = F.col("kind")
    rows = _named(constraints, attributes, "table_name", "keys", "columns")
    return rows.select("table_name", "name", "kind", F.when(kind != "check", F.col("columns")).alias("columns"), "validated", F.when(kind == "unique", ~F.coalesce("nulls_not_distinct", F.lit(False))).alias("nulls_distinct"), F.when(kind == "check", F.col("expression")).alias("expression"))


def reference_inventory(references: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row for each pair of columns; the pairs of a composite key share its name."""
    rows = _named(_named(references, attributes, "table_name", "keys", "mine"), attributes, "parent_table", "parent_keys", "theirs")
    pairs = rows.select("table_name", "name", "parent_table", "on_delete", "on_update", "validated", F.inline(F.arrays_zip("mine", "theirs")))
    return pairs.select("table_name", "name", F.col("mine").alias("column_name"), F.concat_ws(".", "parent_table", "theirs").alias("refers_to"), "on_delete", "on_update", "validated")


def index_inventory(indexes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(table_name, name, method, is_unique, columns, keys, include, predicate, bytes).  columns
    are the plain key columns; keys are written as declared and told where one is more than a
    plain column; what stands after key_count is payload and no key."""
    at = attributes.select(F.col("table_name"), F.col("number").alias("part_number"), F.col("column_name"))
    parts = indexes.select("table_name", "name", "key_count", F.posexplode("parts").alias("position", "part")).withColumn("part_number", F.col("part.number"))
    told = parts.join(at, ["table_name", "part_number"], "left")
    base = F.coalesce(F.col("part.expression"), F.col("column_name"))
    down, first = F.coalesce("part.descending", F.lit(False)), F.coalesce("part.nulls_first", F.col("part.descending"), F.lit(False))
    nulls = F.when(down & ~first, " NULLS LAST").when(~down & first, " NULLS FIRST").otherwise("")
    text = F.concat(base, F.coalesce(F.concat(F.lit(" "), F.col("part.opclass")), F.lit("")), F.when(down, " DESC").otherwise(""), nulls)
    told = told.withColumn("is_key", F.col("position") < F.col("key_count")).withColumn("text", text)
    listed = lambda keep, c: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("position", F.col(c).alias("x"))))), lambda p: p["x"])
    key = F.col("is_key")
    each = told.groupBy("table_name", "name").agg(
        listed(key & F.col("part.expression").isNull(), "column_name").alias("columns"),
        listed(key, "text").alias("keys"),
        listed(~key, "column_name").alias("include"),
        F.max(key & (F.col("part.expression").isNotNull() | (F.col("text") != F.col("column_name")))).alias("special"),
    )
    out = indexes.select("table_name", "name", "method", "is_unique", "predicate", "bytes").join(each, ["table_name", "name"])
    return out.select("table_name", "name", "method", "is_unique", "columns", F.when(F.col("special"), F.col("keys")).alias("keys"), "include", "predicate", "bytes")


def required_extensions(uses: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """(extension, schema) that a schema needs: uses(kind, name) of types and operator classes,
    a type standing for its element or base one hop on (types(name, element, base)), and
    members(kind, name, extension, schema).  What is installed and unused is not told."""
    used = uses.where(F.col("kind") == "type").join(types, "name")
    more = used.select(F.lit("type").alias("kind"), F.explode(F.array_compact(F.array("element", "base"))).alias("name"))
    return uses.unionByName(more).join(members, ["kind", "name"]).where(F.col("extension") != "plpgsql").select("extension", "schema").distinct()


def partition_tree(edges: DataFrame) -> DataFrame:
    """(root, table_name, depth): every table below every parent, itself at depth 0."""
    return edges.sparkSession.sql(
        "WITH RECURSIVE tree(root, table_name, depth) AS (SELECT DISTINCT parent, parent, 0 FROM {edges} "
        "UNION ALL SELECT t.root, e.child, t.depth + 1 FROM tree t JOIN {edges} e ON e.parent = t.table_name) SELECT * FROM tree",
        edges=edges,
    )


def partition_facts(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(table_name, partitions, skew, rows, bytes): direct partitions, the share of the largest
    and their rows as the planner has them; bytes of the whole tree."""
    rows = estimated_rows(F.col("rows"))
    direct = edges.join(sizes, F.col("child") == F.col("table_name")).groupBy("parent").agg(F.count("*").alias("partitions"), round6(F.coalesce(F.try_divide(F.max(rows), F.sum(rows)), F.lit(0.0))).alias("skew"), F.sum(rows).alias("rows"))
    below = partition_tree(edges).join(sizes.select("table_name", "bytes"), "table_name").groupBy("root").agg(F.sum("bytes").alias("bytes"))
    return direct.join(below, direct["parent"] == below["root"]).select(F.col("parent").alias("table_name"), "partitions", "skew", "rows", "bytes")
