"""Whether a published shape, and the judgement over it, keep the rules of the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import estimate, verdict
from .facts import local

# Types that exist only with an extension.
PROVIDERS = {"citext": "citext", "hstore": "hstore", "ltree": "ltree", "geometry": "postgis", "geography": "postgis", "vector": "vector"}
_FINDING = "code string, severity string, idx int, table_name string, column_name string, message string, depends_on array<string>"


def index_violations(indexes: DataFrame) -> DataFrame:
    """indexes(table_name, name, columns, keys, include) -> (object, rule)."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    at = F.concat_ws(".", "table_name", "name")
    bare = indexes.where((size("columns") <= 0) & (size("keys") <= 0)).select(at.alias("object"), F.lit("an index tells its keys").alias("rule"))
    both = indexes.select(at.alias("index"), F.explode(F.array_intersect("columns", "include")).alias("c"))
    return bare.union(both.select(F.concat_ws(".", "index", "c"), F.lit("payload is no key")))


def type_violations(types: DataFrame, columns: DataFrame) -> DataFrame:
    """types(name, kind, label_count, labels, base), columns(table_name, column_name, data_type)
    -> (object, rule).  A type with a schema before its name is one of the user's."""
    n, m = F.coalesce("label_count", F.lit(0)), F.greatest(F.coalesce(F.size("labels"), F.lit(0)), F.lit(0))
    enum, domain = F.col("kind") == "enum", F.col("kind") == "domain"
    rule = F.when(enum & (n <= 0) & (m == 0), "an enum tells its size").when(enum & (n > 0) & (m > 0) & (n != m), "an enum tells its size").when(domain & (F.coalesce("base", F.lit("")) == ""), "a domain names its base").when(~F.coalesce(enum | domain, F.lit(False)), "a type is an enum or a domain")
    own = types.select(F.concat(F.lit("types."), "name").alias("object"), rule.alias("rule")).where(F.col("rule").isNotNull())
    used = columns.where(F.col("data_type").contains(".")).select(F.concat_ws(".", "table_name", "column_name").alias("object"), F.regexp_replace("data_type", r"\[\]$", "").alias("name"))
    return own.union(used.join(types, "name", "left_anti").select("object", F.lit("used types are defined")))


def extension_violations(columns: DataFrame, extensions: DataFrame) -> DataFrame:
    """columns(table_name, column_name, data_type), extensions(extension) -> (object, rule)."""
    names = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    base = F.lower(F.element_at(F.split(F.regexp_replace(F.trim("data_type"), r"\[\]$", ""), r"\."), -1))
    needs = columns.select(F.concat_ws(".", "table_name", "column_name").alias("object"), names[base].alias("extension")).where(F.col("extension").isNotNull())
    return needs.join(extensions.select("extension"), "extension", "left_anti").select("object", F.lit("needed extensions are declared").alias("rule"))


def validator(spark: SparkSession) -> DataFrame:
    """(object, got): what the judgement makes of a pass on an estimated, a proven and a missing
    fact, and the bucket of some durations.  Only the proven fact may pass."""
    paths = {"estimated": 1, "proven": 3}
    found = local(spark, [("X", "info", i, p, "c", "m", [f"t.{p}.unique"]) for i, p in enumerate([*paths, "missing"])], _FINDING)
    ranks = local(spark, [(f"t.{p}.unique", r) for p, r in paths.items()], "path string, rank int")
    judged = found.select("idx", F.col("table_name").alias("object")).join(verdict.capped(found, ranks).select("idx", "verdict"), "idx", "left")  # a pass leaves no finding
    said = judged.select("object", F.element_at(F.array(*[F.lit(n) for n in verdict.NAMES]), F.coalesce("verdict", F.lit(0)) + 1).alias("got"))
    times = local(spark, [(float(ms),) for ms in (0, 50, 500, 5000, 30000, 120000)], "ms double")
    return said.union(times.select(F.format_string("%d ms", F.col("ms").cast("long")), estimate.bucket(F.col("ms"))))
