"""What a shape document may publish: the privacy matrix and the audit of leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("strict", "standard", "permissive")
# The facts that each level drops; `all` is a column's own redaction.
DROPS = {
    "strict": ["range", "histogram", "values", "frequencies", "labels"],
    "standard": ["values", "frequencies"],
    "permissive": [],
    "all": ["range", "histogram", "values", "frequencies", "length", "shape"],
}
LEAKS = {"range": "standard", "histogram": "standard", "values": "permissive", "frequencies": "permissive"}


def published(facts: DataFrame, level: str, allowed: Column | None = None) -> DataFrame:
    """facts(table_name, column_name, fact, redact) that a level lets through; value sets
    of the permissive level only where allowed (the k gate)."""
    if level not in LEVELS:
        raise ValueError(f"unknown privacy level {level}")
    own = ~(F.coalesce(F.col("redact") == "all", F.lit(False)) & F.col("fact").isin(DROPS["all"]))
    keep = own & ~F.col("fact").isin(DROPS[level]) if DROPS[level] else own
    if level == "permissive" and allowed is not None:
        keep &= ~F.col("fact").isin("values", "frequencies") | F.coalesce(allowed, F.lit(False))
    return facts.where(keep)


def leaks(facts: DataFrame) -> DataFrame:
    """(location, fact, level) of every fact that shows values, in order."""
    level = F.coalesce(*[F.when(F.col("fact") == k, F.lit(v)) for k, v in LEAKS.items()], F.when((F.col("fact") == "length") & (F.col("format_class") == "free_text"), "strict"))
    rows = facts.withColumn("level", level).where(F.col("level").isNotNull())
    return rows.select(F.concat_ws(".", "table_name", "column_name").alias("location"), "fact", "level").orderBy("location", "fact")


def salted_hash(host: Column, salt: str) -> Column:
    """A host as it may be published; loopback names are one host."""
    name = F.lower(F.trim(host))
    name = F.when(name.isin("localhost", "127.0.0.1", "::1", "[::1]"), "localhost").otherwise(F.regexp_replace(name, r"\.$", ""))
    return F.sha2(F.concat(F.lit(salt), name), 256)
