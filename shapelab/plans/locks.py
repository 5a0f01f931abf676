"""Table locks: their names and their order of strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lock modes, the weakest first.
MODES = "AccessShareLock RowShareLock RowExclusiveLock ShareUpdateExclusiveLock ShareLock ShareRowExclusiveLock ExclusiveLock AccessExclusiveLock".split()


def strength(mode: Column) -> Column:
    """1 (the weakest) to 8; 0 for a mode that is none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODES]), mode), F.lit(0)).cast("int")


def spoken(mode: Column) -> Column:
    """AccessExclusiveLock -> ACCESS EXCLUSIVE; empty for a mode that is none."""
    words = F.regexp_replace(F.regexp_replace(mode, "Lock$", ""), "(?<=[a-z])(?=[A-Z])", " ")
    return F.when(strength(mode) > 0, F.upper(words)).otherwise("")


def strongest(held: DataFrame) -> DataFrame:
    """held(idx, table_name, mode) -> the strongest lock of each statement; of equal ones that
    on the first table by name."""
    best = F.max_by(F.struct("table_name", "mode"), F.struct(strength(F.col("mode")), -F.col("nth")))
    ranked = held.where(strength(F.col("mode")) > 0).groupBy("idx", "mode").agg(F.min("table_name").alias("table_name"), F.lit(0).alias("nth"))
    return ranked.groupBy("idx").agg(best.alias("b")).select("idx", "b.table_name", "b.mode", spoken(F.col("b.mode")).alias("lock"))
