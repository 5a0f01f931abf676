"""Migration scripts from files or folders, by any store Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.statements import statements

# The files by which a migration runner is known, in order.
RUNNERS = [("alembic", "alembic.ini"), ("prisma", "schema.prisma"), ("drizzle", "drizzle.config.ts"), ("rawsql", ".sql")]


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Statements of the .sql files under path, files in order of their names."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.sql").text(path)
    rows = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value").collect()  # a script set is read whole
    return statements(spark, [(r.file, r.value) for r in rows])


def runner(names: list[str]) -> str | None:
    """The migration tool that a folder listing speaks of."""
    for kind, mark in RUNNERS:
        if any(n.endswith(mark) for n in names):
            return kind
    return None


def redact_url(text):
    """Hides user names and passwords of connection strings."""
    url = F.regexp_replace(text, r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@]*@", "$1***@")
    return F.regexp_replace(url, r"(?i)\b(password|user)\s*=\s*('(?:[^'\\]|\\.)*'|\S+)", "$1=***")


def scrub(text):
    """Hides quoted values of error messages."""
    return F.regexp_replace(F.regexp_replace(text, r"'(?:[^']|'')*'", "'***'"), r"\)=\([^)]*\)", ")=(***)")
