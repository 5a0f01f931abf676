"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

1. toxicity: rows scored 0.7 or more go.
2. near_dedup: of each group of near copies the row with the smallest doc_id stays.
   Rows are linked if their sets of five-word shingles share 0.8 of their union or more.
3. substring_dedup: words in 20-word windows that occur earlier are cut out; rows that
   held nothing else go, all other rows stay.
4. decontamination: rows that hold a benchmark item within its edit budget go.
5. bpe: every text becomes token ids that decode to the same bytes.

Null texts count as empty; an empty text is clean.  Empty texts are copies of one
another.  Texts of any length are taken whole.  Rows are judged as rows: rows that
share an id or have none are kept or dropped by their own text, and of rows that
repeat id and text one stays.  Ties go to the smaller id, then to the smaller text
hash.  Empty tables run through.  Extra columns pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.llm import bpe, decontam, neardup, substring, toxicity
from shapelab.llm.common import release, stash
from shapelab.llm.queries import rank_file, table


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score below 0.7; learned from the labels of rows that are left."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages cut from text, and n_chars made true where one was cut."""
    gone = "__words_removed"
    cleaned = substring.remove_repeats(docs, counted=gone)
    cleaned = cleaned.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    return decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes of every row."""
    return bpe.encode_verified(docs, *rank_file())


STAGES = [
    ("toxicity", toxic_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Learned weights and tokenizer patterns have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
