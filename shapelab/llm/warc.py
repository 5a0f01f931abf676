"""WARC archives: written by Spark's own writers, read by boundary-chain verification.

Writing.  A page's record holds its html as block.  Of pages with equal payloads
of at least `least` bytes the one with the smallest page_id is a response and the
others are revisits without a block that refer to it.  Files are cut by a number
of records and compressed; they go through Spark's commit protocol to any store.

Reading.  The magic line may stand inside a payload, so a place that looks like a
record need not be one.  Every task splits its part of a file at the magic and
emits candidates, each with the offset where its successor must start by its
header and Content-Length.  Only what the chain from the start of the file
reaches is a record; the chain is followed by pointer jumping: in each round all
reached candidates mark those they jump to, and all jumps double.  Records whose
block holds the magic are put together again from their pieces.

Defined results: a null html is an empty payload; a null url has no target line;
a null page_id is written as `null` and reads as null, and so does one that is no
whole number; rows that repeat page_id and html are written as often, and of equal
payloads all rows with the smallest page_id are responses; payloads of any length
are one record's block; white space and control characters of a url are written as
%20; other columns of pages, whatever their names, are left out; an empty table
reads as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir

MAGIC = "WARC/1.1\r\n"
LEAST_REVISIT = 100
RECORDS_PER_FILE = 1024


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _record(kind: str, date: str):
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: "),
        name("page_id"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("bytes").cast("string"),
    ]
    if kind == "revisit":
        lines += [F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"), F.lit("\r\nContent-Length: 0\r\n\r\n\r\n")]
    else:
        lines += [F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"), F.col("payload"), F.lit("\r\n")]
    return F.concat(*lines).alias("value")


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, per_file: int = RECORDS_PER_FILE, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """pages(page_id, url, html) as WARC files under path."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    slim = rows.select("page_id", "url", "digest", "bytes")
    # The first of each payload that several pages have; only (digest, id) pairs are shuffled.
    first = slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.min("bytes").alias("bytes"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "bytes", "first")
    revisits = cut(slim.join(first, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))))
    # Revisits carry no block, so the pages that do are all but these, found by their own ids.
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"))
    responses = rows.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left_anti")
    records = responses.select(_record("response", date)).union(revisits.select(_record("revisit", date)))
    records.write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the archives cut at every magic line, in order of seq
    within a block and of blocks within a file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _field(name: str):
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _number(text):
    return text.try_cast("long")


def candidates(parts: DataFrame) -> DataFrame:
    """Each piece with its offset and, by its header, the offset of its successor, and what
    a record there would say; blocks leave the task as digests only."""
    from pyspark.sql import Window

    size = F.octet_length("value").cast("long")
    header = F.substring_index("value", "\r\n\r\n", 1)
    rows = parts.withColumn("size", size).withColumn("header", header)
    length = F.when(F.contains(F.col("value"), F.lit("\r\n\r\n")), _number(_field("Content-Length")))
    rows = rows.withColumn("body_at", F.octet_length("header").cast("long") + 4).withColumn("length", F.when(length >= 0, length))
    body = F.substring(F.col("value").cast("binary"), (F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    alone = F.coalesce(F.col("body_at") + F.col("length") + 4 <= F.col("size"), F.lit(False))
    slim = rows.select(
        "file", "block", "seq", "size", "body_at", "length", alone.alias("alone"),
        _field("WARC-Type").alias("kind"),
        _number(F.regexp_extract(_field("WARC-Record-ID"), "<urn:x-page:(-?[0-9]+)>", 1)).alias("page_id"),
        _number(F.regexp_extract(_field("WARC-Refers-To"), "<urn:x-page:(-?[0-9]+)>", 1)).alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1).alias("said"),
        _number(_field("X-Payload-Length")).alias("said_bytes"),
        F.when(alone, F.sha2(body, 256)).alias("digest"),
    )
    before = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    step = len(MAGIC)
    at = F.coalesce(F.sum(F.col("size") + step).over(before), F.lit(0)) - step
    placed = slim.withColumn("at", at)
    follow = F.col("at") + step + F.col("body_at") + F.col("length") + 4
    return placed.withColumn("next", F.when(F.col("at") >= 0, follow))


def reached(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from the start of each file."""
    table = cut(found.where(F.col("at") >= 0).select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")))
    longest = table.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest).bit_length())):
        ahead = table.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        marks = table.where("on").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).where(F.col("at").isNotNull()).distinct()
        step = table.join(ahead, ["file", "jump"], "left").join(marks, ["file", "at"], "left")
        table = cut(step.select("file", "at", F.col("far").alias("jump"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")))
    return table.where("on").select("file", "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    parts = pieces(spark, path)
    found = cut(candidates(parts))
    chain = reached(found)
    records = found.join(chain, ["file", "at"]).where(F.col("length").isNotNull())
    whole = records.where("alone")
    broken = cut(records.where(~F.col("alone")))
    result = whole.select("page_id", "kind", "refers_to", F.col("length").alias("block_bytes"), "digest", "said", "said_bytes")
    if not broken.isEmpty():
        result = result.union(_rejoined(parts, found, chain, broken))
    revisit = F.col("kind") == "revisit"
    return result.select(
        "page_id",
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def _rejoined(parts: DataFrame, found: DataFrame, chain: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose block holds the magic: their pieces are read again and joined.  A piece
    belongs to the last record on the chain that starts at or before it, so one pass over
    the offsets of a file finds the pieces of all its records."""
    from pyspark.sql import Window

    starts = chain.select("file", "at", F.col("at").alias("start"))
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = found.where(F.col("at") >= 0).select("file", "at", "block", "seq").join(starts, ["file", "at"], "left").withColumn("of", F.last("start", ignorenulls=True).over(upto))
    needed = owned.join(broken.select("file", F.col("at").alias("of"), "next"), ["file", "of"]).where(F.col("at") < F.col("next")).select("file", "block", "seq", "at", "of")
    texts = parts.join(needed, ["file", "block", "seq"]).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("all"))
    joined = texts.select("file", F.col("of").alias("at"), F.array_join("all.value", MAGIC).cast("binary").alias("data"))
    body = F.substring(F.col("data"), (F.col("body_at") + 1).cast("int"), F.col("length").cast("int"))
    return broken.drop("digest").join(joined, ["file", "at"]).select("page_id", "kind", "refers_to", F.col("length").alias("block_bytes"), F.sha2(body, 256).alias("digest"), "said", "said_bytes")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What the archives of pages say, read back; the files are removed afterwards."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write(pages, path, **options)
    result = cut(read(spark, path))
    remove_folder(spark, path)
    return result
