"""Content addressing: intern equal bytes, number blobs, lay them out, count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extension, is_text, sha


def intern(members: DataFrame) -> DataFrame:
    """``(sha, usize, refs, first_path)`` of each distinct content of ``members``."""
    return members.select("path", "size", sha(F.col("data")).alias("sha")).groupBy("sha").agg(F.first("size").alias("usize"), F.count("*").alias("refs"), F.min("path").alias("first_path"))


def running(rows: DataFrame, bucket: Column, order: list[str], value: Column, name: str, what: str = "sum") -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of ``bucket`` and then
    ``order``, without gathering the table in one task.

    ``bucket`` must rise with the order and take a bounded number of values: its
    totals are summed in one small window, the rest inside each bucket.
    """
    b, s = (f"__{c}_{uuid.uuid4().hex[:8]}" for c in "bs")
    rows = rows.withColumn(b, bucket)
    totals = rows.groupBy(b).agg(F.sum(value).alias(s))
    ahead = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(b, F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(s))
    inside = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.join(totals, b).withColumn(name, (F.col(s) + own).cast("long")).drop(b, s)


def layout(blobs: DataFrame, overhead: int = 64) -> DataFrame:
    """Blob numbers and offsets in order of hash: ``(blob_id, sha, usize, refs, off)``."""
    head = F.substring("sha", 1, 3)  # 4096 even buckets: hashes are uniform
    placed = running(blobs, head, ["sha"], F.lit(1).cast("long"), "blob_id")
    return running(placed, head, ["sha"], F.col("usize") + overhead, "off").select("blob_id", "sha", "usize", "refs", "off")


def dedup_report(members: DataFrame, by: str) -> DataFrame:
    """What interning saves, for each value of ``by``."""
    rows = members.select(by, sha(F.col("data")).alias("sha"), "size")
    each = rows.groupBy(by, "sha").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    unique, logical = F.sum("size"), F.sum(F.col("size") * F.col("n"))
    return each.groupBy(by).agg(F.sum("n").alias("logical_files"), logical.alias("logical_bytes"), F.count("*").alias("unique_blobs"), unique.alias("unique_bytes"), (logical - unique).alias("saved_bytes"))


def duplicates(members: DataFrame) -> DataFrame:
    """Contents that stand under several paths."""
    return intern(members).where("refs > 1").select("sha", "usize", "refs", "first_path", (F.col("usize") * (F.col("refs") - 1)).alias("saved"))


def extension_census(members: DataFrame) -> DataFrame:
    """Files and bytes by kind of text and extension, with both totals."""
    rows = members.select(F.when(is_text(F.col("path")), "text").otherwise("other").alias("family"), extension(F.col("path")).alias("ext"), "size")
    rolled = rows.rollup("family", "ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rolled.select(F.coalesce("family", F.lit("*")).alias("family"), F.coalesce("ext", F.lit("*")).alias("ext"), "files", "bytes")


def modal_owner(rows: DataFrame, owner: str, order: str) -> DataFrame:
    """The owner of most rows, of equal ones the first by ``order``: one row."""
    counts = rows.groupBy(owner).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(F.col(owner).alias("common"), "n")
