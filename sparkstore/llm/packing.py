"""Packing into optimal length buckets (operator 8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count
from .tokens import token_count

#: Longest piece; longer documents are cut into pieces, so the histogram that
#: comes to the driver has at most so many lengths and one.
MAX_LENGTH = 2048
BUCKETS = 16
#: Length of a batch, padding included.
BATCH_TOKENS = 16384
#: Rows of a shard of a bucket, at least; and batches, at least.
SHARD_ROWS, SHARD_BATCHES = 4096, 8


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in all.

    ``best[j]`` is the least padding of the first j lengths in k buckets; the last
    bucket of an optimum holds lengths i..j-1 and pads them to the longest, and
    what is before is an optimum itself. Ties go to the shorter last start. Memory
    is that of two square arrays over the lengths, 67 MB for MAX_LENGTH.
    """
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    size, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(n)])
    words = np.concatenate([[0], np.cumsum(n * size)])
    far = np.iinfo(np.int64).max // 4
    i, j = np.arange(len(size) + 1)[:, None], np.arange(len(size) + 1)[None, :]
    top = np.concatenate([[0], size])
    pad = np.where(i < j, top[None, :] * (rows[None, :] - rows[:, None]) - (words[None, :] - words[:, None]), far)
    best = np.where(np.arange(len(size) + 1) == 0, 0, far)
    starts = []
    for _ in range(min(buckets, len(size))):
        total = best[:, None] + pad
        starts.append(total.argmin(0))
        best = np.minimum(total.min(0), far)
    at, out = len(size), []
    for start in reversed(starts):
        out.append(int(size[at - 1]))
        at = int(start[at])
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``(doc_id, copy, piece, start, length, bucket, batch, slot)`` for every piece of
    every row of ``docs(doc_id, text)``.

    ``length`` is a row's length (default: the number of its words; null: 0).
    Pieces of at most ``max_length`` cover a row in order, none is dropped; a row
    of length 0 is one empty piece. ``bucket`` is the padded length, chosen by
    ``boundaries`` over the histogram of all pieces. A batch holds pieces of one
    bucket, as many as ``batch_tokens`` allow with padding, at least one. Inside a
    bucket pieces are dealt by a hash of id, copy and piece to shards of a
    bounded number of rows, each of which fills its own batches; only a shard's
    last batch can be short. Rows of one doc_id and length are told apart by
    ``copy``, counted from 0; null ids are ids. Other columns are ignored.
    """
    length = F.coalesce(word_count(F.col("text")) if length is None else length.cast("long"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("all"))
    # equal rows become one with a number, and are told apart without sorting them
    kinds = rows.groupBy("doc_id", "all").agg(F.count("*").alias("m"))
    whole = kinds.groupBy("all").agg(F.sum("m").alias("n"))
    sizes = F.when(F.col("all") <= max_length, F.array(F.struct(F.col("all").alias("length"), F.col("n")))).otherwise(
        F.array(F.struct(F.lit(max_length).cast("long").alias("length"), (F.col("n") * F.floor(F.col("all") / max_length)).alias("n")), F.struct((F.col("all") % max_length).alias("length"), F.when(F.col("all") % max_length > 0, F.col("n")).otherwise(0).alias("n")))
    )
    histogram = whole.select(F.inline(sizes)).groupBy("length").agg(F.sum("n").alias("n")).where("n > 0").orderBy("length").collect()
    lengths, counts = (np.array([r[c] for r in histogram], np.int64) for c in ("length", "n"))
    tops = boundaries(lengths, counts, buckets)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("all") / max_length))
    each = kinds.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    each = each.withColumn("start", F.col("piece") * max_length).withColumn("length", F.least(F.lit(max_length).cast("long"), F.col("all") - F.col("start")))
    bucket, shards, room = F.lit(None).cast("long"), F.lit(1), F.lit(1)
    index = F.lit(0)
    below = -1
    cases = []
    for number, top in enumerate(tops):
        n = int(counts[(lengths > below) & (lengths <= top)].sum())
        fits = max(1, batch_tokens // max(1, top))
        cases.append((number, top, max(1, n // max(SHARD_ROWS, SHARD_BATCHES * fits)), fits))
        below = top
    for number, top, split, fits in reversed(cases):
        own = F.col("length") <= top
        bucket, index = F.when(own, F.lit(top).cast("long")).otherwise(bucket), F.when(own, number).otherwise(index)
        shards, room = F.when(own, split).otherwise(shards), F.when(own, fits).otherwise(room)
    key = F.xxhash64("doc_id", "copy", "piece")
    each = each.select("doc_id", "copy", "piece", "start", "length", bucket.alias("bucket"), index.alias("index"), F.pmod(key, shards).alias("shard"), room.alias("room"), F.xxhash64(key).alias("order"))
    line = Window.partitionBy("index", "shard").orderBy("order", "doc_id", "copy", "piece")
    placed = each.withColumn("rank", F.row_number().over(line) - 1)
    batch = F.col("index").cast("long") * (1 << 50) + F.col("shard").cast("long") * (1 << 20) + F.floor(F.col("rank") / F.col("room"))
    return placed.select("doc_id", "copy", "piece", "start", "length", "bucket", batch.alias("batch"), (F.col("rank") % F.col("room")).cast("long").alias("slot"))


def pack_tokens(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``pack`` with lengths, and so starts, in tokens of the vocabulary file ``tokenizer``.

    ``pack`` reads lengths twice; texts are encoded once, and their counts cut.
    """
    counted = cut(docs.select("doc_id", token_count(docs.sparkSession, F.col("text"), tokenizer).alias("n")))
    return pack(counted, F.col("n"), max_length, buckets, batch_tokens)
