"""Chunk maps, extents and byte ranges over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_chunks, sha
from ..shared import bounded


def chunk_map(members: DataFrame, chunk: int) -> DataFrame:
    """``(path, seq, off, len, sha)`` of the fixed chunks of each member."""
    cut = members.select("path", "data", F.inline(fixed_chunks(F.col("size"), chunk)))
    piece = F.substring("data", F.col("off").cast("int") + 1, F.col("len").cast("int"))
    return cut.select("path", "seq", "off", "len", sha(piece).alias("sha"))


def chunk_dedup(chunks: DataFrame) -> DataFrame:
    each = chunks.groupBy("sha", "len").count()
    return each.agg(F.sum("count").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("len") * F.col("count")).alias("bytes"), F.sum("len").alias("unique_bytes"))


def offsets(parts: DataFrame, key: str, seq: str, length: str) -> DataFrame:
    """Adds each part's offset: the lengths before it under the same key."""
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("off", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def overlaps(extents: DataFrame, requests: DataFrame, key: str, grid: int = 1 << 20) -> DataFrame:
    """Extents that a byte range touches, clipped to it: an interval join inside ``key``.

    ``extents(key, seq, off, len)``, ``requests(key, start, length)``; a range that
    ends past the end is clipped by what there is. Adds ``at`` (where in the
    extent), ``to`` (where in the answer) and ``take`` (bytes). Both sides are joined
    on squares of a ``grid`` that they touch, so many ranges of one member meet its
    extents near them, not all; a pair counts in the first square that both have.
    """
    squares = lambda a, n: F.when(n > 0, F.sequence(F.floor(a / grid), F.floor((a + n - 1) / grid))).otherwise(F.array().cast("array<bigint>"))
    left = extents.withColumn("__g", F.explode(squares(F.col("off"), F.col("len"))))
    right = requests.withColumn("__g", F.explode(squares(F.col("start"), F.col("length"))))
    hit = left.join(right, [key, "__g"]).where((F.col("off") < F.col("start") + F.col("length")) & (F.col("off") + F.col("len") > F.col("start")))
    hit = hit.where(F.col("__g") == F.floor(F.greatest("off", "start") / grid)).drop("__g")
    low, high = F.greatest("off", "start"), F.least(F.col("off") + F.col("len"), F.col("start") + F.col("length"))
    return hit.withColumn("at", low - F.col("off")).withColumn("to", low - F.col("start")).withColumn("take", high - low)


def filled_ranges(extents: DataFrame, requests: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``(key, start, length, seq, hole, at, to, take)``: what a range of a sparse member is made of,
    data and holes in order; a hole is as many zeros. ``sizes(key, size)`` clips a range
    to the member's end. Holes are the gaps between extents and before the end."""
    line = Window.partitionBy(key).orderBy("off", "len")
    gaps_ = extents.select(key, F.coalesce(F.lag(F.col("off") + F.col("len")).over(line), F.lit(0)).alias("a"), F.col("off").alias("b"))
    tail = sizes.join(extents.groupBy(key).agg(F.max(F.col("off") + F.col("len")).alias("a")), key, "left").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.col("size").alias("b"))
    holes = gaps_.unionByName(tail).where("b > a").select(key, F.lit(None).cast("long").alias("seq"), F.col("a").cast("long").alias("off"), (F.col("b") - F.col("a")).cast("long").alias("len"), F.lit(True).alias("hole"))
    both = extents.select(key, F.col("seq").cast("long").alias("seq"), F.col("off").cast("long").alias("off"), F.col("len").cast("long").alias("len"), F.lit(False).alias("hole")).unionByName(holes)
    asked = requests.join(sizes, key).select(key, "start", F.least(F.col("length"), F.greatest(F.lit(0), F.col("size") - F.col("start"))).cast("long").alias("length"))
    return overlaps(both, asked, key).select(key, "start", "length", "seq", "hole", "at", "to", "take")


def read_sparse(plan: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """Bytes of each range of ``filled_ranges`` over ``data(key, seq, data)``."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("take").cast("int")))
    part = F.when(F.col("hole"), zeros).otherwise(F.substring("data", F.col("at").cast("int") + 1, F.col("take").cast("int")))
    pieces = plan.join(data, [key, "seq"], "left").select(key, "start", "length", "to", part.alias("part"))
    return pieces.groupBy(key, "start", "length").agg(F.expr("listagg(part, x'') WITHIN GROUP (ORDER BY to)").alias("data"))


def runs_of_zeros(members: DataFrame, block: int = 4096, least: int = 1 << 20, share: float = 0.75) -> DataFrame:
    """``(path, seq, off, len)`` of the data of members that pay as sparse ones: blocks that are
    not all zero, neighbours joined. Members under ``least`` bytes, or of which ``share`` or
    more is data, have no row: they are kept whole. An all-zero member has one row of
    length 0 at its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["data"], strict=True):
                x = np.frombuffer(data, np.uint8)
                if len(x) < least:
                    continue
                starts = np.arange(0, len(x), block)
                full = np.concatenate([[False], np.add.reduceat(x, starts, dtype=np.int64) > 0, [False]]).astype(np.int8)
                turn = np.flatnonzero(np.diff(full))
                a, b = turn[::2] * block, np.minimum(turn[1::2] * block, len(x))
                if (b - a).sum() < share * len(x):
                    out += [(path, i, p, q - p) for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True))] or [(path, 0, len(x), 0)]
            yield pd.DataFrame(out, columns=["path", "seq", "off", "len"])

    return bounded(members.select("path", "data")).mapInPandas(run, "path string, seq long, off long, len long")


def sparse_hash(extents: DataFrame, sizes: DataFrame, key: str = "path") -> DataFrame:
    """``(key, sha)`` of sparse members ``extents(key, seq, off, len, data)`` of ``sizes(key, size)``:
    extents are streamed in order and holes hashed as zeros that are never made whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zeros, now, h, at, size = bytes(1 << 20), (), None, 0, 0

        def fill(to: int) -> None:
            nonlocal at
            while at < to:
                n = min(len(zeros), to - at)
                h.update(zeros[:n])
                at += n

        for rows in batches:
            out = []
            for k, n, off, data in zip(rows["k"], rows["size"], rows["off"], rows["data"], strict=True):
                if (k,) != now:
                    if h:
                        fill(size)
                        out.append((*now, h.hexdigest()))
                    now, h, at, size = (k,), hashlib.sha256(), 0, int(n)
                fill(int(off))
                h.update(data)
                at += len(data)
            yield pd.DataFrame(out, columns=["k", "sha"])
        if h:
            fill(size)
            yield pd.DataFrame([(*now, h.hexdigest())], columns=["k", "sha"])

    rows = sizes.join(extents, key, "left").select(F.col(key).cast("string").alias("k"), "size", F.coalesce("off", F.lit(0)).alias("off"), F.coalesce("data", F.lit(b"")).alias("data"))
    return bounded(rows.repartition("k").sortWithinPartitions("k", "off")).mapInPandas(run, "k string, sha string").withColumnRenamed("k", key)


def read_ranges(pieces: DataFrame, key: str) -> DataFrame:
    """Bytes of each range of ``overlaps`` with its ``data``, put together in order."""
    part = F.substring("data", F.col("at").cast("int") + 1, F.col("take").cast("int"))
    cut = pieces.select(key, "start", "length", "seq", part.alias("part"))
    return cut.groupBy(key, "start", "length").agg(F.expr("listagg(part, x'') WITHIN GROUP (ORDER BY seq)").alias("data"), F.count("*").alias("touched"))


def gaps(extents: DataFrame, key: str) -> DataFrame:
    """Holes between sorted extents, and overlaps as negative ones."""
    line = Window.partitionBy(key).orderBy("off", "len")
    last = F.max(F.col("off") + F.col("len")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return extents.withColumn("hole", F.col("off") - F.coalesce(last, F.lit(0)))


def recipe_segments(literals: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Alternating literal and payload slices of a container recipe, with offsets:
    ``literals(key, seq, len)`` has one more row than ``payloads(key, seq, len)``."""
    both = literals.select(key, (F.col("seq") * 2).alias("seq"), "len", F.lit("literal").alias("part")).unionByName(payloads.select(key, (F.col("seq") * 2 + 1).alias("seq"), "len", F.lit("payload").alias("part")))
    return offsets(both, key, "seq", "len")
