"""What containers and loose files share: streams, contents, families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that admit a container: repeated inside it, shared with others, found loose;
#: least size of a file that is derived (fixed values).
LOCAL, SHARED, LOOSE, DERIVED = 512 << 10, 32 << 10, 32 << 10, 32 << 10
#: Limits of family packs, and what a wider one must win (fixed values).
FAMILY_LIMITS, FAMILY_WIN, FAMILY_SHARE = tuple(n << 10 for n in (32, 64, 128, 256, 512)), 2048, 0.005


def federate(streams: DataFrame, loose: DataFrame, local: int = LOCAL, shared: int = SHARED, external: int = LOOSE) -> DataFrame:
    """``(container, local_dup, shared, external, admitted)`` of each container of
    ``streams(container, seq, stream, len, content)``; ``loose(path, content)`` are the files.

    A container is taken apart if enough of its streams repeat in it, or stand in
    others too, or hold what is also a loose file. Each stream, and each content,
    counts once for a container.
    """
    own = streams.groupBy("container", "stream").agg(F.max("len").alias("len"), F.count("*").alias("n"))
    spread = own.groupBy("stream").agg(F.count("*").alias("containers"))
    sums = own.join(spread, "stream").groupBy("container").agg(F.sum(F.col("len") * (F.col("n") - 1)).alias("local_dup"), F.sum(F.when(F.col("containers") > 1, F.col("len")).otherwise(0)).alias("shared"))
    first = streams.groupBy("container", "content").agg(F.min_by("len", "seq").alias("len"))
    there = loose.groupBy("content").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    # a file that is the container itself does not count; two paths always hold another
    met = first.join(there, "content").where((F.col("least") != F.col("container")) | (F.col("most") != F.col("container"))).groupBy("container").agg(F.sum("len").alias("external"))
    out = sums.join(met, "container", "left").withColumn("external", F.coalesce("external", F.lit(0)))
    return out.withColumn("admitted", (F.col("local_dup") >= local) | (F.col("shared") >= shared) | (F.col("external") >= external))


def derived(streams: DataFrame, admitted: DataFrame, loose: DataFrame, least: int = DERIVED) -> DataFrame:
    """``(path, stream, csize)``: loose files ``(path, content, size)`` that inflating a stream
    of an admitted container gives: the shortest such stream, of equal ones the first."""
    kept = streams.join(admitted.where("admitted").select("container"), "container", "left_semi").groupBy("content").agg(F.min(F.struct(F.col("len").alias("csize"), "stream")).alias("b"))
    files = loose.where(F.col("size") >= least).join(admitted.where("admitted").select(F.col("container").alias("path")), "path", "left_anti")
    return files.join(kept, "content").select("path", "b.stream", "b.csize")


def family_limits(trials: DataFrame, least_win: int = FAMILY_WIN, share: float = FAMILY_SHARE) -> DataFrame:
    """The pack limit of each family of ``trials(family, members, pack_limit, cost)``: the cheapest,
    of equal ones the smallest, if it wins ``least_win`` bytes and ``share`` over the least
    limit; that one for families of one member."""
    usual = FAMILY_LIMITS[0]
    best = trials.groupBy("family").agg(F.max("members").alias("members"), F.min(F.struct("cost", "pack_limit")).alias("b"), F.min(F.when(F.col("pack_limit") == usual, F.col("cost"))).alias("base"))
    wins = (F.col("members") > 1) & (F.col("base") - F.col("b.cost") >= F.greatest(F.lit(least_win), F.floor(F.col("base") * share)))
    return best.select("family", F.when(F.coalesce(wins, F.lit(False)), F.col("b.pack_limit")).otherwise(usual).cast("long").alias("pack_limit"))
