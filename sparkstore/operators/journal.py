"""A store's change journal: replay, generations, checkpoints and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: A full checkpoint replaces the delta when the chain before it is this deep.
CHECKPOINT_DEPTH = 63


def replay(journal: DataFrame, upto: int | None = None) -> DataFrame:
    """Live rows of ``journal(gen, op, path, sha, size)``: of each path the newest put,
    unless a delete is newer. One aggregation that combines before its shuffle."""
    if upto is not None:
        journal = journal.where(F.col("gen") <= upto)
    last = journal.groupBy("path").agg(F.max(F.struct("gen", "op", "sha", "size")).alias("r"))
    return last.where("r.op = 'put'").select("path", "r.gen", "r.sha", "r.size")


def replay_renames(journal: DataFrame, root: str) -> DataFrame:
    """Live rows of ``journal(root, gen, op, path, new_path, sha)`` where paths change.

    Renames move a row to another key, so order matters across paths; each
    ``root`` (a tree whose paths stay inside it) is folded in order, streaming.
    A rename takes the row's place at the new path, as a put there would; a
    delete or rename of what is not there does nothing.
    """
    columns = [root, "gen", "op", "path", "new_path", "sha"]
    line = journal.select(F.col(root).cast("string").alias(root), "gen", "op", "path", "new_path", "sha").repartition(root).sortWithinPartitions(root, "gen")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live = None, {}
        for rows in batches:
            out = []
            for k, gen, op, path, new, sha in rows[columns].itertuples(index=False, name=None):
                if k != key:
                    out += [(key, p, *v) for p, v in live.items()]
                    key, live = k, {}
                if op == "put":
                    live[path] = (gen, sha)
                elif op == "del":
                    live.pop(path, None)
                elif path in live:
                    live[new] = live.pop(path)
            yield pd.DataFrame(out, columns=[root, "path", "gen", "sha"])
        yield pd.DataFrame([(key, p, *v) for p, v in live.items()], columns=[root, "path", "gen", "sha"])

    return line.mapInPandas(run, f"{root} string, path string, gen long, sha string")


def checkpoints(generations: DataFrame, key: str, depth: int = CHECKPOINT_DEPTH) -> DataFrame:
    """Chain depth of each generation under a key, and whether it is a full one."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("gen")) - 1
    at = n % (depth + 1)
    return generations.select(key, "gen", at.cast("long").alias("depth"), (at == 0).alias("full"))


def newest_valid(generations: DataFrame, key: str) -> DataFrame:
    """The newest generation whose whole chain back to a full one is committed."""
    line = Window.partitionBy(key).orderBy("gen")
    chain = F.sum(F.col("full").cast("long")).over(line)
    cut = generations.withColumn("chain", chain)
    bad = F.max(F.when(~F.col("committed"), 1).otherwise(0)).over(Window.partitionBy(key, "chain").orderBy("gen"))
    return cut.withColumn("bad", bad).where("bad = 0 AND chain > 0").groupBy(key).agg(F.max("gen").alias("gen"))


def compact(live: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs that a live row names; the others vanish."""
    return blobs.join(live.select("sha").distinct(), "sha", "left_semi")


def new_blobs(update: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents of an update that the store does not have yet."""
    return update.select("sha", "size").distinct().join(blobs, "sha", "left_anti")


def _followed(steps: DataFrame) -> DataFrame:
    """``(k, to, depth, sound)`` of ``steps(k, to, depth, sound)``, each followed to where its chain ends:
    ``sound`` is true at a step that was given as true, false at a ``to`` that is no ``k``, and stays
    null on the way into a cycle.

    Steps are doubled, and only open ones are taken on: what has come to its end is
    written once. A chain of d steps holds chains of all fewer, so a round in which
    nothing ends is the last, and cycles cost no rounds of their own.
    """
    now = cut(steps)
    ended, open_ = now.where("sound IS NOT NULL"), now.where("sound IS NULL")
    while not open_.isEmpty():
        hop = ended.unionByName(open_).select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("sound").alias("known"), F.lit(True).alias("met"))
        met = F.col("met").isNotNull()
        step = open_.select("k", "to", "depth").join(hop, "to", "left")
        step = cut(step.select("k", F.when(met, F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(met, F.col("known")).otherwise(F.lit(False)).alias("sound")))
        now = step.where("sound IS NOT NULL")
        open_ = step.where("sound IS NULL")
        if now.isEmpty():
            break
        ended = ended.unionByName(now)
    return ended.unionByName(open_)


def closure(links: DataFrame) -> DataFrame:
    """Final target of each ``links(path, target)``, chains of any length: pointers are
    doubled until no target is a path itself. Only rows that run into a cycle have a
    null target."""
    steps = links.select(F.col("path").alias("k"), F.col("target").alias("to"), F.lit(1).cast("long").alias("depth"), F.lit(None).cast("boolean").alias("sound"))
    return _followed(steps).select(F.col("k").alias("path"), F.when(F.col("sound").isNotNull(), F.col("to")).alias("target"))


def chain_depths(generations: DataFrame, most: int = 128) -> DataFrame:
    """``(gen, root, depth, fault)`` of each ``generations(gen, prev, full)``: how many deltas
    lie between it and the full one below it.

    ``fault`` is ``broken`` where a parent is missing, ``cycle`` where the chain comes
    back, ``too_deep`` beyond ``most`` deltas, else null. Parents are doubled as in
    ``closure``, so a chain of any length takes rounds of its logarithm.
    """
    full = F.coalesce("full", F.lit(False))
    steps = generations.select(F.col("gen").alias("k"), F.when(full, F.col("gen")).otherwise(F.col("prev")).alias("to"), F.when(full, 0).otherwise(1).cast("long").alias("depth"), F.when(full, True).when(F.col("prev").isNull(), False).alias("sound"))
    sound = F.col("sound")
    fault = F.when(sound.isNull(), "cycle").when(~sound, "broken").when(F.col("depth") > most, "too_deep")
    return _followed(steps).select(F.col("k").alias("gen"), F.col("to").alias("root"), F.when(sound, F.col("depth")).alias("depth"), fault.alias("fault"))


def recover(generations: DataFrame, most: int = 128) -> int | None:
    """The newest generation that is committed with its whole chain, None if there is none."""
    chain = chain_depths(generations, most).where("fault IS NULL").select("gen")
    bad = generations.where("NOT committed").select(F.col("gen").alias("root"))
    # a chain is whole if no uncommitted generation lies on it: those above one are marked
    marked, grown = cut(bad), -1
    while (n := marked.count()) != grown:
        grown = n
        above = generations.where("NOT full").join(marked.select(F.col("root").alias("prev")), "prev").select(F.col("gen").alias("root"))
        marked = cut(marked.unionByName(above).distinct())
    return chain.join(marked.withColumnRenamed("root", "gen"), "gen", "left_anti").agg(F.max("gen")).first()[0]
