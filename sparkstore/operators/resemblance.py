"""Similarity sketches, candidate edges and bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import size_bucket
from ..shared import cut

BANDS, SHINGLE = 8, 64
#: Ids that a bucket keeps, and candidates of a target (fixed values).
BUCKET, CANDIDATES, NEAREST = 48, 8, 16
DIGITS = 16


def sketches(nodes: DataFrame, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """``(id, size, size_bucket, band, feature)``: of each band the least hash of the
    shingles that start in it, half a shingle apart; zero for an empty band.

    A feature is the first DIGITS hex digits of a SHA-256, so that text order is
    that of the unsigned number. Positions are bytes. Hashing is JVM-side: one
    array of minima a row, no row for each position.
    """
    n = F.col("size")
    region = F.greatest(F.lit(shingle).cast("long"), F.floor((n + bands - 1) / bands))
    hashed = lambda at, to: F.substring(F.sha2(F.substring("data", at.cast("int") + 1, (to - at).cast("int")), 256), 1, DIGITS)

    def feature(band: int) -> Column:
        start = F.least(n, region * band)
        end = n if band == bands - 1 else F.least(n, region * (band + 1))
        last = F.greatest(start, end - shingle)
        at = F.sequence(start, last, F.lit(max(1, shingle // 2)).cast("long"))
        least = F.array_min(F.transform(at, lambda i: hashed(i, F.least(end, i + shingle))))
        return F.when(start >= end, "0" * DIGITS).otherwise(least)

    told = nodes.select("id", "size", size_bucket(n).cast("long").alias("size_bucket"), F.array(*[feature(b) for b in range(bands)]).alias("f"))
    return told.select("id", "size", "size_bucket", F.posexplode("f").alias("band", "feature"))


def _pairs(rows: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """Pairs (target, earlier base) of equal key and nearly equal size: of each
    probed bucket the ``bucket`` newest bases before the target.

    The bound is kept by ranking inside each bucket first: of a bucket's ids in
    order, a target at rank r of the union meets those of rank r-bucket..r-1, so
    a band join on ranks replaces the join of all with all. Ranks are counted by
    ranges of the ids: the ranges' sums first, then inside each, so that a bucket
    that holds most nodes, as that of the zero feature, is no single window.
    """
    span = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    wide = max(1, ((span[1] or 0) - (span[0] or 0) + 1) // max(1, span[2] >> 14))
    probes = rows.withColumn("probe", F.explode(F.array(*[F.col("size_bucket") + d for d in (-1, 0, 1)])))
    sides = rows.select(*key, F.col("size_bucket").alias("probe"), "id", F.lit(1).alias("base")).unionByName(probes.select(*key, "probe", "id", F.lit(0).alias("base")))
    sides = sides.withColumn("range", F.floor((F.col("id") - (span[0] or 0)) / wide))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sides.groupBy(*key, "probe", "range").agg(F.sum("base").alias("n"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(upto(*key, "probe").orderBy("range")), F.lit(0))).drop("n")
    # bases before each row in its bucket; a base has the number it gets itself
    inside = F.coalesce(F.sum("base").over(upto(*key, "probe", "range").orderBy("id", "base")), F.lit(0))
    ranked = sides.withColumn("inside", inside).join(ahead, [*key, "probe", "range"]).withColumn("before", F.col("ahead") + F.col("inside"))
    bases = ranked.where("base = 1").select(*key, "probe", F.col("id").alias("base_id"), F.col("before").alias("number"))
    targets = ranked.where("base = 0 AND before > 0").select(*key, "probe", F.col("id").alias("target"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("before") - bucket), F.col("before") - 1)).alias("number"))
    return targets.join(bases, [*key, "probe", "number"])


def candidates(sketch: DataFrame, bucket: int = BUCKET, most: int = CANDIDATES) -> DataFrame:
    """``(target, base, shared)``: at most ``most`` earlier nodes for each, by features
    shared in the same band, then by id."""
    met = _pairs(sketch.select("id", "size_bucket", "band", "feature"), ["band", "feature"], bucket)
    shared = met.groupBy("target", F.col("base_id").alias("base")).agg(F.count("*").alias("shared"))
    line = Window.partitionBy("target").orderBy(F.desc("shared"), "base")
    return shared.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most).drop("rank")


def moved_candidates(sketch: DataFrame, bucket: int = BUCKET, most: int = NEAREST) -> DataFrame:
    """As ``candidates``, whatever the band: features that are not zero meet across
    bands; nearer sizes go first among equals."""
    rows = sketch.where(F.col("feature") != "0" * DIGITS).select("id", "size_bucket", "feature").distinct()
    shared = _pairs(rows, ["feature"], bucket).groupBy("target", F.col("base_id").alias("base")).agg(F.count("*").alias("shared"))
    sizes = sketch.groupBy("id").agg(F.max("size").alias("size"))
    near = shared.join(sizes.select(F.col("id").alias("target"), F.col("size").alias("ts")), "target").join(sizes.select(F.col("id").alias("base"), F.col("size").alias("bs")), "base")
    line = Window.partitionBy("target").orderBy(F.desc("shared"), F.abs(F.col("ts") - F.col("bs")), "base")
    return near.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most).select("target", "base", "shared")


def similarity_order(sketch: DataFrame) -> DataFrame:
    """Sort key of each node, that puts similar ones together: ``(id, key)``."""
    return sketch.groupBy("id", "size_bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "feature"))), lambda x: x["feature"]), "").alias("f")).select("id", F.concat(F.lpad(F.col("size_bucket").cast("string"), 3, "0"), F.lit(":"), "f").alias("key"))


def nearest_sizes(nodes: DataFrame, most: int = NEAREST) -> DataFrame:
    """``(target, base)``: for each of ``nodes(id, size)`` the ``most`` earlier ones of nearest
    size, then of least id. For graphs of few nodes, whose caller says so."""
    t, b = nodes.select(F.col("id").alias("target"), F.col("size").alias("ts")), nodes.select(F.col("id").alias("base"), F.col("size").alias("bs"))
    line = Window.partitionBy("target").orderBy(F.abs(F.col("ts") - F.col("bs")), "base")
    return t.join(F.broadcast(b), F.col("base") < F.col("target")).withColumn("r", F.row_number().over(line)).where(F.col("r") <= most).select("target", "base")


def discovered(sketch: DataFrame, few: int = 64) -> DataFrame:
    """``moved_candidates``, and for at most ``few`` nodes also those of nearest size."""
    found = moved_candidates(sketch)
    nodes = sketch.select("id", "size").distinct()
    if nodes.limit(few + 1).count() > few:
        return found
    near = nearest_sizes(nodes).join(found, ["target", "base"], "left_anti").withColumn("shared", F.lit(0).cast("long"))
    return found.unionByName(near)


def central_bases(edges: DataFrame) -> DataFrame:
    """``(target, base, saving)`` of depth one from ``edges(target, base, saving)``.

    Bases have an order: by all they save, the most first, then by id. A base is
    used unless a used one before it has it as a target; each target that is no used
    base goes to the used base that saves most on it, of equal ones to the first.
    Whether a base is used hangs only on those before it that have it as a target,
    so rounds settle all at once: of the undecided those go that a used one reaches,
    and those stay that no undecided one before them reaches. No component of the
    graph has to fit one task.
    """
    edges = cut(edges.where("saving > 0 AND target != base").groupBy("target", "base").agg(F.max("saving").alias("saving")))
    order = edges.groupBy("base").agg((-F.sum("saving")).alias("whole"))
    rank = lambda whole, node: F.struct(F.col(whole).alias("w"), F.col(node).alias("n"))
    own = order.select(F.col("base").alias("target"), F.col("whole").alias("tw"))
    # which earlier base reaches which base
    met = edges.join(order, "base").join(own, "target").where(rank("whole", "base") < rank("tw", "target")).select("base", F.col("target").alias("to"))
    met, open_, used = cut(met), cut(order.select("base")), None
    while open_.limit(1).count():
        waiting = met.select(F.col("to").alias("base")).distinct()
        now = cut(open_.join(waiting, "base", "left_anti"))
        used = now if used is None else used.unionByName(now)
        out = cut(met.join(now, "base", "left_semi").select(F.col("to").alias("base")).distinct())
        done = now.unionByName(out).distinct()
        open_ = cut(open_.join(done, "base", "left_anti"))
        met = met.join(done, "base", "left_anti").join(out.withColumnRenamed("base", "to"), "to", "left_anti")
        met = cut(met.select("base", "to"))
    if used is None:
        return edges.select("target", "base", "saving").limit(0)
    mine = edges.join(used, "base", "left_semi").join(used.withColumnRenamed("base", "target"), "target", "left_anti").join(order, "base")
    best = F.max_by(F.struct("base", "saving"), F.struct("saving", (-F.col("whole")).alias("w"), (-F.col("base")).alias("n")))
    return mine.groupBy("target").agg(best.alias("b")).select("target", "b.base", "b.saving")
