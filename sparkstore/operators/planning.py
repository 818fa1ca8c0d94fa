"""Plans over measured candidates: residual packs, read amplification, pair fusion,
portfolios, and checks of what a plan may depend on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import cut

#: Extra bytes read for a member of a residual pack, and for a fused pair, at most
#: so many times its own; widest reach of a fusion and its bytes (fixed values).
RESIDUAL_AMP, PAIR_AMP, PAIR_REACH, PAIR_BYTES = 2.0, 8.0, 8, 2 << 20


def residual_packs(programs: DataFrame, limit: int, amp: float = RESIDUAL_AMP, order: str = "target", base: str | None = "base") -> DataFrame:
    """Groups ``programs(base, target, raw, target_len)`` of a base in order of target:
    a group closes before it passes ``limit`` bytes or ``amp`` times its shortest
    target. Adds ``pack``.

    Sorted rows are streamed with what one group needs. A group never goes over a
    bound of 2^20 in the target's number (plan rule), so a base of very many targets
    is spread too; there ``pack`` carries the range in its upper bits. Without
    ``base`` all programs are one sequence.
    """
    key = F.lit(0).cast("long") if base is None else F.col(base)
    rows = programs.select(key.alias("__b"), F.shiftright(F.col(order).cast("long"), 20).alias("__r"), *programs.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pack, used, least = None, 0, 0, 0.0
        for part in batches:
            packs = []
            for b, r, raw, n in zip(part["__b"].tolist(), part["__r"].tolist(), part["raw"].tolist(), part["target_len"].tolist(), strict=True):
                n = float(max(1, n))
                if (b, r) != now:
                    now, pack, used, least = (b, r), r << 40, raw, n
                elif used + raw > limit or (used + raw) / min(least, n) > amp:
                    pack, used, least = pack + 1, raw, n
                else:
                    used, least = used + raw, min(least, n)
                packs.append(pack)
            yield part[columns].assign(pack=packs)

    columns = programs.columns
    schema = StructType([*programs.schema.fields, StructField("pack", LongType())])
    return rows.repartition("__b", "__r").sortWithinPartitions("__b", "__r", order).mapInPandas(run, schema)


def kept_packs(packed: DataFrame, by: list[str], least_members: int = 2, least_net: int = 128, header: int = 64) -> DataFrame:
    """Of packs of programs those that pay: ``(by, members, raw, net)`` with at least
    ``least_members`` and a net gain of ``least_net``: a header a member is saved, one is paid."""
    each = packed.groupBy(*by).agg(F.count("*").alias("members"), F.sum("raw").cast("long").alias("raw"), F.max("target_len").alias("longest"), F.min("target_len").alias("least"))
    net = (F.col("members") - 1) * header
    told = each.select(*by, "members", "raw", net.cast("long").alias("net"), (F.col("raw") / F.greatest(F.lit(1), F.col("least"))).alias("amp"))
    return told.where((F.col("members") >= least_members) & (F.col("net") >= least_net))


def best_limit(tried: DataFrame) -> DataFrame:
    """Of ``tried(pack_limit, net, amp)``, one row for each pack, the limit of most net gain,
    then of least amplification, then the smallest: one row, none if no pack pays."""
    each = tried.groupBy("pack_limit").agg(F.sum("net").cast("long").alias("net"), F.max("amp").alias("amp"), F.count("*").alias("packs"))
    return each.orderBy(F.desc("net"), "amp", "pack_limit").limit(1)


def mosaic_amplification(recipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bytes read for a target that copies from several bases, per byte of it.

    ``recipes(target, base, delta_len, target_len)``, ``nodes(id, pack, pack_bytes)``:
    a pack that holds several of the bases is read once.
    """
    met = recipes.join(nodes.select(F.col("id").alias("base"), "pack", "pack_bytes"), "base").select("target", "pack", "pack_bytes", "delta_len", "target_len").distinct()
    return met.groupBy("target").agg(((F.sum("pack_bytes") + F.max("delta_len")) / F.greatest(F.lit(1), F.max("target_len"))).alias("amplification"), F.count("*").alias("packs"))


def fusion_candidates(records: DataFrame, group: str) -> DataFrame:
    """Pairs of neighbouring ``records(group, pos, bytes, least)`` that may be one: within
    PAIR_REACH places, PAIR_BYTES in all, PAIR_AMP times the shorter's least member."""
    later = records.select(group, F.col("pos").alias("pos2"), F.col("bytes").alias("bytes2"), F.col("least").alias("least2"))
    # an equality on the reached place keeps the join from pairing whole groups
    near = records.withColumn("pos2", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + PAIR_REACH))).join(later, [group, "pos2"])
    total = F.col("bytes") + F.col("bytes2")
    return near.where((total <= PAIR_BYTES) & (total / F.least("least", "least2") <= PAIR_AMP)).select(group, "pos", "pos2", total.alias("total"))


def fuse(pairs: DataFrame, group: str) -> DataFrame:
    """A disjoint choice of ``pairs(group, pos, pos2, gain)``: by gain, then by places, a
    pair is taken unless one before it has one of its records.

    In rounds: a pair that is the first of the open ones at both of its records is
    taken, and all that touch it go. That is the greedy choice, as no pair before it
    can be left; half-sorted gains need few rounds.
    """
    rank = F.struct((-F.col("gain")).alias("g"), "pos", "pos2")
    open_, out = cut(pairs.select(group, "pos", "pos2", "gain")), None
    while open_.limit(1).count():
        ends = open_.select(group, rank.alias("r"), F.explode(F.array("pos", "pos2")).alias("at"))
        first = ends.groupBy(group, "at").agg(F.min("r").alias("r"))
        won = cut(first.groupBy(group, "r").agg(F.count("*").alias("n")).where("n = 2").select(group, F.col("r.pos").alias("pos"), F.col("r.pos2").alias("pos2"), (-F.col("r.g")).alias("gain")))
        out = won if out is None else out.unionByName(won)
        gone = won.select(group, F.explode(F.array("pos", "pos2")).alias("at"))
        for end in ("pos", "pos2"):
            open_ = open_.join(gone.withColumnRenamed("at", end), [group, end], "left_anti")
        open_ = cut(open_.select(group, "pos", "pos2", "gain"))
    return pairs.select(group, "pos", "pos2", "gain").limit(0) if out is None else out


def subset_choice(roots: DataFrame, widths: tuple[int, int] = (2, 4), most: int = 8) -> DataFrame:
    """Every set of 2 to 4 of a target's first ``most`` ``roots(target, rank, base)``: ``(target,
    width, bases array)``, at most 154 for each target."""
    few = roots.where(F.col("rank") < most).select("target", "rank", "base")
    sets = few.select("target", F.col("rank").alias("top"), F.array("base").alias("bases"))
    out = None
    for width in range(2, widths[1] + 1):
        later = few.select("target", F.col("rank").alias("next"), F.col("base").alias("more"))
        sets = sets.join(later, "target").where("next > top").select("target", F.col("next").alias("top"), F.array_append("bases", F.col("more")).alias("bases"))
        if width >= widths[0]:
            told = sets.select("target", F.lit(width).alias("width"), "bases")
            out = told if out is None else out.unionByName(told)
    return out


def best_subset(trials: DataFrame) -> DataFrame:
    """Of ``trials(target, bases, cost, copied)`` the cheapest of each target, then that which
    copies most, then the first bases."""
    rank = F.struct("cost", (-F.col("copied")).alias("c"), "bases")
    return trials.groupBy("target").agg(F.min(rank).alias("b")).select("target", "b.bases", F.col("b.cost").alias("cost"), (-F.col("b.c")).alias("copied"))


def agglomerate(groups: DataFrame, by: str, amp: float = 8.0) -> DataFrame:
    """Pairs of neighbouring pack ``groups(by, pos, bytes, members, least)`` that may merge
    within ``amp`` times the least member, with the header that it saves: ``(by, pos, pos2,
    gain, efficiency)``; ``fuse`` makes the disjoint choice."""
    line = Window.partitionBy(by).orderBy("pos")
    near = groups.withColumn("pos2", F.lead("pos").over(line)).withColumn("b2", F.lead("bytes").over(line)).withColumn("l2", F.lead("least").over(line)).where("pos2 IS NOT NULL")
    total = F.col("bytes") + F.col("b2")
    fits = near.where(total / F.greatest(F.lit(1), F.least("least", "l2")) <= amp)
    return fits.select(by, "pos", "pos2", F.lit(64).cast("long").alias("gain"), (F.lit(64) / total).alias("efficiency"))


def optimistic_floor(trials: DataFrame, direct: DataFrame) -> DataFrame:
    """Least cost of each target by one base at most: ``trials(target, base, cost)`` against
    ``direct(target, cost)``. No plan of single bases can be below it."""
    best = trials.groupBy("target").agg(F.min(F.struct("cost", "base")).alias("b"))
    both = direct.select("target", F.col("cost").alias("d")).join(best, "target", "left")
    wins = F.coalesce(F.col("b.cost") < F.col("d"), F.lit(False))
    return both.select("target", F.when(wins, F.col("b.cost")).otherwise(F.col("d")).alias("cost"), F.when(wins, F.col("b.base")).alias("base"))


def lost_because(plans: DataFrame) -> DataFrame:
    """Why each of ``plans(target, amp, copied, size, gain)`` was turned down, null if it
    stands: its amplification, what it copies, or what it gains, in this order."""
    why = F.when(F.col("amp") > PAIR_AMP, "amplification").when(F.col("copied") * 3 < F.col("size"), "copied").when(F.col("gain") <= F.greatest(F.lit(128), F.floor(F.col("size") / 100)), "gain")
    return plans.withColumn("lost", why)


def totals(plans: DataFrame, by: str) -> DataFrame:
    """Base and candidate bytes of ``plans(by, base, candidate)``, how many got smaller and
    larger, and the rate."""
    better, worse = F.count_if(F.col("candidate") < F.col("base")), F.count_if(F.col("candidate") > F.col("base"))
    return plans.groupBy(by).agg(F.sum("base").cast("long").alias("base"), F.sum("candidate").cast("long").alias("candidate"), better.alias("improved"), worse.alias("regressed"), (F.sum("candidate") / F.sum("base")).alias("ratio"))


def portfolio(plans: DataFrame, by: str, inherited: str) -> DataFrame:
    """The plan of each ``by`` with the fewest bytes; of equal ones the inherited."""
    rank = F.struct("bytes", (F.col("plan") != inherited).alias("new"), "plan")
    return plans.groupBy(by).agg(F.min(rank).alias("b")).select(by, F.col("b.plan").alias("plan"), F.col("b.bytes").alias("bytes"))


def coverage(segments: DataFrame, key: str, size: str) -> DataFrame:
    """Whether the segments of each key are not empty, join up and make its size."""
    line = Window.partitionBy(key).orderBy("off", "len")
    joined = F.coalesce(F.lag(F.col("off") + F.col("len")).over(line), F.lit(0)) == F.col("off")
    return segments.withColumn("ok", joined & (F.col("len") > 0)).groupBy(key).agg((F.every("ok") & (F.sum("len") == F.max(size))).alias("whole"))


def depth_faults(edges: DataFrame, most: int = 4) -> DataFrame:
    """``(target, fault)`` of edges ``(target, base)`` that a depth-one store forbids: a
    base that is a target itself, a base named twice, more than ``most`` bases."""
    chained = edges.join(edges.select(F.col("target").alias("base")).distinct(), "base", "left_semi").select("target", F.lit("base_not_direct").alias("fault"))
    twice = edges.groupBy("target", "base").count().where("count > 1").select("target", F.lit("base_twice").alias("fault"))
    many = edges.groupBy("target").agg(F.count_distinct("base").alias("n")).where(F.col("n") > most).select("target", F.lit("too_many_bases").alias("fault"))
    return chained.unionByName(twice).unionByName(many).distinct()


def update_codec(rows: DataFrame) -> DataFrame:
    """Codec of an update, by the first rule that holds: audio far below raw, then a
    dictionary, then plain, each if it saves over 16 bytes; else raw."""
    audio = F.col("audio") + 32 < F.col("raw") * 0.92
    saves = lambda c: F.col(c) + 16 < F.col("raw")
    codec = F.when(audio, 2).when(saves("dict"), 3).when(saves("plain"), 1).otherwise(0)
    return rows.withColumn("codec", codec.cast("long"))


def unsafe_links(entries: DataFrame) -> DataFrame:
    """Symlinks of ``entries(path, kind, target)`` that may not be made: targets that are
    absolute or step up, and links that are a parent of another path."""
    links = entries.where("kind = 'symlink'")
    bad = links.where(F.col("target").startswith("/") | F.exists(F.split("target", "/"), lambda p: p == "..")).select("path", F.lit("target").alias("fault"))
    parts = F.split("path", "/")
    above = entries.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    return bad.unionByName(links.join(above, "path", "left_semi").select("path", F.lit("parent").alias("fault")))


def extract_plan(entries: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """What an extraction does with ``entries(path, kind, size, target)``, in order: ``(stage,
    path, action)``. Directories come before what they hold, then files, then links to
    files that are there; directories' metadata last. Unsafe links are skipped. Raises
    ValueError if the sizes of all but directories pass ``max_bytes``."""
    if max_bytes is not None:
        total = entries.where("kind != 'dir'").agg(F.sum("size")).first()[0] or 0
        if total > max_bytes:
            raise ValueError(f"{total} bytes are more than the {max_bytes} allowed")
    unsafe = unsafe_links(entries).select("path", F.lit(True).alias("unsafe")).distinct()
    told = entries.select("path", "kind").join(unsafe, "path", "left")
    action = F.when(F.col("unsafe"), "skip").when(F.col("kind") == "dir", "make").when(F.col("kind") == "file", "write").otherwise("link")
    each = told.select("path", action.alias("action"), F.when(F.col("kind") == "dir", 0).when(F.col("kind") == "file", 1).when(F.col("kind") == "hardlink", 2).otherwise(3).alias("stage"))
    after = told.where("kind = 'dir'").select("path", F.lit("metadata").alias("action"), F.lit(4).alias("stage"))
    return each.unionByName(after).select(F.col("stage").cast("long").alias("stage"), "path", "action")


def worth_building(files: F.Column, inherited: F.Column) -> F.Column:
    """Whether the costly plan is tried at all: not for one file whose cheap plan fell back."""
    return ~((files == 1) & inherited)
