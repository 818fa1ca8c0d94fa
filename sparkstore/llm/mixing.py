"""Mixing sources to target weights by pivotal dependent rounding (operator 1).

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST = 3
#: Documents that one fold of the reduction tree takes.
FAN_IN = 64
#: Equal rows that are numbered in one place.
SALT = 4096
SEED = 17


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """``(source, source_size, n, target)`` of ``sizes(source, source_size, n)``.

    Weights go to sources in code-point order, null last, and repeat. ``share``
    of all sizes is dealt by weight; a target stops at ``most`` times its source,
    and the excess is dealt again to the others, until none is above. All targets
    below their cap are one level times their weight, and the level only rises, so
    each round is one aggregation over the sources. They are numbered by ranges,
    not by one sort of all, as there may be a source for each host.
    """
    placed = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__p", F.spark_partition_id()))
    before, at = {}, 0
    for r in placed.groupBy("__p").count().orderBy("__p").collect():
        before[r["__p"]], at = at, at + r["count"]
    if not before:
        return sizes.select("source", "source_size", "n", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    ahead = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__p"))
    number = ahead + F.row_number().over(Window.partitionBy("__p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (number % len(weights) + 1).cast("int"))
    weighed = cut(placed.select("source", "source_size", "n", weight.alias("weight"), (most * F.col("source_size").cast("double")).alias("cap")))
    level, told = 0.0, None
    while True:
        over = F.col("weight") * level >= F.col("cap")
        sums = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("capped")).first()
        if not sums["open"] or sums["capped"] == told:
            break
        level, told = (share * sums["all"] - (sums["full"] or 0.0)) / sums["open"], sums["capped"]
    return weighed.select("source", "source_size", "n", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def _fold(items: Column, key: Column, seed: int) -> Column:
    """Resolves the fractional items of an array one against another.

    An item has part (its copy probability) and size. The carried item and the
    next exchange words: either as many as fill one of the two or as many as
    empty one of them, with the chance that keeps both expectations. One becomes
    integral and is written out, the other is carried. The array's last is left.
    """

    def step(state: Column, item: Column) -> Column:
        held = state["held"]
        a, b = held["part"] * held["size"], item["part"] * item["size"]
        gain = F.least((1 - held["part"]) * held["size"], b)  # to the held one
        loss = F.least(a, (1 - item["part"]) * item["size"])
        u = F.pmod(F.xxhash64(F.lit(seed), key, held["id"], item["id"], held["size"], item["size"]), F.lit(1 << 40)) / float(1 << 40)
        grows = u * (gain + loss) < loss
        fills, drains = (1 - held["part"]) * held["size"] <= b, a <= (1 - item["part"]) * item["size"]
        # the held item is settled if it is filled or emptied, else the other
        own = F.when(grows, fills).otherwise(drains)
        moved = F.when(grows, gain).otherwise(-loss)
        settled = F.when(own, F.when(grows, 1.0).otherwise(0.0)).otherwise(F.when(grows, 0.0).otherwise(1.0))
        rest = F.when(own, (b - moved) / item["size"]).otherwise((a + moved) / held["size"])
        one = lambda x, part: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["m"].alias("m"), x["whole"].alias("whole"), part.alias("part"))
        done, kept = F.when(own, one(held, settled)).otherwise(one(item, settled)), F.when(own, one(item, rest)).otherwise(one(held, rest))
        return F.struct(kept.alias("held"), F.concat(state["done"], F.array(done)).alias("done"))

    first = F.struct(items[0].alias("held"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def copies(items: DataFrame, stats: DataFrame, seed: int = SEED) -> DataFrame:
    """``(source, id, size, m, source_size, target, copies)``: whole copies in all of
    the ``m`` equal rows of each of ``items(source, id, size, m)``.

    ``stats`` is what ``targets`` gives. A row's expected copies are target over
    source size; the whole part is sure, and the rest is rounded in a tree: each
    level folds groups of about FAN_IN and passes one item of each on, until a
    source has one left. That has no partner and goes to the nearer side, so a
    source misses its target by half a document at most. No level needs more than
    about FAN_IN items in one place, however large the source.
    """
    joined = items.join(stats.select(F.col("source").alias("s"), "source_size", "target", "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    # an item of m equal rows is one of m times the size a row, in copies
    shaped = joined.withColumn("want", F.when(F.col("size") > 0, want).otherwise(0.0)).withColumn("whole", F.floor("want"))
    shaped = shaped.withColumn("part", F.col("want") - F.col("whole")).withColumn("blocks", F.ceil(F.col("n") / FAN_IN))
    shaped = shaped.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("blocks")))
    about = ["source", "source_size", "target"]
    item = F.struct(*[F.col(c) for c in ("id", "size", "m", "whole", "part")])
    sure = shaped.where("part = 0").select(*about, item.alias("x"))
    open_ = shaped.where("part > 0").select(*about, "block", item.alias("x"))
    top = stats.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(1, math.ceil(top / FAN_IN)), FAN_IN) - 1e-9) + 1)
    out = sure
    for level in range(levels):
        grouped = open_.groupBy(*about, "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        key = F.concat_ws("/", F.lit(str(level)), F.col("source"), F.col("block").cast("string"))
        folded = cut(grouped.withColumn("r", _fold(F.col("xs"), key, seed)).select(*about, "block", "r"))
        out = out.unionByName(folded.select(*about, F.explode("r.done").alias("x")))
        open_ = folded.select(*about, F.floor(F.col("block") / FAN_IN).alias("block"), F.col("r.held").alias("x"))
    last = open_.select(*about, F.struct("x.id", "x.size", "x.m", "x.whole", F.round("x.part").alias("part")).alias("x"))
    out = out.unionByName(last)
    return out.select(*about, "x.id", "x.size", "x.m", (F.col("x.whole") + F.round("x.part").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST, seed: int = SEED) -> DataFrame:
    """How often each row of ``docs(doc_id, text, source)`` is taken: ``(doc_id, size,
    source, source_size, target, copies, taken)``, one row for each.

    Size is the number of ASCII-space-separated words, 0 for a null text; such
    rows are never taken. A null source is a source, the last. Equal rows (same
    source, doc_id and size) share the copies of the group as evenly as can be;
    a null doc_id is an id like others. Two runs give equal results. Other
    columns are ignored, and no rows give no rows.
    """
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("id"), word_count(F.col("text")).alias("size"))
    items = cut(rows.groupBy("source", "id", "size").agg(F.count("*").alias("m")))
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    stats = cut(targets(sizes, weights, share, most))
    decided = copies(items, stats, seed)
    each = decided.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    own = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("i") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    each = each.withColumn("copies", own)
    return each.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _before(rows: DataFrame, kind: list[str], bucket: str, order: str, count: str, name: str) -> DataFrame:
    """Adds the sum of ``count`` over the rows of a kind that come before: whole buckets,
    which rise with the order, are summed first, so no window holds a kind."""
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*kind, bucket).agg(F.sum(count).alias("t")).withColumn("ahead", F.coalesce(F.sum("t").over(upto(*kind).orderBy(bucket)), F.lit(0)))
    other = ahead.select(*[F.col(c).alias(f"{c}_") for c in (*kind, bucket)], "ahead")
    both = rows.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*kind, bucket)])
    own = F.coalesce(F.sum(count).over(upto(*kind, bucket).orderBy(order)), F.lit(0))
    return both.withColumn(name, F.col("ahead") + own).drop("ahead", *[f"{c}_" for c in (*kind, bucket)])


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; all columns are kept.

    Rows that share source, doc_id and size are one kind, whose copies are shared
    evenly over its rows; the first ones by hash of their text get one more. Kinds are
    decided without the texts, and sent to them where Spark finds that they are
    few. Null texts, and texts without a word, are never taken; columns may have
    any name; no rows give no rows.
    """
    d, s, n, h, each, rest, at, salt = (fresh(x) for x in ("id", "source", "size", "hash", "each", "rest", "at", "salt"))
    kind = [d, s, n]
    keys = {d: docs["doc_id"].cast("long"), s: docs["source"].cast("string"), n: word_count(docs["text"]), h: F.xxhash64(docs["text"])}
    own = docs.select(*[c.alias(k) for k, c in keys.items()])
    on = lambda side, cs: [keys[c].eqNullSafe(side[c]) for c in cs]
    same = lambda a, b, cs: [a[c].eqNullSafe(b[c]) for c in cs]
    again = lambda df, times: df.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"), F.sum("copies").alias("all")).where("`all` > 0")
    taken = cut(taken.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), "rows", F.floor(F.col("all") / F.col("rows")).alias(each), (F.col("all") % F.col("rows")).alias(rest)))
    even, odd = taken.where((F.col(rest) == 0) & (F.col(each) > 0)).drop("rows", rest), taken.where(F.col(rest) > 0)
    out = again(docs.join(even, on(even, kind)), F.col(each))
    if odd.isEmpty():
        return out
    # kinds of several rows that do not share evenly: their rows are numbered by text
    texts = own.groupBy(*kind, h).agg(F.count("*").alias("m"))
    texts = cut(texts.join(odd.select(*[F.col(c).alias(f"{c}_") for c in kind], "rows", each, rest), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in kind]).select(*kind, h, "m", "rows", each, rest))
    texts = texts.withColumn(at, F.floor((F.col(h) / 2.0**64 + 0.5) * F.ceil(F.col("rows") / SALT)).cast("long"))
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("m"), F.col(rest) - F.col("before")))
    texts = cut(_before(texts, kind, at, h, "m", "before").select(*kind, h, "m", each, more.alias(rest)))
    whole = (F.col(rest) == 0) | (F.col(rest) == F.col("m"))
    sure = texts.where(whole & (F.col(each) + F.col(rest) > 0)).select(*kind, h, (F.col(each) + F.when(F.col(rest) > 0, 1).otherwise(0)).alias(each))
    out = out.unionByName(again(docs.join(sure, on(sure, [*kind, h])), F.col(each)))
    many = fresh("many")
    part = texts.where(~whole).withColumnRenamed("m", many)
    if part.isEmpty():
        return out
    # equal texts, some of which get one more: any of them, numbered in salted buckets
    held = cut(docs.join(part, on(part, [*kind, h])).withColumn(salt, F.monotonically_increasing_id()))
    own = held.select(*kind, h, salt, F.pmod(F.col(salt), F.ceil(F.col(many) / SALT)).alias(at), F.lit(1).alias("one"))
    numbered = _before(own, [*kind, h], at, salt, "one", "before").select(F.col(salt).alias(f"{salt}_"), F.col("before").alias(f"{salt}_b"))
    times = F.col(each) + F.when(F.col(f"{salt}_b") < F.col(rest), 1).otherwise(0)
    both = held.join(numbered, F.col(salt) == F.col(f"{salt}_")).withColumn(f"{each}_", times).where(F.col(f"{each}_") > 0)
    return out.unionByName(again(both, F.col(f"{each}_")))
