"""Packs of small contents: greedy plans, their cost and locality."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import cut

PACK_TARGET, PACK_MEMBER = 256 * 1024, 32 * 1024


class _Run:
    """Contents of one key in order, by their sizes: where a pack that begins at each
    would end, and what is open after the last."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.limit, n = limit, len(sizes)
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(n)
        self.after = np.maximum(at + 1, np.searchsorted(self.before[1:], self.before[:-1] + limit, "right"))
        self.last, self.packs = at.copy(), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if self.after[i] < n:
                self.last[i], self.packs[i] = self.last[self.after[i]], self.packs[self.after[i]] + 1

    def flush(self, used: int) -> int:
        """The first content that a pack with ``used`` bytes cannot take."""
        return int(np.searchsorted(self.before[1:], self.limit - used, "right"))

    def exit(self, at: int) -> tuple[int, int, int]:
        """Packs that begin at ``at`` and later, and bytes and contents of the last."""
        return int(self.packs[at]), int(self.before[-1] - self.before[self.last[at]]), len(self.last) - int(self.last[at])

    def pieces(self) -> list[tuple[int, int, int, int]]:
        """For each number of bytes that may be open before: (least, packs, bytes, contents),
        packs 0 where all goes into the open one. Starts soon lead to the same packs, so
        there are few."""
        out, n = [], len(self.last)
        for at in range(n + 1):
            least = 0 if at == n else max(0, self.limit - int(self.before[at + 1]) + 1)
            told = self.exit(at) if at < n else (0, int(self.before[-1]), n)
            if out and out[-1][1:] == told and told[0]:
                out[-1] = (least, *told)
            else:
                out.append((least, *told))
            if least == 0 and at < n:
                break
        return out

    def placed(self, state: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pack, slot and offset of each content after ``state`` (pack, bytes, contents)."""
        n, line = len(self.last), np.arange(len(self.last))
        pack, used, slots = state or (-1, 0, 0)
        first = self.flush(used) if slots else 0
        starts, at = [], first
        while at < n:
            starts.append(at)
            at = int(self.after[at])
        which = np.searchsorted(starts, line, "right") - 1
        begin = np.array([*starts, 0])[which]
        own = which < 0
        return np.where(own, pack, pack + 1 + which), np.where(own, slots + line, line - begin), np.where(own, used + self.before[:-1], self.before[:-1] - self.before[begin])


def _runs(part: pd.DataFrame, by: str, size: str, limit: int) -> list[tuple[int, int, _Run]]:
    """The runs of equal ``by`` in a sorted frame: (from, to, run)."""
    code = pd.factorize(part[by], use_na_sentinel=False)[0]
    edge = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(part)]
    sizes = part[size].fillna(0).to_numpy(np.int64)
    return [(a, b, _Run(sizes[a:b], limit)) for a, b in itertools.pairwise(edge)]


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that hold the rows of one range each."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        for p, part in rows.groupby("__p", sort=False):
            if held and held[0]["__p"].iloc[0] != p:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def greedy(items: DataFrame, by: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Fills groups in order under each ``by``: an item that would pass ``limit``
    starts the next group; one that is larger than it stands alone.

    The reset at each overflow makes this a fold, not a running sum. It still goes
    over ranges of the order at once, however many items one ``by`` has: each range
    first tells what it makes of any number of bytes that are open before it (packs
    that begin at different places soon meet, so that is a short list), the driver
    chains these lists, one for each range, and each range is then placed from its
    true beginning. Only sizes and the columns of ``order``, which must be total, take
    part. Adds ``pack``, ``slot`` and ``off``.
    """
    columns = list(dict.fromkeys([by, *order, size]))
    rows = items.select(*columns)
    line = [F.col(by), *[F.col(c) for c in order]]
    ranged = cut(rows.repartitionByRange(*line).withColumn("__p", F.spark_partition_id()))
    dealt = ranged.repartition("__p").sortWithinPartitions("__p", *line)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_range(batches):
            runs = _runs(part, by, size, limit)
            first, last = part[by].iloc[0], part[by].iloc[-1]
            pieces = runs[0][2].pieces() if len(runs) == 1 else []
            yield pd.DataFrame([(int(part["__p"].iloc[0]), repr(first), repr(last), len(runs) == 1, list(runs[-1][2].exit(0)), [list(x) for x in pieces])], columns=["p", "first", "last", "one", "fresh", "pieces"])

    told = dealt.select("__p", by, size).mapInPandas(tell, "p int, first string, last string, one boolean, fresh array<long>, pieces array<array<long>>").collect()
    entry, key, state = {}, None, None
    for r in sorted(told, key=lambda r: r["p"]):
        if state and r["first"] == key:
            entry[r["p"]] = state
        if r["one"] and r["p"] in entry:
            pack, used, slots = state
            _, packs, bytes_, n = max((x for x in r["pieces"] if x[0] <= used), key=lambda x: x[0])
            state = (pack + packs, bytes_ if packs else used + bytes_, n if packs else slots + n)
        else:
            packs, bytes_, n = r["fresh"]
            state = (packs - 1, bytes_, n)
        key = r["last"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_range(batches):
            begin = entry.get(int(part["__p"].iloc[0]))
            placed = [run.placed(begin if a == 0 else None) for a, _, run in _runs(part, by, size, limit)]
            yield part[columns].assign(**{c: np.concatenate(v) for c, v in zip(("pack", "slot", "off"), zip(*placed, strict=True), strict=True)})

    schema = StructType([*rows.schema.fields, *[StructField(c, LongType()) for c in ("pack", "slot", "off")]])
    return dealt.mapInPandas(place, schema)


def amplification(packs: DataFrame, by: list[str], size: str) -> DataFrame:
    """Bytes decoded for bytes wanted when each member is read alone: per ``by`` the
    mean over packs and the worst member."""
    group = packs.groupBy(*by, "pack").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.col(size))).alias("wanted"), F.min(F.greatest(F.lit(1), F.col(size))).alias("least"))
    return group.groupBy(*by).agg(F.count("*").alias("packs"), F.sum(F.col("bytes") * F.col("n")).alias("decoded"), (F.sum(F.col("bytes") * F.col("n")) / F.sum("wanted")).alias("amplification"), F.max(F.col("bytes") / F.col("least")).alias("worst"))


def choose(plans: DataFrame, by: str, budget: float = 8.0, usual: int = 512 * 1024, strict: bool = False) -> DataFrame:
    """The cheapest plan of ``plans(by, plan_limit, cost, amplification)`` within the
    budget; one wider than usual must win a material amount over a usual one that fits.

    ``feasible`` tells where no plan is within the budget and the cheapest of all is
    given; with ``strict`` that is an error. ``independent`` makes the plan that always fits.
    """
    fits = F.col("amplification") <= budget
    rank = F.struct((~fits).alias("over"), "cost", "amplification", "plan_limit")
    some = plans.groupBy(by).agg(F.min(rank).alias("best"), F.min(F.when((F.col("plan_limit") == usual) & fits, F.struct("cost", "amplification", "plan_limit"))).alias("base"))
    stick = F.coalesce(~F.col("best.over") & (F.col("best.plan_limit") > usual) & (F.col("base.cost") - F.col("best.cost") < F.greatest(F.lit(1024), F.floor(F.col("base.cost") / 1000))), F.lit(False))
    pick = lambda c: F.when(stick, F.col(f"base.{c}")).otherwise(F.col(f"best.{c}")).alias(c)
    out = some.select(by, pick("plan_limit"), pick("cost"), pick("amplification"), (~F.col("best.over")).alias("feasible"))
    if strict:
        out = out.withColumn("feasible", F.when(F.col("feasible"), True).otherwise(F.raise_error(F.lit("no plan is within the budget")).cast("boolean")))
    return out


def independent(sizes: DataFrame, by: str, size: str, header: int = 64) -> DataFrame:
    """The plan in which every member is a pack: its amplification is one."""
    return sizes.groupBy(by).agg(F.lit(0).cast("long").alias("plan_limit"), F.sum(F.col(size) + header).cast("long").alias("cost"), F.lit(1.0).alias("amplification"))


def dense(slices: DataFrame, key: str) -> DataFrame:
    """Whether the sorted slices of each pack tile it: no gap, no overlap."""
    line = Window.partitionBy(key).orderBy("off", "len").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.sum("len").over(line), F.lit(0)) == F.col("off")
    return slices.withColumn("fits", fits).groupBy(key).agg((F.every("fits") & (F.max(F.col("off") + F.col("len")) == F.sum("len"))).alias("dense"), F.count("*").alias("members"))
