"""Exact checks and completion of operator 4 at a likeness of word shingles.

Two texts are alike if the sets of their SHINGLE-word shingles have a Jaccard
likeness of 4/5 or more. Fingerprints of such texts can differ in more bits than
covering masks can reach, so what they miss is found here: under one order of
all shingles, the first n // 5 + 1 of n of one text and those of the other share
a shingle, so texts that meet nowhere there need no comparison. No pair is lost
by that, and none is taken without being counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, look_up, named_only, short_batches
from .orderminhash import _mix

SHINGLE = 5
#: Texts, about, that are looked at for common shingles; how often such a one
#: occurs there at least; and how many are told. They go last in the order, so
#: that few texts meet by them; which they are changes the work, not the result.
SAMPLE, COMMON, TOLD = 2048, 4, 1 << 13
#: Bits of the largest bitmap of a set.
MOST_BITS = 1 << 16
#: Pairs of two parts that are asked in the first round, and times as many in the next.
QUOTA, GROWS = 4, 8


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of fewer words the whole is the only one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(shingle, len(words))
    if not span:
        return h
    out = np.zeros(len(h) - span + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(span):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def bitmap(g: np.ndarray) -> bytes:
    """Which of about four times as many bits as shingles their hashes hit; MOST_BITS at most."""
    size = min(MOST_BITS, 1 << max(6, (4 * len(g)).bit_length()))
    bits = np.zeros(size, bool)
    bits[(g & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether the bitmaps of sets of n and m leave room for a likeness of 4/5.

    A bit of one set that the other has not stands for a shingle that it has not, at
    least; a larger bitmap is folded to the size of the other. Never false for alike sets.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    missed = lambda v, w: int(np.bitwise_count(v & ~w).sum())
    need = -(-4 * (n + m) // 9)
    return n - missed(x, y) >= need and m - missed(y, x) >= need


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard likeness of 4/5 or more; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def common(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Common shingles of a sample of the texts, the rarer first."""

    @F.pandas_udf("array<long>")
    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series([grams(t, shingle).view(np.int64) for t in texts], dtype=object)

    share = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0)
    often = some.select(F.explode(listed("text")).alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    top = often.orderBy(F.desc("count"), "h").limit(TOLD).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def simhash(g: np.ndarray) -> np.int64:
    """SimHash of distinct shingles: the bits set in over half of their hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(g), 1 << 16):
        count += np.unpackbits(g[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(count * 2 > len(g), bitorder="little").view(np.int64)[0]


def marked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, t, s, n, fp, first, bits)`` of each row: hashes of its text and of its set,
    the set's size, its SimHash, its first n // 5 + 1 shingles and its bitmap."""
    short_batches(docs.sparkSession)
    last = common(docs, shingle)
    by_hash = np.argsort(last)
    told = docs.sparkSession.sparkContext.broadcast((last[by_hash], by_hash + 1))

    @F.pandas_udf("s long, n long, fp long, first array<long>, bits binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        values, rank = told.value
        out = []
        for text in texts:
            g = grams(text, shingle)
            first = g
            if len(values) and len(g):
                at = np.minimum(np.searchsorted(values, g), len(values) - 1)
                first = g[np.argsort(np.where(values[at] == g, rank[at], 0), kind="stable")]
            kept = first[: len(g) // 5 + 1].view(np.int64)
            out.append((np.uint64(xxhash.xxh64_intdigest(g.tobytes())).view(np.int64), len(g), simhash(g), kept, bitmap(g)))
        return pd.DataFrame(out, columns=["s", "n", "fp", "first", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), sets("text").alias("m")).select("doc_id", "t", "m.*")


def confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of ``pairs(a, b)`` of text hashes whose texts are alike; the bitmaps of
    ``sets(t, n, bits)`` are asked first, so that few texts have to meet."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(*x) for x in zip(a, b, n, m, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([alike(grams(x, shingle), grams(y, shingle)) for x, y in zip(left, right, strict=True)], dtype=bool)

    short_batches(docs.sparkSession)
    # cut first, so that the few texts that the pairs name go to the sets and not the sets to them
    pairs = cut(pairs)
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    asked = named_only(sets.select("t", "n", "bits"), "t", named)
    maps = [asked.select(F.col("t").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab"]
    pairs = cut(pairs.join(maps[0], "a").join(maps[1], "b").where(may("bits_a", "bits_b", "n_a", "n_b")).select("a", "b"))
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    texts = cut(named_only(docs.select(F.xxhash64("text").alias("t"), "text"), "t", need).dropDuplicates(["t"]))
    left, right = (texts.select(F.col("t").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(same("text_a", "text_b")).select("a", "b"))


def _sizes(x: str, y: str):
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _may(x: str, y: str):
    """Whether sizes, and what follows a shared shingle, leave room for 4/5."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n - F.col(f"{x}.i"), m - F.col(f"{y}.i"))
    return _sizes(x, y) & (9 * most >= 4 * (n + m))


def _enough(n: Column, m: Column, both: Column) -> Column:
    """Whether two sets that share ``both`` of their first shingles can be alike.

    Alike sets share at least o = 4/9 (n + m). Of the two lists of first shingles one
    ends before the other in the order; each of its p that the other set has is among
    the other's first ones too, and at most n - o of them are not in that set. So at
    least p - (n - o) are shared, for one set or for the other.
    """
    o = F.ceil(4 * (n + m) / 9)
    first = lambda k: F.floor(k / 5) + 1 - k
    return both >= F.least(first(n), first(m)) + o


def joined(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(node, root)`` of the parts that the alike ones of ``pairs(a, b, ra, rb)`` connect;
    ra and rb are the parts of a and b so far.

    Two groups of near copies may have a pair for each two of their members, most of
    which would tell the same. So pairs are asked in rounds: of each two parts that are
    still apart at most QUOTA, by hash, and GROWS times as many in each later round;
    pairs inside a part are asked no more. Once no more are left than were asked,
    all of them are. So each pair is asked, or others have joined its ends before.
    """
    left, edges, asked, quota = cut(pairs.select("*", F.col("ra").alias("pa"), F.col("rb").alias("pb"))), None, 0, QUOTA
    while (many := left.count()) or edges is None:
        now = left.select("a", "b", "ra", "rb")
        if many > asked:
            lot = [F.least("pa", "pb"), F.greatest("pa", "pb"), F.pmod(F.xxhash64(F.lit(quota), "a", "b"), F.lit(quota))]
            now = cut(left.groupBy(*lot).agg(F.min(F.struct("a", "b", "ra", "rb")).alias("x")).select("x.*"))
        asked, quota = asked + now.count(), quota * GROWS
        found = confirmed(docs, sets, now.select("a", "b"), shingle).join(now, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = cut(found if edges is None else edges.unionByName(found))
        parts = cut(components(edges))
        left = left.select("a", "b", "ra", "rb").join(now.select("a", "b"), ["a", "b"], "left_anti")
        sizes = left.select(F.explode(F.array("ra", "rb")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        known = cut(sizes.join(parts, "node"))
        for end in "ab":
            left = look_up(left, f"r{end}", known.select(F.col("node").alias(f"r{end}"), F.col("root").alias(f"p{end}"), "n"), f"p{end}", many, "b" if end == "a" else "a")
        left = cut(left.select("a", "b", "ra", "rb", F.coalesce("pa", "ra").alias("pa"), F.coalesce("pb", "rb").alias("pb")).where("pa != pb"))
    return parts


def classes(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(t, root)`` of each of ``sets(t, n, first, bits)``: the connected parts of all alike pairs.

    Compared are the ``pairs(a, b)`` that operator 4 gives, and those of a text with the
    least text that has one of its first shingles among its own; then, of the texts
    that this left apart, those that share enough of their first. Parts are found
    once for the first lot, and then over those parts, in rounds, for the second.
    """
    # narrow rows, as most shingles meet no other text and end after the shuffle
    placed = sets.select("t", "n", F.posexplode("first").alias("i", "h")).select("h", F.struct("t", (F.col("n") * (1 << 32) + F.col("i")).alias("at")).alias("x"))
    line = Window.partitionBy("h")
    met = cut(placed.withColumn("count", F.count("*").over(line)).withColumn("y", F.min("x").over(line)).where("count > 1").drop("count"))
    split = lambda c: F.struct(F.col(f"{c}.t").alias("t"), F.shiftright(f"{c}.at", 32).alias("n"), F.col(f"{c}.at").bitwiseAND(F.lit((1 << 32) - 1)).alias("i"))
    met = met.select("h", split("x").alias("x"), split("y").alias("y"))
    near = met.where((F.col("x.t") != F.col("y.t")) & _may("x", "y")).select(F.col("y.t").alias("a"), F.col("x.t").alias("b"))
    one = confirmed(docs, sets, near.unionByName(pairs).distinct(), shingle)
    parts = components(one).withColumnRenamed("node", "t")
    first = cut(sets.select("t").join(parts, "t", "left").select("t", F.coalesce("root", "t").alias("root")))
    # only shingles of several parts can join two; both sides of the join read the one shuffle by h
    line = Window.partitionBy("h")
    rest = met.select("h", "x", F.col("x.t").alias("t")).join(first, "t").select("h", "x", "root")
    rest = rest.withColumn("parts", F.max("root").over(line) != F.min("root").over(line)).where("parts").select("h", "x", "root")
    p, q = rest.alias("p"), rest.alias("q")
    apart = p.join(q, F.col("p.h") == F.col("q.h")).where((F.col("p.x.t") < F.col("q.x.t")) & (F.col("p.root") != F.col("q.root")) & _sizes("p.x", "q.x"))
    ends = [F.col("p.x.t").alias("a"), F.col("q.x.t").alias("b"), F.col("p.x.n").alias("n"), F.col("q.x.n").alias("m")]
    apart = apart.groupBy(*ends).agg(F.count("*").alias("both"), F.first("p.root").alias("ra"), F.first("q.root").alias("rb"))
    later = joined(docs, sets, apart.where(_enough(F.col("n"), F.col("m"), F.col("both"))).select("a", "b", "ra", "rb"), shingle)
    later = later.select(F.col("node").alias("root"), F.col("root").alias("last"))
    known = cut(later.join(first.groupBy("root").agg(F.count("*").alias("n")), "root"))
    return look_up(first, "root", known, "last", first.count(), "t").select("t", F.coalesce("last", "root").alias("root"))
