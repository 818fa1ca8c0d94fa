"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import components, cut, fresh, look_up, short_batches

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Distinct fingerprints of one bucket that are compared with each other; a
#: larger bucket is covered anew by the bits that it leaves free.
BUCKET = 2048
#: Free bits that need no further covering: a bucket has at most 2^FREE members then.
FREE = 11


def masks(radius: int = RADIUS, bits: Sequence[int] = range(BITS)) -> list[int]:
    """2^(radius+1)-1 masks over ``bits``; any two words that differ in at most
    ``radius`` of those bits agree under one of them.

    Each bit carries a vector m of radius+1 bits, not zero; mask v keeps the bits
    with <m, v> = 1 over GF(2). The vectors of at most ``radius`` differing bits
    span less than the whole space, so some v is orthogonal to all of them: that
    mask keeps none of those bits. Vectors go round in strides, so that a few
    bits span the space too and every mask keeps some.
    """
    full = 2 ** (radius + 1) - 1
    stride = next(s for s in range(11, 11 + full) if math.gcd(s, full) == 1)
    vectors = {bit: i * stride % full + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, full + 1)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 for no words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.array([len(w) + 1 for w in words])
    span = min(shingle, len(words))
    first = starts[: len(words) - span + 1].tolist()
    last = (ends[span - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(BITS, np.int64)
    block = 1 << 16  # bounds the unpacked bits of a very long text
    for at in range(0, len(first), block):
        h = np.array(
            [digest(joined[s:e], seed) for s, e in zip(first[at : at + block], last[at : at + block], strict=True)],
            np.uint64,
        )
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = count * 2 > len(first)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` for each row; fp is the fingerprint as a signed long."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), printed("text").alias("fp"))


def _stars(radius: int, bucket: int):
    """Links inside sorted buckets, thinned to one star per connected part. Members of
    buckets that are too large are passed on: (fingerprint, key, kept, True)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for rows in batches:
            free = BITS - np.bitwise_count(rows["kept"].to_numpy().view(np.uint64)).astype(int)
            large = ((rows["n"] > bucket) & (free > FREE)).to_numpy()
            if large.any():
                far = rows[large]
                yield pd.DataFrame({"a": far["fp"], "b": far["key"], "kept": far["kept"], "large": True})
                rows = rows[~large]
            rows = pd.concat([held, rows], ignore_index=True) if len(held) else rows
            if not len(rows):
                continue
            key = rows[["kept", "key"]].to_numpy()
            whole = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1
            yield linked(rows.iloc[:whole])
            held = rows.iloc[whole:]
        if len(held):
            yield linked(held)

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        kept, key = rows["kept"].to_numpy(), rows["key"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        a, b = [], []
        at, step = np.arange(len(rows)), 1
        while True:
            at = at[at + step < len(rows)]
            at = at[(kept[at] == kept[at + step]) & (key[at] == key[at + step])]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            a.append(near)
            b.append(near + step)
            step += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        root = np.arange(len(rows))
        while len(a) and (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
        own = np.flatnonzero(root != np.arange(len(rows)))
        out = pd.DataFrame({"a": fp[own].view(np.int64), "b": fp[root[own]].view(np.int64)}).drop_duplicates()
        return out.assign(kept=np.int64(0), large=False)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` over distinct ``fp`` whose connected parts are those of all
    pairs within ``radius`` bits.

    Every fingerprint goes to one bucket per covering mask, so each pair within
    the radius meets. A bucket of up to ``bucket`` fingerprints compares its
    members, in one sorted pass that also finds its size. A larger one, whose
    members agree on the kept bits, is covered again in the same way by masks
    over the bits that are left, about half as many each time, until it is small
    or has at most FREE free bits. No pair is lost and no other method takes over.
    """
    spark = distinct.sparkSession
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks(radius)])).alias("kept"))
    line = Window.partitionBy("kept", "key")
    out = None
    while True:
        tabled = rows.select("kept", F.col("fp").bitwiseAND(F.col("kept")).alias("key"), "fp")
        met = tabled.withColumn("n", F.count("*").over(line)).where("n > 1")
        found = cut(met.mapInPandas(_stars(radius, bucket), "a long, b long, kept long, large boolean"))
        small = found.where("NOT large").select("a", "b")
        out = small if out is None else out.unionByName(small)
        # at most as many masks as this level has, a number that hangs on the radius alone
        crowded = [r["kept"] for r in found.where("large").select("kept").distinct().collect()]
        if not crowded:
            return out
        more = []
        for kept in crowded:
            free = [i for i in range(BITS) if not kept >> i & 1]
            more.append((kept, sorted({_signed(kept % (1 << BITS) | m) for m in masks(radius, free)})))
        further = F.broadcast(spark.createDataFrame(more, "kept long, more array<long>"))
        rows = found.where("large").select(F.col("a").alias("fp"), "kept").join(further, "kept").select("fp", F.explode("more").alias("kept")).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id of the component. Null texts count as
    empty, and texts without words share fingerprint 0 and link like others.
    Repeated rows give repeated results; a null doc_id is kept, and component_id
    is null only where no member has an id. An empty table gives an empty
    result; other columns are ignored.
    """
    marked = cut(fingerprints(docs, shingle))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    parts = components(links(least.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    rooted = cut(least.join(parts, "fp", "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    sizes = rooted.agg(F.count("*"), F.sum("rows")).first()
    known = cut(look_up(rooted, "root", named, "component_id", sizes[0], "fp").select("fp", "component_id", F.col("rows").alias("n")))
    return look_up(marked, "fp", known, "component_id", sizes[1] or 0, "doc_id").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = similar.SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` that stay, all columns kept: one of each group of
    near duplicates, that of the smallest doc_id (null ids last).

    Near duplicates are texts whose sets of ``shingle``-word shingles have a Jaccard
    likeness of 0.8 or more, and chains of them. Pairs come from covering tables over
    the SimHash of those shingles; ``similar`` confirms each on the whole texts and
    completes them by pairs that differ in more than ``radius`` bits. Null texts
    count as empty, and all texts without words are alike. Of equal rows some one
    stays; rows of one doc_id and other texts are told apart. Extra columns, whatever
    their names, stay; an empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(similar.marked(own, shingle))
    sets = cut(rows.groupBy("s").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("first").alias("first"), F.first("bits").alias("bits"), F.count("*").alias("rows")))
    prints = cut(sets.groupBy("fp").agg(F.min("t").alias("hub"), F.count("*").alias("n")))
    edges = links(prints.select("fp"), radius, bucket)
    ends = [prints.select(F.col("fp").alias(k), F.col("hub").alias(f"t{k}")) for k in "ab"]
    far = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    equal = look_up(sets.select("t", "fp"), "fp", prints, "hub", sets.count(), "t").where("t != hub").select(F.col("hub").alias("a"), F.col("t").alias("b"))
    parts = similar.classes(own, sets, far.unionByName(equal), shingle)
    rooted = cut(sets.select("t", "s", F.col("rows").alias("n")).join(parts, "t").select("s", "root", "n"))
    line = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    best = look_up(rows.select("doc_id", "t", "s"), "s", rooted, "root", rows.count(), "t").groupBy("root").agg(F.min(line).alias("best"))
    i, t = fresh("id"), fresh("t")
    kept = cut(best.select(F.col("best.doc_id").alias(i), F.col("best.t").alias(t)))
    again = rows.groupBy("doc_id", "t").count().where("count > 1").select(F.col("doc_id").alias(i), F.col("t").alias(t))
    match = lambda keys: [docs["doc_id"].cast("long").eqNullSafe(keys[i]), F.xxhash64(docs["text"]) == keys[t]]
    more = cut(kept.join(again, kept[i].eqNullSafe(again[i]) & (kept[t] == again[t]), "left_semi"))
    if more.isEmpty():
        return docs.join(kept, match(kept), "left_semi")
    single = kept.join(more, kept[i].eqNullSafe(more[i]) & (kept[t] == more[t]), "left_anti")
    odd = docs.join(more, match(more), "left_semi").withColumn(i, F.col("doc_id")).withColumn(t, F.xxhash64("text"))
    return docs.join(single, match(single), "left_semi").unionByName(odd.dropDuplicates([i, t]).drop(i, t))
