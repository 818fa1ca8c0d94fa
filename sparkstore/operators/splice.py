"""Texts that stand whole inside other texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, cut, hinted

#: Words, and characters, of a block key.
WORDS, CHARS = 4, 32


def contained(parents: DataFrame, kids: DataFrame) -> DataFrame:
    """``(doc_id, item_id, at)``: every place, overlapping ones too, of ``kids(item_id, kid)`` in
    ``parents(doc_id, text)``, of kids that have at least CHARS characters.

    Containment is no equality, so a block key comes first: the words after a
    kid's first space are whole words of any text that holds it, so WORDS of them
    in a row, those that the fewest places of the parents have, are joined to all
    rolling word grams of the parents, and only rows that meet are compared. Kids
    with fewer such words are keyed by their first CHARS characters, at every
    place; that pass runs only if there are any.
    """
    split = lambda c: F.split(c, "[ \\n]+")
    words = split(F.col("kid"))
    kids = kids.where(F.length("kid") >= CHARS).withColumn("wordy", F.size(words) >= WORDS + 2)
    own = parents.select("doc_id", split(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "word"))
    gram: list[Column] = [F.col("word"), *[F.get("w", F.col("pos") + i) for i in range(1, WORDS)]]
    placed = own.where(F.col("pos") + WORDS <= F.size("w")).select("doc_id", F.xxhash64(*gram).alias("h"))
    grams = kids.where("wordy").select("item_id", words.alias("v")).select("item_id", F.explode(F.sequence(F.lit(1), F.size("v") - WORDS - 1)).alias("i"), "v")
    grams = cut(grams.select("item_id", "i", F.xxhash64(*[F.get("v", F.col("i") + j) for j in range(WORDS)]).alias("h")))
    # of all grams of the parents only those that a kid has are shuffled, and kept
    own_grams = cut(grams.select("h").distinct())
    placed = cut(hinted(placed, "h", own_grams).join(own_grams, "h", "left_semi"))
    # of a kid's inner grams the rarest in the parents; one that is not there ends the kid
    counts = placed.groupBy("h").agg(F.count("*").alias("n"))
    rare = grams.join(counts, "h", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "h")).alias("b")).where("b.n > 0")
    met = placed.join(rare.select("item_id", "b.h"), "h").select("doc_id", "item_id")
    rest = kids.where("NOT wordy")
    if not rest.isEmpty():
        chars = F.transform(F.sequence(F.lit(1), F.length("text") - CHARS + 1), lambda i: F.xxhash64(F.substring("text", i, F.lit(CHARS))))
        places = parents.where(F.length("text") >= CHARS).select("doc_id", F.explode(chars).alias("h"))
        heads = cut(rest.select("item_id", F.xxhash64(F.substring("kid", 1, CHARS)).alias("h")))
        met = met.unionByName(hinted(places, "h", heads.select("h")).join(heads, "h").select("doc_id", "item_id"))
    met = cut(met.distinct())
    # kids first, as texts are the longer; of those only the ones that a kid may be in
    texts = hinted(parents.select("doc_id", "text"), "doc_id", cut(met.select("doc_id").distinct()))
    pairs = met.join(kids.select("item_id", "kid"), "item_id").join(texts, "doc_id").where(F.contains("text", "kid"))

    @F.pandas_udf("array<long>")
    def places_of(text: pd.Series, kid: pd.Series) -> pd.Series:
        def one(t: str, k: str) -> list[int]:
            out, at = [], t.find(k)
            while at >= 0:
                out.append(at)
                at = t.find(k, at + 1)
            return out

        return pd.Series([one(*x) for x in zip(text, kid, strict=True)], dtype=object)

    return bounded(pairs).select("doc_id", "item_id", F.explode(places_of("text", "kid")).alias("at"))


def spliced(found: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """``(doc_id, item_id, at, len)``: the places of ``contained`` that a parent takes from its
    kids, the leftmost first, of those the longest, none over another; parents whose
    places have fewer than ``least`` characters in all take none.

    A parent's places are streamed in order; the task holds one place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, end = None, 0
        for rows in batches:
            out = []
            for row in rows[["doc_id", "item_id", "at", "len"]].itertuples(index=False, name=None):
                if row[0] != now:
                    now, end = row[0], 0
                if row[2] >= end:
                    out.append(row)
                    end = row[2] + row[3]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "at", "len"])

    told = found.join(lengths, "item_id").select("doc_id", "item_id", "at", F.col("len").cast("long").alias("len"))
    line = told.repartition("doc_id").sortWithinPartitions("doc_id", "at", F.desc("len"), "item_id")
    taken = line.mapInPandas(run, "doc_id long, item_id long, at long, len long")
    return taken.withColumn("whole", F.sum("len").over(Window.partitionBy("doc_id"))).where(F.col("whole") >= least).drop("whole")
