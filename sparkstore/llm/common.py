"""What several operators share: tables, folds, lineage cuts and components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words of several operators are the runs between it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes that a Python worker is sent at once; texts are long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A key of over 1/SPREAD of all rows is hot, so there are at most SPREAD hot keys.
SPREAD = 1024
#: Most bits of the bitmap of keys that is sent to rows, as words of 64; a key of fewer has 16 or more.
HINT_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows and bytes of an Arrow batch, and so a Python worker's memory.

    Spark reads both settings when it plans, after the operator has returned its
    frame, so they stay set in the session; smaller settings are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))  # a size with another unit was set by hand
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, most)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a Parquet table below the shared checkpoint folder and reads it there.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests) is one made; elsewhere a driver's own folder
    would be out of the executors' sight, and that is an error. Lost executors
    lose nothing of it. Unlike a checkpoint, the table has its true size, so what
    comes after it is planned by that and not by products of estimates.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; rows of fold 2 (and null ids) are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def look_up(rows: DataFrame, key: str, known: DataFrame, value: str, many: int, by: str) -> DataFrame:
    """``rows`` with ``value`` of ``known(key, value, n)`` by their ``key``, null where it is absent.

    ``n`` is how many rows have the key, or more, of ``many`` in all. What belongs
    to the hot keys, of which there are at most SPREAD (twice as many where n counts
    both ends of edges), is sent to the rows; the other rows are shuffled by key.
    Hot rows go along by a hash of ``by``, so no task gets all rows of a key.
    ``known`` is read twice: it should be cut.
    """
    told, salt = fresh("told"), fresh("salt")
    is_hot = F.col("n") * SPREAD > many
    hot = F.broadcast(known.where(is_hot).select(key, F.struct(F.col(value).alias("v")).alias(told)))
    near = rows.join(hot, key, "left")
    near = near.withColumn(salt, F.when(F.col(told).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(by).bitwiseOR(F.lit(1))))
    cold = known.where(~is_hot).select(key, F.lit(0).cast("long").alias(salt), value)
    out = near.join(cold, [key, salt], "left")
    return out.select(*rows.columns, F.when(F.col(told).isNull(), F.col(value)).otherwise(F.col(f"{told}.v")).alias(value))


def named_only(rows: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """The ``rows`` whose long ``key`` is in ``named(key)``, for a few keys and wide rows.

    A plain semi-join shuffles all rows as soon as the keys are too many to be sent
    whole. Here a bitmap of the keys' hashes goes to the rows first, in at most
    HINT_BITS bits however many keys there are, so that only named rows, and about one in
    twenty of the others, are shuffled for the exact join. ``named`` is read three
    times: it should be cut.
    """
    word, bits, at = (fresh(x) for x in ("word", "bits", "at"))
    size = 1 << min(HINT_BITS.bit_length() - 1, max(6, (16 * named.count()).bit_length()))
    # not by the seed of other hashes, as keys may be such hashes
    place = F.pmod(F.xxhash64(F.lit(0x48494E54), F.col(key)), F.lit(size).cast("long"))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} & 63 AS INT))")
    words = named.select(place.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(bit(at)).alias(bits))
    near = rows.withColumn(at, place).join(F.broadcast(words), F.shiftright(at, 6) == F.col(word)).where(F.col(bits).bitwiseAND(bit(at)) != 0)
    return near.select(*rows.columns).join(named, key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)``.

    Randomised contraction: each round maps every node to the node of smallest
    keyed hash in its closed neighbourhood and keeps the edges between different
    images. A constant share of nodes goes per round whatever the graph's shape,
    so rounds grow with the logarithm of the longest path. Aggregations combine
    before their shuffle and joins are ``look_up``, so a node of very many edges,
    or a component of very many nodes, meets no single task. ``root`` is one node
    of the component, not a chosen one. Nodes without edges do not appear.
    """
    edge = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    images: list[DataFrame] = []
    while many := edge.count():
        key = len(images)
        ranked = lambda c: F.struct(F.xxhash64(F.lit(key), c).alias("h"), c.alias("n"))
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(ranked(F.col("b"))).alias("near"), F.count("*").alias("n"))
        image = cut(near.select("a", F.least("near", ranked(F.col("a"))).getField("n").alias("to"), "n"))
        images.append(image)
        moved = look_up(edge, "a", image.select("a", F.col("to").alias("ta"), "n"), "ta", many, "b")
        moved = look_up(moved, "b", image.select(F.col("a").alias("b"), F.col("to").alias("tb"), "n"), "tb", many, "a")
        edge = cut(moved.where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not images:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # images are put together from the last, which is the smallest
    out = images[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for image in reversed(images[:-1]):
        sizes = image.groupBy("to").agg(F.count("*").alias("n"))
        known = cut(sizes.join(out.withColumnRenamed("node", "to"), "to"))
        step = look_up(image.select(F.col("a").alias("node"), "to"), "to", known, "root", image.count(), "node")
        out = step.select("node", F.coalesce("root", "to").alias("root"))
    return out


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
