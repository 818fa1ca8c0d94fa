"""What the operators share: lineage cuts in shared storage, batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that a Python worker is sent at once.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 4096
#: Most bits of the bitmap of keys that is sent to rows; a key of fewer has 16 or more.
HINT_BITS = 1 << 26


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a Parquet table below the session's ``spark.checkpoint.dir``, read from there.

    Where that is unset a folder is made if the master is local; elsewhere it would
    be out of the executors' sight, and that is an error. The table has its true
    size, by which later joins are planned. It has a folder for each value of ``by``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df``, for a Python function over payloads: a batch holds ``most_bytes``, or one row.

    The settings stay in the session, as they are read when a query is planned;
    smaller ones, and sizes set by hand with a unit, are left alone.
    """
    spark: SparkSession = df.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, most)
    return df


def hinted(rows: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be in ``named(key)``: all that are, and about one in twenty of
    the others. A bitmap of the keys' hashes is sent to the rows, in at most HINT_BITS bits
    however many there are, so that an exact join shuffles little of a large table.
    ``named`` is read twice: it should be cut.
    """
    word, bits, at = (f"__{c}_{uuid.uuid4().hex[:8]}" for c in ("word", "bits", "at"))
    size = 1 << min(HINT_BITS.bit_length() - 1, max(6, (16 * named.count()).bit_length()))
    # not by the seed of other hashes, as keys may be such hashes
    place = F.pmod(F.xxhash64(F.lit(0x48494E54), F.col(key)), F.lit(size).cast("long"))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} & 63 AS INT))")
    words = named.select(place.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(bit(at)).alias(bits))
    met: Column = F.shiftright(at, 6) == F.col(word)
    return rows.withColumn(at, place).join(F.broadcast(words), met).where(F.col(bits).bitwiseAND(bit(at)) != 0).select(*rows.columns)
