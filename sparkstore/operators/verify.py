"""Hashes of contents, trees and Merkle roots."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, cut

#: Root of a tree without leaves: a hash that no leaf and no pair can have.
EMPTY_ROOT = hashlib.sha256(b"sparkstore: a tree without leaves").hexdigest()
#: Levels of a Merkle tree that one aggregation folds.
FOLDED = 10
#: Bytes of records that one task of a chained digest hashes.
LINK = 256 << 20


def _u(n, width: int):
    """Big-endian bytes of a number."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def record(kind, path, size, detail):
    """What a tree digest holds of an entry: length and bytes of the path, then F with size
    and content hash, D for a directory, or L with length and text of a link."""
    name, text = path.cast("binary"), F.coalesce(detail, F.lit("")).cast("binary")
    head = F.concat(_u(F.octet_length(name), 4), name)
    file = F.concat(F.lit(b"F"), _u(size, 8), F.unhex(F.coalesce(detail, F.lit(""))))
    return F.concat(head, F.when(kind == "file", file).when(kind == "dir", F.lit(b"D")).otherwise(F.concat(F.lit(b"L"), _u(F.octet_length(text), 4), text)))


def tree_digest(entries: DataFrame, by: str) -> DataFrame:
    """``(by, files, digest)``: one SHA-256 over the ``record`` of each of ``entries(by, path,
    kind, size, detail)``, in the order of their path components.

    ``detail`` is the content hash of a file, the target of a link. One hash over an
    order is a fold: each ``by`` is sorted and streamed by one task, that holds a
    batch of records; ``merkle_roots`` is the digest that all tasks share in.
    """
    rows = entries.select(F.col(by).cast("string").alias("k"), F.split("path", "/").alias("parts"), record(F.col("kind"), F.col("path"), F.col("size"), F.col("detail")).alias("r"))
    return _folded(rows, by)


def content_digest(members: DataFrame, by: str) -> DataFrame:
    """As ``tree_digest``, of files alone with all their bytes: length and bytes of the
    path, length and bytes of ``data``."""
    name = F.col("path").cast("binary")
    r = F.concat(_u(F.octet_length(name), 4), name, _u(F.octet_length("data"), 8), F.col("data"))
    return _chained(members.select(F.col(by).cast("string").alias("k"), F.split("path", "/").alias("parts"), r.alias("r")), by)


class _Sha256:
    """A SHA-256 whose state is bytes, so that another task can go on with it (OpenSSL's SHA256_CTX,
    which holds no pointers)."""

    def __init__(self, state: bytes | None = None):
        self.lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        for name, kinds in (("Init", [ctypes.c_void_p]), ("Update", [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]), ("Final", [ctypes.c_void_p, ctypes.c_void_p])):
            getattr(self.lib, f"SHA256_{name}").argtypes = kinds
        self.c = ctypes.create_string_buffer(state or b"", 256)
        if state is None:
            self.lib.SHA256_Init(self.c)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.c, data, len(data))

    def state(self) -> bytes:
        return self.c.raw[:255]

    def hexdigest(self) -> str:
        out, c = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), 256)
        self.lib.SHA256_Final(out, c)
        return out.raw.hex()


def _resumes() -> bool:
    """Whether the library is there and a hash can be taken up again."""
    try:
        h = _Sha256()
        h.update(b"a" * 70)
        h = _Sha256(h.state())
        h.update(b"b")
        return h.hexdigest() == hashlib.sha256(b"a" * 70 + b"b").hexdigest()
    except (OSError, AttributeError):
        return False


def _chained(rows: DataFrame, by: str) -> DataFrame:
    """``_folded``, for records with payloads: ranges of the order, of about LINK bytes each, are
    hashed by one task after the other, which hands on the state of the open hash. No
    task reads more than its range, whatever the bytes of one ``by``. One fold remains if all fits
    a range, or if no hash can be taken up again here."""
    total = rows.agg(F.sum(F.octet_length("r").cast("long"))).first()[0] or 0
    if total <= LINK or not _resumes():
        return _folded(rows, by)
    links = -(-total // LINK)
    ranged = cut(rows.repartitionByRange(links, "k", "parts").withColumn("__p", F.spark_partition_id()), "__p")
    out, last = None, None

    def link(given):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, n, h = ((given["k"],), given["files"], _Sha256(bytes(given["state"]))) if given else ((), 0, None)
            for part in batches:
                done = []
                for k, r in zip(part["k"], part["r"], strict=True):
                    if (k,) != key:
                        if h:
                            done.append((*key, n, h.hexdigest(), None))
                        key, n, h = (k,), 0, _Sha256()
                    h.update(bytes(r))
                    n += 1
                yield pd.DataFrame(done, columns=["k", "files", "digest", "state"])
            if h:
                yield pd.DataFrame([(*key, n, None, h.state())], columns=["k", "files", "digest", "state"])

        return run

    for p in range(links):
        line = bounded(ranged.where(F.col("__p") == p).coalesce(1)).sortWithinPartitions("k", "parts").select("k", "r")
        told = cut(line.mapInPandas(link(last), "k string, files long, digest string, state binary"))
        last = told.where("state IS NOT NULL").first() or last
        done = told.where("state IS NULL").select("k", "files", "digest")
        out = done if out is None else out.unionByName(done)
    end = [(last["k"], last["files"], _Sha256(bytes(last["state"])).hexdigest())]
    return out.unionByName(rows.sparkSession.createDataFrame(end, "k string, files long, digest string")).withColumnRenamed("k", by)


def _folded(rows: DataFrame, by: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, h = (), 0, None
        for part in batches:
            out = []
            for k, r in zip(part["k"], part["r"], strict=True):
                if (k,) != key:
                    if h:
                        out.append((*key, n, h.hexdigest()))
                    key, n, h = (k,), 0, hashlib.sha256()
                h.update(r)
                n += 1
            yield pd.DataFrame(out, columns=["k", "files", "digest"])
        if h:
            yield pd.DataFrame([(*key, n, h.hexdigest())], columns=["k", "files", "digest"])

    line = rows.repartition("k").sortWithinPartitions("k", "parts").select("k", "r")
    return line.mapInPandas(run, "k string, files long, digest string").withColumnRenamed("k", by)


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``i``, the place of each row under its ``by`` in order of the long ``order``, from
    0, and ``n``, the rows of the ``by``. Ranges of the order are counted first, so that
    no window holds a ``by``."""
    span = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    wide = max(1, ((span[1] or 0) - (span[0] or 0) + 1) // max(1, span[2] >> 14))
    rows = rows.withColumn("__r", F.floor((F.col(order) - (span[0] or 0)) / wide))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__r").agg(F.count("*").alias("c"))
    ahead = counts.select(F.col(by).alias("__k"), F.col("__r").alias("__q"), F.coalesce(F.sum("c").over(upto(by).orderBy("__r")), F.lit(0)).alias("__a"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    both = rows.join(ahead, F.col(by).eqNullSafe(F.col("__k")) & (F.col("__r") == F.col("__q")))
    return both.withColumn("i", F.col("__a") + F.count("*").over(upto(by, "__r").orderBy(order))).drop("__k", "__q", "__a", "__r")


def merkle_roots(leaves: DataFrame, by: str, order: str, groups: DataFrame | None = None) -> DataFrame:
    """Merkle root of the ``leaf`` hashes (hex) of each ``by``, in order of ``order``.

    A leaf is hashed after a zero byte, a pair after a one byte; an odd level
    pairs its last with itself. One aggregation folds 2^FOLDED nodes to one, so n
    leaves take log(n) / FOLDED rounds. Of ``groups(by)`` that have no leaf the root
    is EMPTY_ROOT.
    """
    h = lambda x: F.unhex(F.sha2(x, 256))
    level = cut(numbered(leaves.select(by, order, h(F.concat(F.unhex(F.lit("00")), F.unhex("leaf"))).alias("h")), by, order).select(by, "i", "n", "h"))
    pair = lambda xs: F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / 2).cast("int") - 1), lambda j: h(F.concat(F.unhex(F.lit("01")), F.get(xs, 2 * j), F.get(xs, F.least(2 * j + 1, F.size(xs) - 1)))))
    while level.where("n > 1").limit(1).count():
        block = level.groupBy(by, "n", F.floor(F.col("i") / (1 << FOLDED)).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("xs"))
        # the only block is folded to its root, one of several to its level, repeating its last
        steps = F.when(F.col("n") > 1 << FOLDED, FOLDED).otherwise(F.length(F.bin(F.col("n") - 1)) * (F.col("n") > 1).cast("int")).cast("int")
        turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        level = cut(block.select(by, "i", F.ceil(F.col("n") / (1 << FOLDED)).alias("n"), F.get(F.aggregate(turns, F.col("xs"), lambda acc, _: pair(acc)), F.lit(0)).alias("h")))
    out = level.select(by, F.lower(F.hex("h")).alias("root"))
    if groups is None:
        return out
    own = out.withColumnRenamed(by, "__k")
    return groups.select(by).distinct().join(own, F.col(by).eqNullSafe(F.col("__k")), "left").select(by, F.coalesce("root", F.lit(EMPTY_ROOT)).alias("root"))


def mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose declared ``sha`` or ``crc`` is not that of their ``data``."""
    return rows.where((F.sha2("data", 256) != F.col("sha")) | (F.crc32("data") != F.col("crc")))


def crc_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose stored ``crc`` is absent or not that of their ``data``, with the ``found`` one."""
    return rows.withColumn("found", F.crc32("data")).where(~F.col("crc").eqNullSafe(F.col("found")))


def declared_hashes(entries: DataFrame, blobs: DataFrame, recipes: DataFrame) -> DataFrame:
    """The hash that each of ``entries(path, storage, ref, own)`` must have: that of its blob,
    or of its recipe, or what its row declares; null where none is told."""
    b = blobs.select(F.col("blob_id").alias("ref"), F.col("sha").alias("bs"))
    r = recipes.select(F.col("recipe_id").alias("ref"), F.col("sha").alias("rs"))
    both = entries.join(b, "ref", "left").join(r, "ref", "left")
    told = F.when(F.col("storage") == "blob", F.col("bs")).when(F.col("storage") == "recipe", F.col("rs")).otherwise(F.col("own"))
    return both.select("path", "storage", told.alias("sha"))
