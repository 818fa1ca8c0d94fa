"""What the store reads: tables, file trees, and records salvaged from bytes."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import content, sha
from ..shared import bounded, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text members ``(path, doc_id, lang, source, data, size)``."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("_")), F.coalesce("source", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    data = content(F.coalesce("text", F.lit("")))
    return d.select(path.alias("path"), "doc_id", "lang", "source", data.alias("data"), F.octet_length(data).cast("long").alias("size"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as members; the address without its scheme is the path."""
    p = table(spark, sf_dir, "pages")
    data = content(F.coalesce("html", F.lit("")))
    path = F.concat(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", ""), F.lit("#"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(path.alias("path"), "page_id", data.alias("data"), F.octet_length(data).cast("long").alias("size"))


LISTED = "path string, mode string, perm int, size long, mtime_ns long, dev long, ino long, uid long, gid long, link string, xattrs map<string,binary>, allocated long"


def listing(spark: SparkSession, root: str, parts: int = 64) -> DataFrame:
    """Everything below the folder ``root``, whatever its name: ``(path, mode, perm, size, mtime_ns,
    dev, ino, uid, gid, link, xattrs, allocated)``, paths relative to it.

    The folder is one that all executors see. Executors list it, one level of
    directories a round; the driver holds no names. ``mode`` is f, d, l, or o for what
    is none of these; links are not followed; what vanishes meanwhile is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTED.replace("map<string,binary>", "m").split(", ")]
        for rows in batches:
            for at in rows["path"]:
                out = []
                try:
                    for e in os.scandir(os.path.join(root, at)):
                        out.append(_entry(f"{at}/{e.name}" if at else e.name, e))
                except OSError:
                    pass
                yield pd.DataFrame([x for x in out if x], columns=names)

    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = cut(level.repartition(parts, "path").mapInPandas(run, LISTED))
        out = found if out is None else out.unionByName(found)
        level = found.where("mode = 'd'").select("path")
        if level.isEmpty():
            return out


def _entry(path: str, e: os.DirEntry) -> tuple | None:
    try:
        s = e.stat(follow_symlinks=False)
        mode = "l" if e.is_symlink() else "d" if e.is_dir(follow_symlinks=False) else "f" if e.is_file(follow_symlinks=False) else "o"
        link = os.readlink(e.path) if mode == "l" else None
        try:
            attrs = {k: os.getxattr(e.path, k, follow_symlinks=False) for k in os.listxattr(e.path, follow_symlinks=False)}
        except OSError:
            attrs = {}
    except OSError:
        return None
    size = s.st_size if mode == "f" else len(os.fsencode(link)) if link is not None else 0
    return path, mode, stat.S_IMODE(s.st_mode), size, s.st_mtime_ns, s.st_dev, s.st_ino, s.st_uid, s.st_gid, link, attrs, s.st_blocks * 512


def scan(spark: SparkSession, root: str, metadata: bool = True, reproducible: bool = False, epoch_ns: int = 0) -> DataFrame:
    """Entries of a tree, classified: ``(path, kind, mode, mtime_ns, size, target, uid, gid, xattrs)``.

    Hardlinks name the first path of their inode. Without ``metadata`` there are no
    owners and attributes; ``reproducible`` also sets all times to ``epoch_ns``.
    """
    told = classify(listing(spark, root))
    keep = F.lit(metadata and not reproducible)
    when = F.lit(epoch_ns).cast("long") if reproducible else F.col("mtime_ns")
    return told.select(
        "path", "kind", F.col("perm").alias("mode"), when.alias("mtime_ns"), "size", F.when(F.col("kind") == "symlink", F.col("link")).otherwise(F.col("target")).alias("target"),
        F.when(keep, F.col("uid")).otherwise(0).alias("uid"), F.when(keep, F.col("gid")).otherwise(0).alias("gid"), F.when(keep, F.col("xattrs")).alias("xattrs"),
    )


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``, hidden ones too: ``(path, mtime, size, data)``, paths relative to it.
    Executors read them, a batch of files at a time; a query without data opens none."""
    files = listing(spark, root).where("mode = 'f'")
    return files.select("path", (F.col("mtime_ns") / 1000000000).cast("timestamp").alias("mtime"), "size", contents(root, F.col("path")).alias("data"))


def contents(root: str, path: Column) -> Column:
    """The bytes of a file below a folder that all executors see; null if it cannot be read."""

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        def one(p):
            try:
                with open(os.path.join(root, p), "rb") as f:
                    return f.read()
            except OSError:
                return None

        return pd.Series([one(p) for p in paths], dtype=object)

    return read(path)


def children(entries: DataFrame, parent: str) -> DataFrame:
    """Entries right below a directory, by exact match of their parent; "" is the top."""
    above = F.regexp_extract("path", "^(?s)(.*)/[^/]*$", 1)
    return entries.where((above == parent) & (F.lit(parent != "") | ~F.contains("path", F.lit("/"))))


def descendants(entries: DataFrame, parent: str) -> DataFrame:
    """Entries anywhere below a directory: a prefix that is pushed into the scan."""
    return entries.where(F.col("path").startswith(f"{parent}/")) if parent else entries


def generate(spark: SparkSession, files: int, seed: int = 1, sizes: tuple[int, int] = (0, 64 << 10), copies: float = 0.2, folders: int = 16) -> DataFrame:
    """A made tree ``(path, data)``, the same for the same arguments: words by a keyed hash, some
    files copies of others."""
    low, high = sizes
    h = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30))
    own = spark.range(files).withColumn("src", F.when(h("id", F.lit("c")) < int(copies * (1 << 30)), F.floor(F.col("id") / 2)).otherwise(F.col("id")))
    size = (h("src", F.lit("n")) % max(1, high - low) + low).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.floor(size / 8).cast("int")), lambda i: F.substring(F.hex(F.xxhash64(F.lit(seed), "src", i % 97)), 1, 7))
    path = F.concat(F.lit("d"), h("id", F.lit("d")) % folders, F.lit("/f"), F.col("id"), F.when(F.col("id") % 3 == 0, ".txt").otherwise(".bin"))
    return own.select(path.alias("path"), F.substring(F.array_join(words, " ").cast("binary"), F.lit(1), size).alias("data"))


def classify(listing: DataFrame) -> DataFrame:
    """Kind of each ``(path, mode, dev, ino)`` of a scan: link, directory, hardlink
    to the first path (by components) of its inode, or file. Others are dropped."""
    kind = F.when(F.col("mode") == "l", "symlink").when(F.col("mode") == "d", "dir").when(F.col("mode") == "f", "file")
    inode = Window.partitionBy("dev", "ino").orderBy(F.split("path", "/"))
    seen = listing.withColumn("kind", kind).where("kind IS NOT NULL")
    files = seen.where("kind = 'file'").withColumn("target", F.first("path").over(inode))
    files = files.withColumn("kind", F.when(F.col("target") == F.col("path"), "file").otherwise("hardlink"))
    files = files.withColumn("target", F.when(F.col("kind") == "hardlink", F.col("target")))
    return files.unionByName(seen.where("kind != 'file'").withColumn("target", F.lit(None).cast("string")))


def salvage(blobs: DataFrame, magic: bytes, header: int = 64) -> DataFrame:
    """Every place of ``magic`` in ``data`` whose declared extent fits, found byte by
    byte: ``(path, at, usize, csize)``. Sizes stand little-endian at bytes 8 and 16."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["data"], strict=True):
                at = data.find(magic)
                while at >= 0:
                    if at + header <= len(data):
                        usize, csize = (int.from_bytes(data[at + i : at + i + 8], "little") for i in (8, 16))
                        if at + header + csize <= len(data):
                            out.append((path, at, usize, csize))
                    at = data.find(magic, at + 1)
            yield pd.DataFrame(out, columns=["path", "at", "usize", "csize"])

    return bounded(blobs.select("path", "data")).mapInPandas(run, "path string, at long, usize long, csize long")


def blob_rows(members: DataFrame) -> DataFrame:
    return members.select("path", sha(F.col("data")).alias("sha"), "size")
