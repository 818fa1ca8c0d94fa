"""A store as a graph: nodes packed directly or kept as deltas of packed ones, never deeper."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sha
from ..shared import bounded, cut
from . import chunking, codecs, content, delta, packing, planning, resemblance, verify

#: A member up to WHOLE bytes is one node; longer ones are cut by content (fixed values).
WHOLE, SIZES = 512 << 10, (32 << 10, 128 << 10, 512 << 10)
#: Bytes of a record's header, what a delta is charged beside it, least node of a delta.
HEADER, CHARGE, LEAST = 53, 24, 1024
PACK, RESIDUAL = 512 << 10, 64 << 10
RECORD = "key string, kind string, codec long, usize long, csize long, crc long, sha string, payload binary"


@dataclass
class Graph:
    """``files(path, seq, node, off, len)``, ``nodes(node, sha, size, record, base, off, len)``,
    ``records(record, kind, codec, usize, csize, crc, sha, payload)``, sizes and hashes of
    ``members(path, size, sha)``, and the Merkle root of the records."""

    members: DataFrame
    files: DataFrame
    nodes: DataFrame
    records: DataFrame
    root: str


def cut_nodes(members: DataFrame, whole: int = WHOLE, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """``(path, seq, off, len, sha, data)`` of the nodes of each member, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = chunking.gear()
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["data"], strict=True):
                data, at = bytes(data), 0
                for seq, end in enumerate([len(data)] if len(data) <= whole else chunking.cuts(data, *sizes, table)):
                    out.append((path, seq, at, end - at, hashlib.sha256(data[at:end]).hexdigest(), data[at:end]))
                    at = end
            yield pd.DataFrame(out, columns=["path", "seq", "off", "len", "sha", "data"])

    return bounded(members.select("path", "data")).mapInPandas(run, "path string, seq long, off long, len long, sha string, data binary")


def _packed(rows: DataFrame, level: int = 12) -> DataFrame:
    """Records of ``(key, kind, data)``: Zstandard where it is shorter, else raw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        for part in batches:
            out = []
            for key, kind, data in zip(part["key"], part["kind"], part["data"], strict=True):
                data = bytes(data)
                packed = c.compress(data)
                codec, kept = (codecs.ZSTD, packed) if len(packed) < len(data) else (codecs.RAW, data)
                out.append((key, kind, codec, len(data), len(kept), zlib.crc32(data), hashlib.sha256(data).hexdigest(), kept))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return bounded(rows.select("key", "kind", "data")).mapInPandas(run, RECORD)


def audition(pairs: DataFrame) -> DataFrame:
    """Measured edges of ``pairs(target, base, bases, data)``: the delta, its cost as a record of
    its own against that of the target, and whether it pays.

    ``(target, base, delta, copied, direct, cost, saving, admitted)``; targets and bases
    under LEAST bytes are not tried.
    """

    @F.pandas_udf("long")
    def length(data: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=12)
        return pd.Series([0 if x is None else min(len(x), len(c.compress(bytes(x)))) for x in data], dtype="int64")

    tried = pairs.where((F.octet_length("data") >= LEAST) & (F.octet_length(F.get("bases", F.lit(0))) >= LEAST))
    told = delta.deltas(tried.withColumnRenamed("target", "id").withColumnRenamed("data", "target")).where("delta IS NOT NULL")
    direct, cost = length("target") + HEADER, length("delta") + HEADER + CHARGE
    told = told.select(F.col("id").alias("target"), "base", "delta", F.get("copied", F.lit(0)).alias("copied"), F.octet_length("target").cast("long").alias("size"), direct.alias("direct"), cost.alias("cost"))
    told = told.withColumn("saving", F.col("direct") - F.col("cost"))
    return told.withColumn("admitted", delta.admissible(F.col("saving"), F.col("copied"), F.col("direct"), F.col("size")))


def build(members: DataFrame, pack: int = PACK, residual: int = RESIDUAL) -> Graph:
    """The graph of ``members(path, data)``.

    Members are cut into nodes, equal nodes are one. Similar nodes are candidates by
    their sketches, edges are measured as they would be stored, and central bases
    chosen. Nodes that are no targets are packed in the order of likeness; the deltas
    of one base are packed together where that pays. Every table is cut once, and
    payloads move only with the table that they go into.
    """
    pieces = cut(cut_nodes(members))
    first = pieces.groupBy("sha").agg(F.min(F.struct("path", "seq")).alias("at"), F.max("len").alias("size"))
    ids = cut(content.running(first, F.substring("sha", 1, 3), ["sha"], F.lit(1).cast("long"), "node"))
    data = pieces.select("path", "seq", "sha", "data").join(ids.select("node", F.col("sha").alias("s"), F.col("at.path").alias("path"), F.col("at.seq").alias("seq")), ["path", "seq"]).select("node", F.col("s").alias("sha"), "data")
    data = cut(data)
    nodes = data.select(F.col("node").alias("id"), "data", F.octet_length("data").cast("long").alias("size"))
    sketch = cut(resemblance.sketches(nodes))
    edges = resemblance.candidates(sketch)
    t, b = nodes.select(F.col("id").alias("target"), "data"), nodes.select(F.col("id").alias("base"), F.array("data").alias("bases"))
    measured = cut(audition(edges.join(t, "target").join(b, "base").select("target", "base", "bases", "data")).where("admitted"))
    chosen = cut(resemblance.central_bases(measured))
    # direct nodes, in the order of likeness
    roots = ids.select("node", "size").join(chosen.select(F.col("target").alias("node")), "node", "left_anti")
    keyed = roots.join(resemblance.similarity_order(sketch).withColumnRenamed("id", "node"), "node").withColumn("all", F.lit(0))
    placed = cut(packing.greedy(keyed, "all", ["key", "node"], "size", pack))
    whole = placed.join(data, "node").groupBy("pack").agg(F.expr("listagg(data, x'') WITHIN GROUP (ORDER BY slot)").alias("data"))
    direct = whole.select(F.concat(F.lit("d"), F.col("pack").cast("string")).alias("key"), F.lit("pack").alias("kind"), F.coalesce("data", F.lit(b"")).alias("data"))
    # deltas: of one base together where it pays
    programs = chosen.join(measured, ["target", "base"]).select("base", "target", "delta", F.octet_length("delta").cast("long").alias("raw"), F.col("size").alias("target_len"))
    grouped = cut(planning.residual_packs(programs, residual))
    paid = planning.kept_packs(grouped.drop("delta"), ["base", "pack"]).select("base", "pack", F.lit(True).alias("paid"))
    told = grouped.join(paid, ["base", "pack"], "left")
    key = F.when(F.col("paid"), F.concat_ws("/", F.lit("r"), F.col("base").cast("string"), F.col("pack").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("target").cast("string")))
    line = Window.partitionBy("key").orderBy("target").rowsBetween(Window.unboundedPreceding, -1)
    told = cut(told.withColumn("key", key).withColumn("off", F.coalesce(F.sum("raw").over(line), F.lit(0)).cast("long")))
    programs = told.groupBy("key").agg(F.expr("listagg(delta, x'') WITHIN GROUP (ORDER BY target)").alias("data")).select("key", F.lit("delta").alias("kind"), F.coalesce("data", F.lit(b"")).alias("data"))
    records = cut(_packed(direct.unionByName(programs)))
    numbers = cut(content.running(records.select("key", "sha"), F.substring("sha", 1, 3), ["sha", "key"], F.lit(1).cast("long"), "record").select("key", "record"))
    records = records.join(numbers, "key").drop("key")
    own = placed.select("node", F.concat(F.lit("d"), F.col("pack").cast("string")).alias("key"), F.lit(None).cast("long").alias("base"), "off", F.col("size").alias("len"))
    mine = told.select(F.col("target").alias("node"), "key", "base", "off", F.col("raw").alias("len"))
    located = own.unionByName(mine).join(numbers, "key").join(ids.select("node", "sha", "size"), "node").select("node", "sha", "size", "record", "base", "off", "len")
    files = pieces.join(ids.select("sha", "node"), "sha").select("path", "seq", "node", "off", "len")
    told = members.select("path", F.octet_length("data").cast("long").alias("size"), sha(F.col("data")).alias("sha"))
    root = verify.merkle_roots(records.select(F.lit(0).alias("k"), "record", F.col("sha").alias("leaf")), "k", "record").first()
    return Graph(told, files, located, records, root["root"] if root else verify.EMPTY_ROOT)


def extract(g: Graph) -> DataFrame:
    """``(path, size, sha, data)`` of all members: records are decoded and checked, nodes cut
    from them or made from their base and checked, members put together and checked.
    data is null where anything on the way does not hold. Three joins, as no delta has
    a delta below it."""

    @F.pandas_udf("binary")
    def decoded(payload: pd.Series, codec: pd.Series, usize: pd.Series, crc: pd.Series, digest: pd.Series) -> pd.Series:
        def one(p, c, n, k, h):
            try:
                x = codecs.unpacked(bytes(p), int(c), int(n))
            except ValueError:
                return None
            return x if zlib.crc32(x) == k and hashlib.sha256(x).hexdigest() == h else None

        return pd.Series([one(*v) for v in zip(payload, codec, usize, crc, digest, strict=True)], dtype=object)

    raw = bounded(g.records).select("record", decoded("payload", "codec", "usize", "crc", "sha").alias("raw"))
    piece = F.substring("raw", F.col("off").cast("int") + 1, F.col("len").cast("int"))
    cuts = cut(g.nodes.join(raw, "record").select("node", "sha", "base", piece.alias("data")))
    direct = cuts.where("base IS NULL").select("node", "sha", "data")
    made = cuts.where("base IS NOT NULL").join(direct.select(F.col("node").alias("base"), F.array("data").alias("bases")), "base", "left")
    made = delta.restored(made.withColumnRenamed("data", "delta")).select("node", "sha", F.col("again").alias("data"))
    nodes = direct.unionByName(made).withColumn("data", F.when(F.sha2("data", 256) == F.col("sha"), F.col("data")))
    whole = g.files.join(nodes.select("node", "data"), "node", "left").groupBy("path").agg(F.when(F.count("data") == F.count("*"), F.expr("listagg(data, x'') WITHIN GROUP (ORDER BY seq)")).alias("data"))
    out = g.members.join(whole, "path", "left")
    data = F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("data"))
    return out.select("path", "size", "sha", F.when((F.octet_length(data) == F.col("size")) & (F.sha2(data, 256) == F.col("sha")), data).alias("data"))


def stats(g: Graph) -> DataFrame:
    """Nodes, deltas, records and stored bytes of a graph: one row."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count("base").alias("deltas"), F.coalesce(F.sum("size"), F.lit(0)).alias("node_bytes"))
    r = g.records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.col("csize") + HEADER), F.lit(0)).alias("stored_bytes"))
    return n.crossJoin(F.broadcast(r))


def first_valid(copies: DataFrame, what: str) -> DataFrame:
    """Of the ``copies(copy, bytes, sha, ...)`` of metadata the first, by ``copy``, whose bytes have
    their hash: the primary one, else the one at the tail; none if both are hurt."""
    good = copies.where(F.sha2(what, 256) == F.col("sha"))
    return good.orderBy("copy").limit(1)
