"""Containers kept as recipes: literals and Deflate payloads that rebuild them."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded, cut
from .codecs import DEFLATE, canonical_stream, deflate_level
from .extents import overlaps

STORED, DEFLATED = 0, 8
#: How a payload's stream comes back: it is the content's canonical one, it is kept as
#: it is, or its bytes give it at a level (fixed values).
CANONICAL, RETAIN, REGENERATE = 0, 1, 2
#: Deflate streams from this size on are kept as their content's canonical stream.
REUSE = 64 << 10


def segments(data: bytes) -> list[tuple[str, int, bytes, bytes | None, int]]:
    """``(part, off, stream, raw, level)`` of a ZIP: everything that is no payload is
    literal. Streams that no level gives again keep level -1 and are retained;
    data that is no ZIP, or one whose entries overlap, is one literal."""
    whole = [("literal", 0, data, None, -1)]
    try:
        entries = sorted(zipfile.ZipFile(io.BytesIO(data)).infolist(), key=lambda e: e.header_offset)
    except (zipfile.BadZipFile, ValueError):
        return whole
    out, at = [], 0
    for e in entries:
        h = e.header_offset
        if data[h : h + 4] != b"PK\x03\x04" or e.compress_type not in (STORED, DEFLATED) or e.flag_bits & 1:
            return whole
        begin = h + 30 + int.from_bytes(data[h + 26 : h + 28], "little") + int.from_bytes(data[h + 28 : h + 30], "little")
        stream = data[begin : begin + e.compress_size]
        if begin < at or len(stream) != e.compress_size:
            return whole
        try:
            raw = zlib.decompress(stream, -15) if e.compress_type == DEFLATED else stream
        except zlib.error:
            return whole
        level = deflate_level(raw, stream) if e.compress_type == DEFLATED else 0
        out.append(("literal", at, data[at:begin], None, -1))
        out.append(("payload" if e.compress_type == DEFLATED else "stored", begin, stream, raw, -1 if level is None else level))
        at = begin + len(stream)
    return [*out, ("literal", at, data[at:], None, -1)]


def make(members: DataFrame, reuse: int = REUSE) -> DataFrame:
    """``(path, seq, part, off, len, mode, level, content, keep)`` of each member.

    ``keep`` is what the store holds for a part: a literal, the bytes of a stream that
    a level regenerates, or the stream. Of the streams of one content that have at
    least ``reuse`` bytes one is canonical (the most frequent, then the shortest, then
    the first by path and place): parts that have it say so and keep nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["data"], strict=True):
                for seq, (part, off, stream, raw, level) in enumerate(segments(bytes(data))):
                    again = part == "payload" and level >= 0 and len(stream) < reuse
                    content = hashlib.sha256(raw).hexdigest() if part == "payload" else None
                    out.append((path, seq, part, off, len(stream), REGENERATE if again else RETAIN, level, content, raw if again else stream))
            yield pd.DataFrame(out, columns=["path", "seq", "part", "off", "len", "mode", "level", "content", "keep"])

    parts = cut(bounded(members.select("path", "data")).mapInPandas(run, "path string, seq long, part string, off long, len long, mode long, level long, content string, keep binary"))
    large = parts.where((F.col("part") == "payload") & (F.col("mode") == RETAIN) & (F.col("len") >= reuse))
    streams = large.select("content", F.sha2("keep", 256).alias("stream"), F.col("len").alias("size"), F.concat_ws("/", F.col("path"), F.lpad(F.col("seq").cast("string"), 12, "0")).alias("at"))
    best = canonical_stream(streams).select("content", F.col("stream").alias("best"))
    told = parts.join(best, "content", "left")
    own = F.col("best").isNotNull() & (F.col("mode") == RETAIN) & (F.sha2("keep", 256) == F.col("best"))
    mode = F.when(own, CANONICAL).otherwise(F.col("mode")).cast("long")
    return told.select("path", "seq", "part", "off", "len", mode.alias("mode"), "level", "content", F.when(~F.coalesce(own, F.lit(False)), F.col("keep")).alias("keep"), F.when(own, F.col("best")).alias("stream"))


def canonical_payloads(members: DataFrame, recipe: DataFrame) -> DataFrame:
    """``(stream, data)``: the canonical streams of a recipe, once each, cut from its members."""
    first = recipe.where(F.col("mode") == CANONICAL).groupBy("stream").agg(F.min(F.struct("path", "off", "len")).alias("b")).select("stream", "b.*")
    return first.join(members.select("path", "data"), "path").select("stream", F.substring("data", F.col("off").cast("int") + 1, F.col("len").cast("int")).alias("data"))


def streams(recipe: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Adds ``bytes``, what each part of a recipe is in its container: by mode."""

    @F.pandas_udf("binary")
    def again(keep: pd.Series, mode: pd.Series, level: pd.Series) -> pd.Series:
        def one(k: bytes, m: int, n: int) -> bytes | None:
            if m != REGENERATE:
                return None if k is None else bytes(k)
            c = zlib.compressobj(int(n), zlib.DEFLATED, -15)
            return c.compress(bytes(k)) + c.flush()

        return pd.Series([one(*x) for x in zip(keep, mode, level, strict=True)], dtype=object)

    told = bounded(recipe).withColumn("bytes", again("keep", "mode", "level"))
    if canonical is None:
        return told
    kept = canonical.select("stream", F.col("data").alias("__c"))
    return told.join(kept, "stream", "left").withColumn("bytes", F.coalesce("bytes", "__c")).drop("__c")


def rebuild(recipe: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """``(path, data)`` again, parts in order; null where a canonical stream is missing."""
    parts = streams(recipe, canonical).select("path", "seq", "bytes", F.col("len"))
    whole = F.count("bytes") == F.count("*")
    return parts.groupBy("path").agg(F.when(whole, F.expr("listagg(bytes, x'') WITHIN GROUP (ORDER BY seq)")).alias("data"))


def read_range(recipe: DataFrame, requests: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """``(path, start, length, data)`` of byte ranges of containers: only the parts that a
    range touches are regenerated or read."""
    met = overlaps(recipe, requests, "path")
    cut_ = streams(met, canonical)
    piece = F.substring("bytes", F.col("at").cast("int") + 1, F.col("take").cast("int"))
    return cut_.withColumn("piece", piece).groupBy("path", "start", "length").agg(F.expr("listagg(piece, x'') WITHIN GROUP (ORDER BY seq)").alias("data"))


def range_plan(parts: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """What a range reads of each part of a recipe: ``(key, start, length, seq, part_off,
    out_off, take)``; ``parts(key, seq, off, len)`` are literals and payloads in turn."""
    met = overlaps(parts, requests, key)
    return met.select(key, "start", "length", "seq", F.col("at").alias("part_off"), F.col("to").alias("out_off"), "take")


def deflated(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


def deflates(packed, size):
    """Whether an export takes the Deflate form: only if it saves over four bytes."""
    return packed + 4 < size


def reusable(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Entries ``(path, kind, storage, ref)`` whose stored Deflate stream an export can take
    as it is: files and links of one Deflate blob. Adds its ``csize``."""
    whole = entries.where("kind IN ('file', 'symlink') AND storage = 'blob'")
    return whole.join(blobs.where(F.col("codec") == DEFLATE).select(F.col("blob_id").alias("ref"), "csize"), "ref").select("path", "ref", "csize")


def export_sizes(members: DataFrame, level: int = 6) -> DataFrame:
    """``(path, size, packed)``: what Deflate makes of each member."""

    @F.pandas_udf("long")
    def size(data: pd.Series) -> pd.Series:
        return pd.Series([len(deflated(bytes(x), level)) for x in data], dtype="int64")

    return bounded(members).select("path", "size", size("data").alias("packed"))


def export_choice(sizes: DataFrame) -> DataFrame:
    """``(path, method, csize)`` of a ZIP export from ``sizes(path, size, packed)``."""
    wins = deflates(F.col("packed"), F.col("size"))
    return sizes.select("path", F.when(wins, DEFLATED).otherwise(STORED).cast("long").alias("method"), F.when(wins, F.col("packed")).otherwise(F.col("size")).alias("csize"))


def export_plan(members: DataFrame, level: int = 6) -> DataFrame:
    return export_choice(export_sizes(members, level))
