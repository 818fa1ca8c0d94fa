"""Codecs: trials in Arrow batches, the choice among them in SQL."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, cut

#: Codec ids (fixed values); 2 needs an audio library and is reserved.
RAW, ZSTD, WAVFLAC, ZSTD_DICT, DEFLATE = range(5)
GAIN = 16
#: Size of a dictionary, the least number and bytes of its samples, and the most bytes
#: that it is trained on.
DICT_BYTES, DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_MOST_BYTES = 24 << 10, 16, 96 << 10, 8 << 20


def levels(size: int, packed: bool = False) -> tuple[int, ...]:
    """Compression levels that are tried for a content of ``size``."""
    if packed:
        return (15, 12, 9)
    return (12, 9, 5) if size < 64 << 10 else (9, 5, 3) if size < 512 << 10 else (5, 3)


def train_dictionary(samples: DataFrame, size: int = DICT_BYTES, least: int = DICT_SAMPLES, least_bytes: int = DICT_SAMPLE_BYTES, most_bytes: int = DICT_MOST_BYTES) -> bytes | None:
    """A Zstandard dictionary of ``samples(sha, data)``, the smallest and then those of
    least hash; None for fewer than ``least`` samples or ``least_bytes`` in all.

    Training takes place on the driver on a sample bounded by ``most_bytes``: sizes are
    summed in ranges of the order, and only the samples that fit are fetched.
    """
    import zstandard

    sizes = cut(samples.select("sha", F.octet_length("data").cast("long").alias("n")).where("n BETWEEN 1 AND 32768").distinct())
    total = sizes.agg(F.count("*"), F.sum("n")).first()
    if total[0] < least or total[1] < least_bytes:
        return None
    share = min(1.0, 2.0 * most_bytes / total[1])
    # hashes are uniform, so a prefix of them is a fair share of all
    chosen, used = [], 0
    for r in sizes.where(F.conv(F.substring("sha", 1, 8), 16, 10).cast("double") / 2.0**32 < share).orderBy("n", "sha").limit(2 * most_bytes // max(1, total[1] // total[0]) + least).toLocalIterator():
        if used + r["n"] > most_bytes:
            break
        chosen.append((r["sha"],))
        used += r["n"]
    if len(chosen) < least:
        return None
    keep = samples.sparkSession.createDataFrame(chosen, "sha string")
    data = samples.select("sha", "data").join(F.broadcast(keep), "sha").groupBy("sha").agg(F.min("data").alias("data")).orderBy("sha").collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["data"]) for r in data]).as_bytes()
    except zstandard.ZstdError:
        return None


def trials(blobs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``(sha, raw, trial, codec, total)`` of every codec tried on ``blobs(sha, data)``;
    total counts the payload and two bytes for the level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for rows in batches:
            out = []
            for sha, data in zip(rows["sha"], rows["data"], strict=True):
                data = bytes(data)
                tried = [(ZSTD, zstandard.ZstdCompressor(level=n).compress(data)) for n in levels(len(data))]
                if dictionary:
                    tried.append((ZSTD_DICT, with_dictionary(data, dictionary)))
                out += [(sha, len(data), i, codec, len(comp) + 2) for i, (codec, comp) in enumerate(tried)]
            yield pd.DataFrame(out, columns=["sha", "raw", "trial", "codec", "total"])

    return bounded(blobs.select("sha", "data")).mapInPandas(run, "sha string, raw long, trial long, codec long, total long")


def with_dictionary(data: bytes, dictionary: bytes, level: int = 12) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(data)


def unpacked(payload: bytes, codec: int, usize: int, dictionary: bytes | None = None) -> bytes:
    """The bytes of a stored payload; ValueError if it is damaged, of another length, or of
    a codec that is reserved or needs a dictionary that is not there."""
    import zstandard

    try:
        if codec == RAW:
            data = payload
        elif codec == ZSTD:
            data = zstandard.ZstdDecompressor().decompress(payload, max_output_size=usize)
        elif codec == ZSTD_DICT and dictionary:
            data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(payload, max_output_size=usize)
        elif codec == DEFLATE:
            data = inflated(payload, usize)
        else:
            raise ValueError(f"codec {codec} is not supported here")
    except (zstandard.ZstdError, zlib.error) as e:
        raise ValueError(str(e)) from e
    if data is None or len(data) != usize:
        raise ValueError("the payload has another length")
    return data


def inflated(stream: bytes, most: int | None = None) -> bytes | None:
    """The bytes of a raw Deflate stream; None if it is broken, bytes follow it, or it has
    more than ``most``."""
    d = zlib.decompressobj(-15)
    try:
        raw = d.decompress(stream, 0 if most is None else most + 1)
    except zlib.error:
        return None
    return raw if d.eof and not d.unused_data and (most is None or len(raw) <= most) else None


def inflated_range(streams: DataFrame) -> DataFrame:
    """Adds ``part``, bytes ``start`` to ``start + length`` of what each Deflate stream ``data``
    holds, for streams whose whole content has the hash ``sha`` and the size ``usize``;
    null for the others, and for ranges that pass the end."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, usize: pd.Series, sha: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        def one(x, n, h, a, k):
            raw = None if x is None else inflated(bytes(x), int(n))
            good = raw is not None and len(raw) == n and hashlib.sha256(raw).hexdigest() == h and 0 <= a and a + k <= n
            return raw[int(a) : int(a + k)] if good else None

        return pd.Series([one(*v) for v in zip(data, usize, sha, start, length, strict=True)], dtype=object)

    return bounded(streams).withColumn("part", run("data", "usize", "sha", "start", "length"))


def bypassed(blobs: DataFrame) -> DataFrame:
    """Codecs that no contest decides, of ``blobs(sha, role, canonical)``: the dictionary and
    retained streams stay raw, content with a canonical Deflate stream keeps that one,
    even if it is larger. Null where the contest decides."""
    rule = F.when(F.col("role").isin("dictionary", "retained"), RAW).when(F.col("canonical"), DEFLATE)
    return blobs.withColumn("codec", rule.cast("long"))


def decide(blobs: DataFrame, tried: DataFrame) -> DataFrame:
    """``(sha, codec, stored)`` by the bypass rules, then the ``tournament`` of ``tried``;
    ``blobs(sha, role, canonical, raw, stream)`` has the length of the canonical stream."""
    fixed = bypassed(blobs).select("sha", "codec", "raw", "stream")
    won = tournament(tried).select("sha", F.col("codec").alias("c"), F.col("stored").alias("s"))
    both = fixed.join(won, "sha", "left")
    stored = F.when(F.col("codec") == RAW, F.col("raw")).when(F.col("codec") == DEFLATE, F.col("stream")).otherwise(F.coalesce("s", "raw"))
    return both.select("sha", F.coalesce("codec", "c", F.lit(RAW)).cast("long").alias("codec"), stored.alias("stored"))


def decoded_twins(members: DataFrame, least: int = 32 << 10) -> DataFrame:
    """Members that are another one compressed: ``(path, twin, codec)``. Of the compressed
    forms of one content Zstandard goes first, then gzip, bzip2 and xz; then the shortest, then the path."""

    @F.pandas_udf("sha string, codec string, rank int")
    def run(data: pd.Series) -> pd.DataFrame:
        def one(x):
            for rank, (codec, magic, f) in enumerate(_DECODERS):
                if x is not None and bytes(x[: len(magic)]) == magic:
                    raw = f(bytes(x))
                    return (hashlib.sha256(raw).hexdigest(), codec, rank) if raw is not None and len(raw) >= least else (None, None, None)
            return None, None, None

        return pd.DataFrame([one(x) for x in data], columns=["sha", "codec", "rank"])

    told = bounded(members).select("path", F.octet_length("data").alias("csize"), run("data").alias("r")).where("r.sha IS NOT NULL").select("path", "csize", "r.*")
    whole = members.select(F.col("path").alias("twin"), F.sha2("data", 256).alias("sha"))
    met = told.join(whole, "sha").where("path != twin").groupBy("twin").agg(F.min(F.struct("rank", "csize", "path", "codec")).alias("b"))
    return met.select("b.path", "twin", "b.codec")


def _zstd(x: bytes) -> bytes | None:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(x, max_output_size=256 << 20)
    except zstandard.ZstdError:
        return None


def _quiet(f, *errors):
    def run(x: bytes) -> bytes | None:
        try:
            return f(x)
        except errors:
            return None

    return run


_DECODERS = (
    ("zstd", b"\x28\xb5\x2f\xfd", _zstd), ("gzip", b"\x1f\x8b", _quiet(gzip.decompress, OSError, EOFError, zlib.error)),
    ("bzip2", b"BZh", _quiet(bz2.decompress, OSError, ValueError, EOFError)), ("xz", b"\xfd7zXZ\x00", _quiet(lzma.decompress, lzma.LZMAError, EOFError)),
)


def lzma_trial(blobs: DataFrame, dictionaries: tuple[int, ...] = (1 << 20, 4 << 20, 8 << 20), charge: int = 16) -> DataFrame:
    """``(sha, raw, dictionary, total)`` of raw LZMA2 at several dictionary sizes; each result
    is decoded again, and one that does not come back is left out. A control: it is
    measured beside the codecs of the store, not among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for sha, data in zip(rows["sha"], rows["data"], strict=True):
                data = bytes(data)
                for n in dictionaries:
                    filters = [{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": n}]
                    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=filters)
                    if lzma.decompress(packed, lzma.FORMAT_RAW, filters=filters) == data:
                        out.append((sha, len(data), n, len(packed) + charge))
            yield pd.DataFrame(out, columns=["sha", "raw", "dictionary", "total"])

    return bounded(blobs.select("sha", "data")).mapInPandas(run, "sha string, raw long, dictionary long, total long")


def pack_trials(packs: DataFrame, level: int = 3) -> DataFrame:
    """``(by, pack, raw, packed)``: what a level makes of each of ``packs(by, pack, data)``."""

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        return pd.Series([len(c.compress(bytes(x))) for x in data], dtype="int64")

    return bounded(packs).select("by", "pack", F.octet_length("data").cast("long").alias("raw"), run("data").alias("packed"))


def tournament(tried: DataFrame) -> DataFrame:
    """The codec of each content: the least total, of equal ones the earliest trial;
    raw unless that saves more than GAIN bytes."""
    best = tried.groupBy("sha", "raw").agg(F.min(F.struct("total", "trial", "codec")).alias("b"))
    wins = F.col("b.total") + GAIN < F.col("raw")
    return best.select("sha", "raw", F.when(wins, F.col("b.codec")).otherwise(RAW).cast("long").alias("codec"), F.when(wins, F.col("b.total")).otherwise(F.col("raw")).alias("stored"))


def canonical_stream(streams: DataFrame) -> DataFrame:
    """Of the compressed forms ``(content, stream, size, at)`` of each content: the most
    frequent, then the shortest, then the first met."""
    kinds = streams.groupBy("content", "stream").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("at").alias("at"))
    line = Window.partitionBy("content").orderBy(F.desc("n"), "size", "at")
    return kinds.withColumn("r", F.row_number().over(line)).where("r = 1").drop("r", "at")


def inflate(blobs: DataFrame) -> DataFrame:
    """Adds ``raw``, the bytes of a raw Deflate stream ``data``; null if it is broken
    or bytes follow it."""

    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else inflated(bytes(x)) for x in data], dtype=object)

    return bounded(blobs).withColumn("raw", run("data"))


def deflate_level(raw: bytes, stream: bytes) -> int | None:
    """The level at which ``raw`` gives exactly ``stream``, if there is one."""
    for level in range(10):
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        if c.compress(raw) + c.flush() == stream:
            return level
    return None
