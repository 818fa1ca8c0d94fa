"""Structural preflight: the rules of a catalog, all violations together."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical, path_fault
from .journal import chain_depths

#: Limits of a parser; each can be replaced, all must be positive (fixed values).
LIMITS = {
    "index_bytes": 256 << 20, "generation_bytes": 256 << 20, "blob_bytes": 1 << 30, "files": 4_000_000, "blobs": 4_000_000,
    "recipes": 1_000_000, "path_bytes": 1 << 20, "delta_depth": 128,
}
FILE, DIR, SYMLINK, HARDLINK = range(4)
CODECS = (0, 1, 2, 3, 4)
#: How a file is stored: one whole blob, whole blobs in turn, a container's recipe, data
#: between holes, a slice of a pack, chunks cut by content.
STORAGE = ("blob", "chunks", "recipe", "sparse", "pack", "cdc")


def limits(changed: dict[str, int] | None = None) -> dict[str, int]:
    """LIMITS with those that the environment (SPARKSTORE_MAX_<NAME>) and then the caller change."""
    most = LIMITS | {k: int(v) for k in LIMITS if (v := os.environ.get(f"SPARKSTORE_MAX_{k.upper()}"))} | (changed or {})
    if set(most) != set(LIMITS) or min(most.values()) <= 0:
        raise ValueError("limits must be known and positive")
    return most


def _broken(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """``(rule, subject)`` of each rule that a row breaks: one pass, whatever the number of rules."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()]))
    return df.select(F.explode(names).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _over(counts: DataFrame, most: dict[str, int], name: str) -> DataFrame:
    return counts.agg(F.count("*").alias("n")).where(F.col("n") > most[name]).select(F.lit(f"limit_{name}").alias("rule"), F.lit(name).alias("subject"))


def _with(df: DataFrame, **defaults: str) -> DataFrame:
    """``df`` with nulls of a type for the columns that it does not have."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in defaults.items() if c not in df.columns])


def entry_faults(entries: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rules on ``entries(path, kind, size, mtime_ns, link_target)``, and ``mode``, ``sha`` and
    ``storage`` where it has them."""
    have = set(entries.columns)
    e = _with(entries, mode="int", sha="string", storage="string")
    kind = F.col("kind")
    rules = {
        "path_unsafe": path_fault(F.col("path"), most["path_bytes"]).isNotNull(),
        "kind_unknown": ~kind.isin(FILE, DIR, SYMLINK, HARDLINK),
        "size_negative": F.col("size") < 0,
        "mtime_missing": F.col("mtime_ns").isNull(),
        "dir_with_size": F.coalesce((kind == DIR) & (F.col("size") > 0), F.lit(False)),
        "link_without_target": F.coalesce((kind == HARDLINK) & F.col("link_target").isNull(), F.lit(False)),
    }
    if "mode" in have:
        rules["mode_range"] = (F.col("mode") < 0) | (F.col("mode") > 0o7777)
    if "sha" in have:
        rules["hash_malformed"] = F.coalesce(~F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False))
    if "storage" in have:
        file = F.coalesce(F.col("storage").isin(*STORAGE), F.lit(False))
        fits = F.when(kind == FILE, file | (F.col("storage").isNull() & (F.col("size") == 0))).when(kind == SYMLINK, F.coalesce(F.col("storage") == "blob", F.lit(False))).otherwise(F.col("storage").isNull())
        rules["storage_kind"] = ~fits
    twice = e.groupBy(canonical(F.col("path")).alias("p")).count().where("count > 1").select(F.lit("path_duplicate").alias("rule"), F.col("p").alias("subject"))
    links = e.where(kind == HARDLINK).select("path", "link_target")
    target = e.select(F.col("path").alias("link_target"), kind.alias("target_kind"))
    linked = links.where("link_target IS NOT NULL").join(target, "link_target", "left")
    chained = _broken(linked, "path", {"hardlink_missing": F.col("target_kind").isNull(), "hardlink_chain": F.coalesce(F.col("target_kind") == HARDLINK, F.lit(False)), "hardlink_not_file": F.coalesce(F.col("target_kind").isin(DIR, SYMLINK), F.lit(False))})
    return _broken(e, "path", rules).unionByName(twice).unionByName(chained).unionByName(_over(e, most, "files"))


def blob_faults(blobs: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rules on ``blobs(blob_id, usize, csize, codec)``, and ``meta_len`` where it has it."""
    u, c, codec = F.col("usize"), F.col("csize"), F.col("codec")
    rules = {
        "codec_unknown": ~codec.isin(*CODECS),
        "blob_negative": (u < 0) | (c < 0),
        "blob_limit": (u > most["blob_bytes"]) | (c > most["blob_bytes"]),
        "raw_size": F.coalesce((codec == 0) & (u != c), F.lit(False)),
    }
    if "meta_len" in blobs.columns:
        rules["meta_length"] = F.when(codec == 2, F.col("meta_len") <= 0).otherwise(F.col("meta_len") != 0)
    twice = blobs.groupBy("blob_id").count().where("count > 1").select(F.lit("blob_duplicate").alias("rule"), F.col("blob_id").cast("string").alias("subject"))
    return _broken(blobs, "blob_id", rules).unionByName(twice).unionByName(_over(blobs, most, "blobs"))


def storage_faults(entries: DataFrame, blobs: DataFrame, extents: DataFrame) -> DataFrame:
    """Rules on ``extents(path, seq, off, len, blob_id, blob_off)`` against entries and blobs.

    Extents of a path are in order of seq. They tile it without gaps, but for sparse
    ones, which rise, do not overlap and end before the end. A ``blob`` is one whole
    blob, ``chunks`` and ``cdc`` are whole ones (cdc none of length 0), a ``pack`` is
    one slice. Without a ``storage`` only tiling and slices are checked.
    """
    e = _with(entries, storage="string").select("path", "kind", "size", "storage")
    known = blobs.groupBy("blob_id").agg(F.max("usize").alias("usize"))
    line = Window.partitionBy("path").orderBy("seq", "off")
    used = extents.join(known, "blob_id", "left").withColumn("end", F.lag(F.col("off") + F.col("len")).over(line)).withColumn("same", F.lag("seq").over(line) == F.col("seq"))
    met = used.join(e, "path", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    storage = F.coalesce("storage", F.lit(""))
    hit = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "extent_orphan": F.col("kind").isNull(),
        "dir_with_data": hit(F.col("kind") == DIR),
        "link_with_data": hit(F.col("kind") == HARDLINK),
        "seq_duplicate": hit(F.col("same")),
        "extent_negative": (F.col("len") < 0) | (F.col("off") < 0),
        "extent_gap": hit((storage != "sparse") & (F.col("off") != F.col("end"))),
        "sparse_overlap": hit((storage == "sparse") & (F.col("off") < F.col("end"))),
        "blob_missing": F.col("usize").isNull(),
        "slice_outside": hit((F.col("blob_off") < 0) | (F.col("blob_off") + F.col("len") > F.col("usize"))),
        "blob_not_whole": hit(storage.isin("blob", "chunks", "cdc") & ((F.col("blob_off") != 0) | (F.col("len") != F.col("usize")))),
        "chunk_empty": hit((storage == "cdc") & (F.col("len") < 1)),
    }
    whole = extents.groupBy("path").agg(F.sum("len").alias("covered"), F.max(F.col("off") + F.col("len")).alias("last"), F.count("*").alias("n"))
    files = e.where((F.col("kind") == FILE) & (storage != "recipe")).join(whole, "path", "left")
    covered, n = F.coalesce("covered", F.lit(0)), F.coalesce("n", F.lit(0))
    total = {
        "extent_total": hit((storage != "sparse") & (F.col("size") >= 0) & (covered != F.col("size"))),
        "sparse_outside": hit((storage == "sparse") & (F.col("last") > F.col("size"))),
        "one_slice": hit(storage.isin("blob", "pack") & (n != 1)),
    }
    return _broken(met, "path", rules).unionByName(_broken(files, "path", total))


def recipe_faults(recipes: DataFrame, payloads: DataFrame, blobs: DataFrame, entries: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rules on ``recipes(recipe_id, path, size, literals array<long>, skeleton)`` and their
    ``payloads(recipe_id, seq, raw_ref, method, mode, stream_ref, csize, level)``."""
    hit = lambda c: F.coalesce(c, F.lit(False))
    known = blobs.groupBy("blob_id").agg(F.max("usize").alias("usize"))
    side = lambda ref, out: known.select(F.col("blob_id").alias(ref), F.col("usize").alias(out))
    p = payloads.join(side("raw_ref", "raw_size"), "raw_ref", "left").join(side("stream_ref", "stream_size"), "stream_ref", "left")
    rows = {
        "recipe_method": ~F.col("method").isin(0, 8),
        "recipe_mode": ~F.col("mode").isin(0, 1, 2),
        "recipe_level": (F.col("level") < -1) | (F.col("level") > 9),
        "recipe_no_level": hit((F.col("method") == 8) & (F.col("mode") == 2) & (F.col("level") < 0)),
        "recipe_raw_missing": F.col("raw_size").isNull(),
        "recipe_stream_missing": hit((F.col("mode") == 1) & F.col("stream_size").isNull()),
        "recipe_stored_size": hit((F.col("method") == 0) & (F.col("csize") != F.col("raw_size"))),
    }
    sums = payloads.groupBy("recipe_id").agg(F.count("*").alias("n"), F.sum("csize").alias("bytes"))
    size = entries.select("path", F.col("size").alias("entry_size"))
    r = recipes.join(sums, "recipe_id", "left").join(size, "path", "left").join(side("skeleton", "skeleton_size"), "skeleton", "left")
    literal = F.aggregate("literals", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = {
        "recipe_literals": F.size("literals") != F.coalesce("n", F.lit(0)) + 1,
        "recipe_literal_negative": F.exists("literals", lambda x: x < 0),
        "recipe_size": literal + F.coalesce("bytes", F.lit(0)) != F.col("size"),
        "recipe_entry_size": F.col("entry_size") != F.col("size"),
        "recipe_skeleton": F.col("skeleton_size") != literal,
    }
    return _broken(p, "recipe_id", rows).unionByName(_broken(r, "recipe_id", whole)).unionByName(_over(recipes, most, "recipes"))


def header_faults(blobs: DataFrame, headers: DataFrame, file_bytes: int | None = None) -> DataFrame:
    """What the record headers ``(blob_id, at, magic, flags, codec, usize, csize, meta_len)`` of a file say
    against the index; no payload is read. ``header_outside`` needs the file's length."""
    h = headers.select("blob_id", *[F.col(c).alias(f"h_{c}") for c in ("at", "magic", "flags", "codec", "usize", "csize", "meta_len")])
    both = _with(blobs, meta_len="long").join(h, "blob_id", "left")
    hit = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "header_missing": F.col("h_at").isNull(),
        "header_magic": hit(~F.col("h_magic")),
        "header_flags": hit(F.col("h_flags") != 0),
        "header_differs": hit((F.col("h_codec") != F.col("codec")) | (F.col("h_usize") != F.col("usize")) | (F.col("h_csize") != F.col("csize")) | (F.col("h_meta_len") != F.coalesce("meta_len", F.lit(0)))),
    }
    if file_bytes is not None:
        rules["header_outside"] = hit((F.col("h_at") < 0) | (F.col("h_at") + F.col("h_csize") > file_bytes))
    return _broken(both, "blob_id", rules)


def record_faults(records: DataFrame, file_bytes: int, most_raw: int = 8 << 20, most_packed: int = 96 << 20) -> DataFrame:
    """Rules on the physical ``records(record_id, at, header, codec, usize, csize)`` of a graph:
    inside the file, a known codec, bounded sizes, rising offsets without overlap."""
    line = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # ends of ranges of offsets first: records are many, ranges of the file are not
    ranged = records.withColumn("__b", F.floor(F.col("at") / (64 << 20)))
    ends = ranged.groupBy("__b").agg(F.max(F.col("at") + F.col("header") + F.col("csize")).alias("e")).withColumn("ahead", F.max("e").over(line)).drop("e")
    inside = Window.partitionBy("__b").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(ends, "__b").withColumn("before", F.greatest(F.coalesce("ahead", F.lit(0)), F.coalesce(F.max(F.col("at") + F.col("header") + F.col("csize")).over(inside), F.lit(0))))
    rules = {
        "record_outside": (F.col("at") < 0) | (F.col("at") + F.col("header") + F.col("csize") > file_bytes),
        "record_codec": ~F.col("codec").isin(*CODECS),
        "record_raw": (F.col("usize") < 0) | (F.col("usize") > most_raw),
        "record_packed": (F.col("csize") < 0) | (F.col("csize") > most_packed),
        "record_overlap": F.col("at") < F.col("before"),
    }
    return _broken(both, "record_id", rules)


def metadata_faults(metadata: DataFrame, most_bytes: int = 64 << 20, most_records: int = 1_000_000) -> DataFrame:
    """What of the ``metadata(copy, bytes, sha, found_sha, root, found_root, records, depth, declared_records,
    declared_depth)`` of a graph is not authentic or beyond its ceilings."""
    rules = {
        "metadata_bytes": F.col("bytes") > most_bytes,
        "metadata_hash": F.col("sha") != F.col("found_sha"),
        "metadata_root": F.col("root") != F.col("found_root"),
        "metadata_records": (F.col("records") > most_records) | (F.col("records") > F.col("declared_records")),
        "metadata_depth": (F.col("depth") > 1) | (F.col("depth") > F.col("declared_depth")),
    }
    return _broken(metadata, "copy", rules)


def generation_faults(generations: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rules on ``generations(gen, prev, full, bytes)``: chains and sizes."""
    chains = chain_depths(generations, most["delta_depth"]).where("fault IS NOT NULL").select(F.concat(F.lit("chain_"), "fault").alias("rule"), F.col("gen").cast("string").alias("subject"))
    large = F.when(F.col("full"), F.col("bytes") > most["index_bytes"]).otherwise(F.col("bytes") > most["generation_bytes"])
    return chains.unionByName(_broken(generations, "gen", {"generation_bytes": large}))


def violations(
    entries: DataFrame, blobs: DataFrame, extents: DataFrame, changed: dict[str, int] | None = None, recipes: DataFrame | None = None,
    payloads: DataFrame | None = None, headers: DataFrame | None = None, generations: DataFrame | None = None, file_bytes: int | None = None,
) -> DataFrame:
    """``(rule, subject, n)`` of every broken rule; nothing if the catalog is sound.

    A reader that stops at its first fault sees one of these; here all are
    collected, and no rule needs a payload. Rules on a row are taken in one pass
    over each table, those between tables in one join each. Columns and tables that
    are not given are not checked; a null in a checked column breaks its rule.
    """
    most = limits(changed)
    found = [entry_faults(entries, most), blob_faults(blobs, most), storage_faults(entries, blobs, extents)]
    if recipes is not None and payloads is not None:
        found.append(recipe_faults(recipes, payloads, blobs, entries, most))
    if headers is not None:
        found.append(header_faults(blobs, headers, file_bytes))
    if generations is not None:
        found.append(generation_faults(generations, most))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("rule", "subject").agg(F.count("*").alias("n"))


def summary(entries: DataFrame, blobs: DataFrame, recipes: DataFrame | None = None, generations: DataFrame | None = None) -> DataFrame:
    """Counts of a catalog, from its metadata alone: one row."""
    counts = entries.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("files", "dirs", "symlinks", "hardlinks"))], F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
    out = counts.crossJoin(F.broadcast(blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("usize"), F.lit(0)).alias("blob_bytes"))))
    if recipes is not None:
        out = out.crossJoin(F.broadcast(recipes.agg(F.count("*").alias("recipes"))))
    if generations is not None:
        deep = chain_depths(generations).agg(F.max("depth").alias("delta_depth"))
        out = out.crossJoin(F.broadcast(generations.agg(F.max("gen").alias("latest")))).crossJoin(F.broadcast(deep))
    return out
