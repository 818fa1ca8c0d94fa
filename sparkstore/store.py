"""A store in a folder: blobs and a journal of generations as Parquet tables.

A generation is a set of journal rows (put or del of a path) written before the row
in ``generations`` that names it, so a reader sees a generation whole or not at all.
Contents are cut by content, stored once by hash, and never rewritten; a rename is a
put and a del of one generation, so replay stays one aggregation.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import canonical, path_fault, sha
from .operators import chunking, codecs, journal, planning, recipes, validate, verify
from .operators.journal import CHECKPOINT_DEPTH
from .shared import bounded, cut

ENTRY = "gen long, op string, path string, kind string, target string, mode int, mtime_ns long, uid long, gid long, xattrs map<string,binary>, size long, sha string, parts array<struct<seq:long,off:long,len:long,sha:string>>"
NAMES = ["gen", "op", "path", "kind", "target", "mode", "mtime_ns", "uid", "gid", "xattrs", "size", "sha", "parts"]
BLOB = "sha string, usize long, csize long, codec long, crc long, payload binary"
GENERATION = "gen long, kind string, token string, prev long, depth long, puts long, dels long, new_blobs long, digest long"
STAGED = f"path string, seq long, off long, {BLOB}"


def stage(members: DataFrame, sizes: tuple[int, int, int], level: int | None = None, dictionary: bytes | None = None) -> DataFrame:
    """Chunks of ``members(path, data)``, each hashed and in its stored form, and for each member
    a row of seq -1 with its size (as off) and hash. A member's data is read once.

    Stored is the shortest of Zstandard at the levels for its size (or at ``level``) and,
    where there is a dictionary, with that, if it saves over 16 bytes; else raw.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        table, names = chunking.gear(), [c.split()[0] for c in STAGED.split(", ")]
        for rows in batches:
            for path, data in zip(rows["path"], rows["data"], strict=True):
                if data is None:
                    raise ValueError(f"{path!r} cannot be read")
                data, at = bytes(data), 0
                out = [(path, -1, len(data), hashlib.sha256(data).hexdigest(), 0, 0, 0, 0, b"")]
                for seq, end in enumerate(chunking.cuts(data, *sizes, table)):
                    part, off, at = data[at:end], at, end
                    tried = [(codecs.ZSTD, zstandard.ZstdCompressor(level=n).compress(part)) for n in (codecs.levels(len(part)) if level is None else (level,))]
                    if dictionary:
                        tried.append((codecs.ZSTD_DICT, codecs.with_dictionary(part, dictionary)))
                    codec, kept = min(tried, key=lambda x: len(x[1]))
                    if len(kept) + codecs.GAIN >= len(part):
                        codec, kept = codecs.RAW, part
                    out.append((path, seq, off, hashlib.sha256(part).hexdigest(), len(part), len(kept), codec, zlib.crc32(part), kept))
                yield pd.DataFrame(out, columns=names)

    return bounded(members.select("path", "data")).mapInPandas(run, STAGED)


def decode(blobs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """Adds ``data``, null where a payload is damaged: length and CRC32 are checked."""

    @F.pandas_udf("binary")
    def run(payload: pd.Series, codec: pd.Series, usize: pd.Series, crc: pd.Series) -> pd.Series:
        def one(p, c, n, k):
            try:
                data = codecs.unpacked(bytes(p), int(c), int(n), dictionary)
            except ValueError:
                return None
            return data if zlib.crc32(data) == k else None

        return pd.Series([one(*x) for x in zip(payload, codec, usize, crc, strict=True)], dtype=object)

    return bounded(blobs).withColumn("data", run("payload", "codec", "usize", "crc"))


class Store:
    """Opens the store in ``root``, at its newest generation or at ``gen``.

    A generation's rows and payloads lie in folders of a name of their own, which its
    commit row names; the commit row is a file that is made only if there is none of
    its number. So what a writer that died has left is never read, and of two
    writers of one number the second fails.
    """

    def __init__(self, spark: SparkSession, root: str, gen: int | None = None):
        self.spark, self.root, self.at = spark, root.rstrip("/"), gen

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def generations(self) -> DataFrame:
        """``(gen, kind, token, prev, depth, puts, dels, new_blobs, digest)`` of what is committed."""
        if not self._there("generations"):
            return self.spark.createDataFrame([], GENERATION)
        return self.spark.read.schema(GENERATION).json(f"{self.root}/generations")

    def _chain(self) -> list:
        """Generations up to this store's own, from the last full one on."""
        rows = sorted(self.generations().collect(), key=lambda r: r["gen"])
        rows = [r for r in rows if self.at is None or r["gen"] <= self.at]
        full = max((i for i, r in enumerate(rows) if r["kind"] == "full"), default=0)
        return rows[full:]

    def _read(self, table: str, tokens: list[str], schema: str) -> DataFrame:
        paths = [f"{table}/{t}" for t in tokens if self._there(f"{table}/{t}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def blobs(self) -> DataFrame:
        return self._read("blobs", [r["token"] for r in self.generations().where("new_blobs > 0").select("token").collect()], BLOB)

    def dictionary(self) -> bytes | None:
        fs, path = self._fs("dictionary.bin")
        if not fs.exists(path):
            return None
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/dictionary.bin").first()["content"])

    def newest(self) -> int:
        """The newest committed generation, -1 for none."""
        top = self.generations().agg(F.max("gen")).first()[0]
        return -1 if top is None else top

    def entries(self) -> DataFrame:
        """Live entries: of each path the newest committed put that no del follows."""
        rows = self._read("journal", [r["token"] for r in self._chain()], ENTRY)
        last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in NAMES if c != "path"]), F.struct("gen", (F.col("op") == "put"))).alias("r"))
        return last.where("r.op = 'put'").select("path", "r.*").select(*NAMES)

    def commit(self, rows: DataFrame, staged: DataFrame | None, kind: str) -> int:
        """Blobs that are new, then the journal rows, then the generation's row.

        A delta at depth CHECKPOINT_DEPTH of its chain is written as a full one: all live
        entries with the change in place, so that a reader never follows a longer chain.
        """
        chain, token, new = self._chain(), uuid.uuid4().hex, 0
        gen = self.newest() + 1
        if staged is not None:
            # of each new content one place, chosen without payloads, which then stay in their tasks
            place = staged.select("sha", "path", "seq").join(self.blobs().select("sha"), "sha", "left_anti").groupBy("sha").agg(F.min(F.struct("path", "seq")).alias("at"))
            fresh = staged.join(place.select("sha", "at.path", "at.seq"), ["sha", "path", "seq"], "left_semi")
            fresh.dropDuplicates(["sha", "path", "seq"]).select(*[c.split()[0] for c in BLOB.split(", ")]).write.parquet(f"{self.root}/blobs/{token}")
            new = self.spark.read.schema(BLOB).parquet(f"{self.root}/blobs/{token}").count()
        rows = rows.withColumn("gen", F.lit(gen).cast("long")).select(*NAMES)
        kind = kind if chain else "full"
        depth = 0 if kind == "full" else chain[-1]["depth"] + 1
        if depth > CHECKPOINT_DEPTH:
            rows = self.entries().join(rows.select("path"), "path", "left_anti").select(*NAMES).unionByName(rows.where("op = 'put'")).withColumn("gen", F.lit(gen).cast("long")).select(*NAMES)
            kind, depth = "full", 0
        rows.write.parquet(f"{self.root}/journal/{token}")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.root}/journal/{token}")
        told = written.agg(F.count_if(F.col("op") == "put"), F.count_if(F.col("op") == "del"), F.coalesce(F.bit_xor(F.xxhash64("op", "path", "sha", "size")), F.lit(0))).first()
        row = {"gen": gen, "kind": kind, "token": token, "prev": chain[-1]["gen"] if chain else -1, "depth": depth, "puts": told[0], "dels": told[1], "new_blobs": new, "digest": told[2]}
        fs, path = self._fs(f"generations/{gen:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"generation {gen} was committed by another writer") from e
        out.write((json.dumps(row) + "\n").encode())
        out.hsync()
        out.close()
        return gen

    def broken(self) -> DataFrame:
        """Committed generations whose journal is not what was committed: ``(gen, token)``."""
        bad = []
        for r in self.generations().collect():
            rows = self._read("journal", [r["token"]], ENTRY)
            if rows.agg(F.coalesce(F.bit_xor(F.xxhash64("op", "path", "sha", "size")), F.lit(0))).first()[0] != r["digest"]:
                bad.append((r["gen"], r["token"]))
        return self.spark.createDataFrame(bad, "gen long, token string")

    def put(self, members: DataFrame, kind: str = "update", sizes: tuple[int, int, int] = (chunking.MIN_SIZE, chunking.AVG_SIZE, chunking.MAX_SIZE), level: int | None = None) -> int:
        """Adds or replaces ``members(path, data)``, or entries of any kind with ``kind, mode,
        mtime_ns, target, uid, gid`` beside them.

        Unsafe paths, and two members of one path, are errors, told before anything is
        written. A member is cut by content, hashed and compressed in one pass.
        """
        told = _with_columns(members)
        path = canonical(F.col("path"))
        bad = told.select("path", path_fault(F.col("path")).alias("f")).where("f IS NOT NULL").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['path']!r}: {bad[0]['f']}")
        twice = told.groupBy(path.alias("p")).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['p']!r} is there {twice[0]['count']} times")
        told = told.withColumn("path", path)
        files = told.where("kind = 'file'")
        staged = cut(stage(files.select("path", "data"), sizes, level, self.dictionary()))
        parts = staged.where("seq >= 0").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "off", F.col("usize").alias("len"), "sha"))).alias("parts"))
        whole = staged.where("seq < 0").select("path", F.col("off").alias("n"), F.col("sha").alias("h"))
        none = F.array().cast("array<struct<seq:long,off:long,len:long,sha:string>>")
        rows = told.drop("data").join(parts, "path", "left").join(whole, "path", "left")
        rows = rows.select(F.lit("put").alias("op"), "path", "kind", "target", "mode", "mtime_ns", "uid", "gid", "xattrs", F.coalesce("n", F.lit(0)).alias("size"), F.col("h").alias("sha"), F.coalesce("parts", none).alias("parts"))
        return self.commit(rows, staged.where("seq >= 0"), kind)

    def build(self, tree: str, metadata: bool = True, reproducible: bool = False, epoch_ns: int = 0, level: int | None = None, train: bool = False) -> int:
        """Adds all that lies below a folder: files, directories, symlinks and hardlinks, with
        their modes, times, owners and attributes. ``train`` makes the store a
        dictionary of its small files first, if it has none and they are enough."""
        found = sources.scan(self.spark, tree, metadata, reproducible, epoch_ns)
        members = found.withColumn("data", F.when(F.col("kind") == "file", sources.contents(tree, F.col("path"))))
        if train and self.dictionary() is None:
            small = members.where("kind = 'file' AND size BETWEEN 1 AND 32768").select(sha(F.col("data")).alias("sha"), "data")
            made = codecs.train_dictionary(small)
            if made:
                fs, path = self._fs("dictionary.bin")
                out = fs.create(path, False)
                out.write(made)
                out.close()
        return self.put(members, "full" if self.newest() < 0 else "update", level=level)

    def _known(self, path: str) -> DataFrame:
        row = self.entries().where(F.col("path") == path)
        if row.isEmpty():
            raise KeyError(path)
        return row

    def delete(self, path: str) -> int:
        return self.commit(self._known(path).withColumn("op", F.lit("del")), None, "delta")

    def rename(self, old: str, new: str) -> int:
        """Moves one entry, as one generation of a put and a del; the new path must be safe and
        free, and the folder above it be a directory of the store or not be an entry."""
        row = self._known(old)
        want = self.spark.range(1).select(canonical(F.lit(new)), path_fault(F.lit(new))).first()
        above = [want[0].rsplit("/", i)[0] for i in range(1, want[0].count("/") + 1)]
        taken = self.entries().where((F.col("path") == want[0]) | (F.col("path").isin(above) & (F.col("kind") != "dir"))).limit(1).count()
        if want[1] or taken:
            raise ValueError(f"{new!r} is unsafe, taken, or below what is no directory")
        return self.commit(row.withColumn("path", F.lit(want[0])).unionByName(row.withColumn("op", F.lit("del"))), None, "delta")

    def read(self, start: int = 0, length: int | None = None, path: str | None = None) -> DataFrame:
        """``(path, size, sha, data)`` of the live files, or of a byte range of each.

        Hardlinks are read through their target. Only the blobs of parts that the range
        touches are joined and decoded; a range past the end is cut off. data is null
        where a blob is damaged.
        """
        e = (self.entries() if path is None else self._known(path)).where("kind IN ('file', 'hardlink')")
        if not e.where("kind = 'hardlink'").limit(1).isEmpty():
            links = e.where("kind = 'hardlink'").select("path", "target")
            final = journal.closure(self.entries().where("kind = 'hardlink'").select("path", "target")).join(links.select("path"), "path", "left_semi")
            body = self.entries().where("kind = 'file'").select(F.col("path").alias("target"), "size", "sha", "parts")
            e = e.where("kind = 'file'").select("path", "size", "sha", "parts").unionByName(final.join(body, "target").select("path", "size", "sha", "parts"))
        end = F.col("size") if length is None else F.least(F.col("size"), F.lit(start + length))
        e = e.withColumn("end", end)
        hit = lambda p: (p["off"] < F.col("end")) & (p["off"] + p["len"] > start)
        parts = e.select("path", "end", F.inline(F.filter("parts", hit)))
        data = decode(self.blobs().join(parts.select("sha").distinct(), "sha", "left_semi"), self.dictionary()).select("sha", "data")
        low = F.greatest(F.lit(start) - F.col("off"), F.lit(0))
        piece = F.substring("data", (low + 1).cast("int"), (F.least(F.col("len"), F.col("end") - F.col("off")) - low).cast("int"))
        got = parts.join(data, "sha").select("path", "seq", piece.alias("piece"))
        whole = got.groupBy("path").agg(F.expr("listagg(piece, x'') WITHIN GROUP (ORDER BY seq)").alias("data"), F.count("piece").alias("good"))
        told = e.select("path", "size", "sha", F.size(F.filter("parts", hit)).alias("n")).join(whole, "path", "left")
        return told.select("path", "size", "sha", F.when(F.col("n") == F.coalesce("good", F.lit(0)), F.coalesce("data", F.lit(b""))).alias("data"))

    def verify(self) -> DataFrame:
        """Entries whose bytes do not give their hash any more."""
        rows = self.read().withColumn("got", sha(F.col("data")))
        return rows.where("got IS NULL OR got != sha").select("path", "sha", "got")

    def digest(self) -> DataFrame:
        """``(files, digest)`` over all live entries: ``verify.tree_digest``."""
        e = self.entries()
        own = e.select(F.lit("all").alias("all"), "path", "kind", "size", F.when(F.col("kind") == "file", F.col("sha")).otherwise(F.col("target")).alias("detail"))
        return verify.tree_digest(own, "all").select("files", "digest")

    def strong_verify(self, digest: str) -> bool:
        """Reads everything, hashes the tree of what was read, and compares it with a known root."""
        read = self.read().select("path", sha(F.col("data")).alias("read"))
        e = self.entries().join(read, "path", "left")
        own = e.select(F.lit("all").alias("all"), "path", "kind", "size", F.when(F.col("kind") == "file", F.col("read")).otherwise(F.col("target")).alias("detail"))
        if not e.where("kind = 'file' AND read IS NULL").limit(1).isEmpty():
            return False
        row = verify.tree_digest(own, "all").first()
        return (row["digest"] if row else hashlib.sha256(b"").hexdigest()) == digest

    def preflight(self, changed: dict[str, int] | None = None) -> DataFrame:
        """Broken rules of the store's catalog: see ``validate.violations``."""
        e = cut(self.entries())
        names = {"file": validate.FILE, "dir": validate.DIR, "symlink": validate.SYMLINK, "hardlink": validate.HARDLINK}
        number = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("kind"))
        entries = e.select("path", number.alias("kind"), "size", F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), F.col("target").alias("link_target"), "sha")
        blobs = self.blobs().select(F.col("sha").alias("blob_id"), "usize", "csize", "codec")
        parts = e.select("path", F.inline("parts")).select("path", "seq", "off", "len", F.col("sha").alias("blob_id"), F.lit(0).cast("long").alias("blob_off"))
        gens = self.generations().select("gen", "prev", (F.col("kind") == "full").alias("full"), F.lit(0).cast("long").alias("bytes"))
        return validate.violations(entries, blobs, parts, changed, generations=gens)

    def info(self) -> DataFrame:
        kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("file", "files"), ("dir", "dirs"), ("symlink", "symlinks"), ("hardlink", "hardlinks"))]
        e = self.entries().agg(*kinds, F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))
        b = self.blobs().agg(F.count("*").alias("blobs"), F.coalesce(F.sum("usize"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum("csize"), F.lit(0)).alias("stored_bytes"))
        return e.crossJoin(F.broadcast(b)).withColumn("generation", F.lit(self.newest()))

    def children(self, parent: str = "") -> DataFrame:
        return sources.children(self.entries(), parent)

    def extract(self, folder: str, metadata: bool = True, max_bytes: int | None = None, unsafe_links: bool = False) -> int:
        """Writes the live entries below a folder that all executors share.

        Paths and the sum of sizes are checked before anything is written. Directories
        come first; each file goes to a temporary name, is hashed, and takes its place
        only if the hash is right; then links, without those that lead out or that a
        path goes through, unless ``unsafe_links``; modes, times, owners and
        attributes last, where the system lets them. Gives the number of files.
        """
        e = cut(self.entries())
        if not e.where(path_fault(F.col("path")).isNotNull()).isEmpty():
            raise ValueError("the store holds unsafe paths")
        plan = cut(planning.extract_plan(e, max_bytes))
        acts = plan.where("action IN ('make', 'link') OR (action = 'skip' AND stage = 3)") if unsafe_links else plan.where("action IN ('make', 'link')")
        made = acts.join(e, "path").select("stage", "path", "kind", "target")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for kind, path, target in zip(part["kind"], part["path"], part["target"], strict=True):
                    to = os.path.join(folder, path)
                    os.makedirs(to if kind == "dir" else os.path.dirname(to), exist_ok=True)
                    if kind != "dir":
                        if os.path.lexists(to):
                            os.unlink(to)
                        os.symlink(target, to) if kind == "symlink" else os.link(os.path.join(folder, target), to)
                yield pd.DataFrame({"n": [len(part)]})

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                done = []
                for path, data, want in zip(part["path"], part["data"], part["sha"], strict=True):
                    ok = data is not None and hashlib.sha256(data).hexdigest() == want
                    if ok:
                        to = os.path.join(folder, path)
                        os.makedirs(os.path.dirname(to), exist_ok=True)
                        with open(f"{to}.{uuid.uuid4().hex}.part", "wb") as f:
                            f.write(data)
                            f.flush()
                            os.fsync(f.fileno())
                        os.replace(f.name, to)
                    done.append((path, ok))
                yield pd.DataFrame(done, columns=["path", "ok"])

        def dress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for path, mode, ns, uid, gid, attrs in zip(*(part[c] for c in ("path", "mode", "ns", "uid", "gid", "xattrs")), strict=True):
                    to = os.path.join(folder, path)
                    for act in (lambda: os.chown(to, int(uid), int(gid)), lambda: [os.setxattr(to, k, v) for k, v in (attrs or {}).items()], lambda: os.chmod(to, int(mode)), lambda: os.utime(to, ns=(int(ns), int(ns)))):
                        with contextlib.suppress(OSError):
                            act()
                yield pd.DataFrame({"n": [len(part)]})

        made.where("stage = 0").select("kind", "path", "target").mapInPandas(place, "n long").agg(F.sum("n")).collect()
        rows = self.read().join(e.where("kind = 'file'").select("path"), "path", "left_semi")
        told = bounded(rows.select("path", "data", "sha")).mapInPandas(write, "path string, ok boolean").groupBy("ok").count().collect()
        if any(not r["ok"] for r in told):
            raise ValueError("some members are damaged")
        for stage_ in (2, 3):
            made.where(F.col("stage") == stage_).select("kind", "path", "target").mapInPandas(place, "n long").agg(F.sum("n")).collect()
        if metadata:
            own = e.where("mode IS NOT NULL AND kind IN ('file', 'dir')").select("path", "kind", "mode", F.coalesce("mtime_ns", F.lit(0)).cast("string").alias("ns"), F.coalesce("uid", F.lit(-1)).alias("uid"), F.coalesce("gid", F.lit(-1)).alias("gid"), "xattrs")
            own.where("kind = 'file'").mapInPandas(dress, "n long").agg(F.sum("n")).collect()
            # a folder's time is set after all that is in it: the deepest first
            dirs = own.where("kind = 'dir'").repartition(1).sortWithinPartitions(F.desc(F.size(F.split("path", "/"))))
            dirs.mapInPandas(dress, "n long").agg(F.sum("n")).collect()
        return sum(r["count"] for r in told)

    def compact(self, root: str) -> int:
        """A new store of the live entries and the blobs that they name, one generation."""
        live, new = self.entries(), Store(self.spark, root)
        used = live.select(F.explode("parts.sha").alias("sha")).distinct()
        if (words := self.dictionary()) is not None:
            fs, path = new._fs("dictionary.bin")
            out = fs.create(path, False)
            out.write(words)
            out.close()
        kept = self.blobs().join(used, "sha", "left_semi").select("*", F.lit("").alias("path"), F.lit(0).cast("long").alias("seq"))
        return new.commit(live, kept, "full")

    def export_zip(self, target: str, level: int = 6) -> int:
        """A ZIP of the live files, with their times. Executors compress; the driver streams
        what they give into the one file that an archive is. A damaged member is an error."""
        times = self.entries().select("path", "mtime_ns")

        @F.pandas_udf("binary")
        def packed(data: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else recipes.deflated(x, level) for x in data], dtype=object)

        rows = bounded(self.read()).select("path", "size", F.crc32("data").alias("crc"), "data", packed("data").alias("packed"))
        wins = recipes.deflates(F.octet_length("packed"), F.col("size"))
        rows = rows.select("path", "size", "crc", wins.alias("deflated"), F.when(wins, F.col("packed")).otherwise(F.col("data")).alias("stored"), F.col("data").isNull().alias("hurt"))
        rows = rows.join(times, "path", "left").orderBy("path")
        n = 0
        with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
            for r in rows.toLocalIterator():
                if r["hurt"]:
                    raise ValueError(f"{r['path']!r} is damaged")
                _append(z, r["path"], bytes(r["stored"]), r["size"], r["crc"], r["deflated"], r["mtime_ns"])
                n += 1
        return n


def _append(z: zipfile.ZipFile, path: str, stored: bytes, size: int, crc: int, deflated: bool, mtime_ns: int | None) -> None:
    """Writes an entry whose stream is there already."""
    when = time.gmtime(max(315532800, min(4354819198, (mtime_ns or 0) // 1_000_000_000)))[:6]
    info = zipfile.ZipInfo(path, when)
    info.compress_type = zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED
    info.file_size, info.compress_size, info.CRC = size, len(stored), crc
    info.external_attr = 0o644 << 16
    info.header_offset = z.fp.tell()
    if any(ord(c) > 127 for c in path):
        info.flag_bits |= 0x800
    z.fp.write(info.FileHeader(zip64=False) if size < 1 << 31 else info.FileHeader(zip64=True))
    z.fp.write(stored)
    z.filelist.append(info)
    z.NameToInfo[info.filename] = info
    z.start_dir, z._didModify = z.fp.tell(), True


def _with_columns(members: DataFrame) -> DataFrame:
    """``members`` with the columns of an entry that they lack: plain files."""
    kinds = {"kind": "string", "target": "string", "mode": "int", "mtime_ns": "long", "uid": "long", "gid": "long", "xattrs": "map<string,binary>"}
    have = set(members.columns)
    told = members.select("path", "data", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return told.withColumn("kind", F.coalesce("kind", F.lit("file")))
