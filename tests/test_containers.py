"""Compressed members, recipes with canonical streams, and a graph that is damaged."""

import gzip
import hashlib
import io
import lzma
import os
import random
import zipfile
import zlib

from pyspark.sql import functions as F

from sparkstore.operators import codecs, graph, recipes


def test_ranges_of_authentic_streams(spark):
    raw = b"some text " * 500
    stream = recipes.deflated(raw, 6)
    sha = hashlib.sha256(raw).hexdigest()
    rows = [(0, stream, len(raw), sha, 5, 20), (1, stream + b"!", len(raw), sha, 5, 20), (2, stream, len(raw), "0" * 64, 5, 20), (3, stream, len(raw), sha, len(raw) - 1, 2), (4, stream, 9, sha, 0, 1), (5, stream, len(raw), sha, len(raw), 0)]
    df = spark.createDataFrame([(i, bytearray(d), *x) for i, d, *x in rows], "id int, data binary, usize long, sha string, start long, length long")
    got = {r.id: r.part and bytes(r.part) for r in codecs.inflated_range(df).collect()}
    assert got[0] == raw[5:25] and not any(got[i] for i in range(1, 6)) and got[5] is not None


def test_members_that_are_another_one_compressed(spark):
    import zstandard

    raw = os.urandom(20000).hex().encode()
    members = {"a": raw, "a.gz": gzip.compress(raw), "a.zst": zstandard.compress(raw), "a.xz": lzma.compress(raw), "b.gz": gzip.compress(b"small"), "c.gz": gzip.compress(raw)[:-9], "d": b"\x1f\x8bno"}
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in members.items()], "path string, data binary")
    assert [tuple(r) for r in codecs.decoded_twins(df).collect()] == [("a.zst", "a", "zstd")]
    assert [tuple(r) for r in codecs.decoded_twins(df.where("path != 'a.zst'")).collect()] == [("a.gz", "a", "gzip")]


def test_containers_share_canonical_streams(spark):
    r = random.Random(3)
    big = bytes(r.choice(b"abcdefgh") for _ in range(60000))

    def made(level, *names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, big, zipfile.ZIP_DEFLATED, level)
        return out.getvalue()

    members = {"x.zip": made(6, "a", "b"), "y.zip": made(6, "c"), "z.zip": made(1, "d")}
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in members.items()], "path string, data binary").repartition(3)
    recipe = recipes.make(df, reuse=1000)
    modes = [x["mode"] for x in recipe.where("part = 'payload'").orderBy("path", "seq").collect()]
    assert modes == [recipes.CANONICAL] * 3 + [recipes.RETAIN]
    kept = recipes.canonical_payloads(df, recipe)
    assert kept.count() == 1
    assert {x.path: bytes(x.data) for x in recipes.rebuild(recipe, kept).collect()} == members
    assert recipes.rebuild(recipe).where("data IS NULL").count() == 2
    asked = [("x.zip", 0, 50), ("x.zip", 25, 30000), ("y.zip", 1000, 10), ("z.zip", 40, 99999)]
    got = recipes.read_range(recipe, spark.createDataFrame(asked, "path string, start long, length long"), kept)
    assert {(x.path, x.start): bytes(x.data) for x in got.collect()} == {(p, a): members[p][a : a + n] for p, a, n in asked}


def test_a_hurt_record_hurts_its_members_alone(spark):
    r = random.Random(5)
    base = r.randbytes(40000)
    members = {"a": base, "b": base[:20000] + b"new" + base[20000:], "c": r.randbytes(3000), "empty": b"", "copy": base}
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in members.items()], "path string, data binary")
    g = graph.build(df, pack=3000)
    assert graph.stats(g).first().deltas == 1
    assert {x.path: bytes(x.data) for x in graph.extract(g).collect()} == members
    hurt = g.nodes.where("base IS NULL AND size = 3000").first().record
    g.records = g.records.withColumn("payload", F.when(F.col("record") == hurt, F.lit(b"zz")).otherwise(F.col("payload")))
    got = {x.path: x.data and bytes(x.data) for x in graph.extract(g).collect()}
    assert got["c"] is None and {p: d for p, d in got.items() if p != "c"} == {p: d or None for p, d in members.items() if p != "c"} | {"empty": got["empty"]}
    copies = spark.createDataFrame([(0, bytearray(b"x"), "no"), (1, bytearray(b"x"), hashlib.sha256(b"x").hexdigest())], "copy int, bytes binary, sha string")
    assert graph.first_valid(copies, "bytes").first().copy == 1 and zlib.crc32(b"") == 0
