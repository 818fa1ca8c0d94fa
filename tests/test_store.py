"""A store in a folder, from a tree to its export."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkstore import __main__ as cli
from sparkstore.operators import codecs
from sparkstore.store import Store


@pytest.fixture
def tree(tmp_path):
    files = {"a.txt": b"shared text\n" * 200, "d/b.bin": bytes(range(256)) * 40, "d/copy.txt": b"shared text\n" * 200, "empty": b""}
    for p, data in files.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_bytes(data)
    return files


def contents(store):
    return {r.path: bytes(r.data) for r in store.read().collect()}


def test_life_of_a_store(spark, tmp_path, tree):
    s = Store(spark, f"{tmp_path}/s")
    assert s.build(f"{tmp_path}/tree") == 0 and contents(s) == tree
    info = s.info().first()
    assert (info.files, info.dirs, info.blobs) == (4, 1, 2) and info.stored_bytes < info.unique_bytes < info.logical_bytes
    for start, n in ((0, 5), (10000, 500), (10239, 9), (99999, 1)):
        assert bytes(s.read(start, n, path="d/b.bin").first().data) == tree["d/b.bin"][start : start + n]
    assert s.verify().count() == 0
    s.put(spark.createDataFrame([("a.txt", bytearray(b"new"))], "path string, data binary"))
    s.rename("d/b.bin", "e/moved.bin")
    s.delete("empty")
    now = {"a.txt": b"new", "e/moved.bin": tree["d/b.bin"], "d/copy.txt": tree["d/copy.txt"]}
    assert contents(s) == now and contents(Store(spark, f"{tmp_path}/s", gen=0)) == tree
    assert [r.new_blobs for r in s.generations().orderBy("gen").collect()] == [2, 1, 0, 0]
    with pytest.raises(KeyError):
        s.delete("zz")
    for bad in ("../x", "a.txt", "/abs"):
        with pytest.raises(ValueError):
            s.rename("d/copy.txt", bad)
    with pytest.raises(ValueError):
        s.rename("d/copy.txt", "a.txt/below")
    with pytest.raises(ValueError):
        s.put(spark.createDataFrame([("../x", bytearray(b""))], "path string, data binary"))
    c = Store(spark, f"{tmp_path}/c")
    s.compact(c.root)
    assert contents(c) == now and c.blobs().count() == 3
    c.delete("a.txt")
    Store(spark, f"{tmp_path}/c").compact(f"{tmp_path}/c2")
    assert Store(spark, f"{tmp_path}/c2").blobs().count() == 2
    assert s.extract(f"{tmp_path}/out") == 3 and (tmp_path / "out/e/moved.bin").read_bytes() == tree["d/b.bin"]
    s.export_zip(f"{tmp_path}/x.zip")
    with zipfile.ZipFile(f"{tmp_path}/x.zip") as z:
        assert {i.filename: z.read(i) for i in z.infolist()} == now


def test_what_a_dead_writer_left_is_never_read(spark, tmp_path, tree):
    s = Store(spark, f"{tmp_path}/s")
    s.build(f"{tmp_path}/tree")
    ghost = s.entries().withColumn("gen", F.lit(1).cast("long")).withColumn("path", F.concat(F.lit("ghost/"), "path"))
    ghost.write.parquet(f"{s.root}/journal/gen=1")
    ghost.write.parquet(f"{s.root}/journal/0123")
    assert contents(s) == tree
    s.put(spark.createDataFrame([("new", bytearray(b"new"))], "path string, data binary"))
    assert contents(s) == tree | {"new": b"new"} and s.broken().count() == 0


def test_two_writers_of_one_number(spark, tmp_path, tree, monkeypatch):
    s = Store(spark, f"{tmp_path}/s")
    s.build(f"{tmp_path}/tree")
    monkeypatch.setattr(Store, "newest", lambda self: -1)
    with pytest.raises(RuntimeError):
        s.delete("a.txt")
    monkeypatch.undo()
    assert contents(s) == tree


def test_damage_is_found(spark, tmp_path, tree):
    s = Store(spark, f"{tmp_path}/s")
    s.build(f"{tmp_path}/tree")
    hurt = s.blobs().withColumn("payload", F.when(F.col("usize") > 5000, F.concat(F.lit(b"\x00"), "payload")).otherwise(F.col("payload")))
    other = Store(spark, f"{tmp_path}/h")
    other.commit(s.entries(), hurt.select("*", F.lit("").alias("path"), F.lit(0).cast("long").alias("seq")), "full")
    assert [r.path for r in other.verify().collect()] == ["d/b.bin"]
    digest = s.digest().first().digest
    assert s.strong_verify(digest) and not other.strong_verify(digest) and not s.strong_verify("0" * 64)
    with pytest.raises(ValueError):
        other.extract(f"{tmp_path}/o")
    with pytest.raises(ValueError):
        other.export_zip(f"{tmp_path}/o.zip")
    assert cli.main(["cat", other.root, "d/b.bin"]) == 2


def test_paths_are_put_once(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for a, b in (("x", "x"), ("d/a", "d\\a")):
        with pytest.raises(ValueError, match="2 times"):
            s.put(spark.createDataFrame([(a, bytearray(b"1")), (b, bytearray(b"2"))], "path string, data binary"))
    assert s.newest() == -1


def test_long_chains_get_a_checkpoint(spark, tmp_path, monkeypatch):
    from sparkstore import store

    monkeypatch.setattr(store, "CHECKPOINT_DEPTH", 2)
    s, want = Store(spark, f"{tmp_path}/s"), {}
    for i in range(6):
        s.put(spark.createDataFrame([(f"f{i}", bytearray([i])), ("same", bytearray([i]))], "path string, data binary"))
        want |= {f"f{i}": bytes([i]), "same": bytes([i])}
    s.delete("f0")
    want.pop("f0")
    assert contents(s) == want and contents(Store(spark, s.root, gen=1)) == {"f0": b"\0", "f1": b"\1", "same": b"\1"}
    rows = s.generations().orderBy("gen").collect()
    assert [(r.depth, r.kind) for r in rows] == [(0, "full"), (1, "update"), (2, "update"), (0, "full"), (1, "update"), (2, "update"), (0, "full")]
    assert s.preflight().count() == 0


def test_whole_trees_come_back(spark, tmp_path):
    t = tmp_path / "tree"
    for d in ("pkg/deep", ".hidden", "empty"):
        (t / d).mkdir(parents=True)
    files = {"pkg/__init__.py": b"", ".env": b"secret", "a.txt": b"a" * 5000, "pkg/deep/_x": b"x" * 10, ".hidden/.y": b"y"}
    for p, data in files.items():
        (t / p).write_bytes(data)
    (t / "a.txt").chmod(0o750)
    os.utime(t / "a.txt", ns=(5, 1_600_000_000_123_456_789))
    os.link(t / "a.txt", t / "pkg/hard")
    os.symlink("../a.txt", t / "pkg/up")
    os.symlink("deep/_x", t / "pkg/soft")
    os.symlink("nowhere", t / "gone")
    os.utime(t / "pkg", ns=(5, 1_500_000_000_000_000_001))
    s = Store(spark, f"{tmp_path}/s")
    s.build(str(t))
    e = {r.path: r for r in s.entries().collect()}
    assert {p for p, r in e.items() if r.kind == "file"} == set(files) and {p for p, r in e.items() if r.kind == "dir"} == {"pkg", "pkg/deep", ".hidden", "empty"}
    assert e["pkg/hard"].kind == "hardlink" and e["pkg/hard"].target == "a.txt" and e["gone"].target == "nowhere"
    assert s.preflight().count() == 0 and contents(s) == files | {"pkg/hard": files["a.txt"]}
    with pytest.raises(ValueError, match="bytes"):
        s.extract(f"{tmp_path}/no", max_bytes=100)
    out = tmp_path / "out"
    assert s.extract(str(out)) == len(files)
    for p, data in files.items():
        assert (out / p).read_bytes() == data
    assert (out / "a.txt").stat().st_mode & 0o777 == 0o750 and (out / "a.txt").stat().st_mtime_ns == 1_600_000_000_123_456_789
    assert (out / "pkg/hard").samefile(out / "a.txt") and os.readlink(out / "pkg/soft") == "deep/_x" and (out / "empty").is_dir()
    assert not os.path.lexists(out / "pkg/up") and (out / "pkg").stat().st_mtime_ns == 1_500_000_000_000_000_001
    s.extract(f"{tmp_path}/all", metadata=False, unsafe_links=True)
    assert os.readlink(tmp_path / "all/pkg/up") == "../a.txt"
    assert {r.path for r in s.children("pkg").collect()} == {"pkg/__init__.py", "pkg/deep", "pkg/hard", "pkg/up", "pkg/soft"}
    assert {r.path for r in s.children().collect()} == {"pkg", ".hidden", "empty", ".env", "a.txt", "gone"}
    again = Store(spark, f"{tmp_path}/s2")
    again.build(str(t), reproducible=True, epoch_ns=7)
    assert {(r.mtime_ns, r.uid) for r in again.entries().collect()} == {(7, 0)} and again.digest().first() == s.digest().first()


def test_small_files_share_a_dictionary(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(64):
        (tmp_path / f"t/{i}.json").write_text("".join(f'{{"identifier": {i * j}, "description": "entry {j} of {i}", "enabled": true}}\n' for j in range(40)))
    s = Store(spark, f"{tmp_path}/s")
    s.build(f"{tmp_path}/t", train=True)
    assert s.dictionary() and codecs.ZSTD_DICT in {r.codec for r in s.blobs().select("codec").distinct().collect()}
    assert contents(s) == {f"{i}.json": (tmp_path / f"t/{i}.json").read_bytes() for i in range(64)}
    c = Store(spark, f"{tmp_path}/c")
    s.compact(c.root)
    assert contents(c) == contents(s)


def test_commands(spark, tmp_path, tree, capsys):
    at = f"{tmp_path}/s"
    for args in (["create", at, f"{tmp_path}/tree"], ["list", at], ["verify", at], ["rename", at, "a.txt", "z.txt"], ["list", at], ["list", at, "--generation", "0"], ["preflight", at], ["info", at], ["children", at, "d"], ["range", at, "d/b.bin", "3", "9", "-o", f"{tmp_path}/r"], ["extract", at, f"{tmp_path}/x", "--no-metadata"]):
        assert cli.main(args) == 0
    out = capsys.readouterr().out
    assert "sound" in out and out.count("a.txt") == 2 and out.count("z.txt") == 1 and (tmp_path / "r").read_bytes() == tree["d/b.bin"][3:12]
