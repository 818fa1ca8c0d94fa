"""Operators that SQL does not reach, and edges of those that it does."""

import hashlib
import io
import random
import zipfile
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkstore import sources, streaming
from sparkstore.functions import extension, path_fault
from sparkstore.operators import chunking, codecs, content, delta, extents, gate, journal, packing, planning, recipes, resemblance, splice, validate, verify

BYTES = st.binary(max_size=400)


@settings(max_examples=60, deadline=None)
@given(base=BYTES, target=BYTES, n=st.integers(1, 4), block=st.sampled_from([16, 64]))
def test_delta_round_trip(base, target, n, block):
    target = target + base[: len(base) // 2] * 2 + target
    payload, copied = delta.encode([base] * n, target, block)
    assert delta.decode([base] * n, payload) == target
    assert sum(copied) <= len(target)


def test_delta_fails_closed():
    for bad in (b"\x01\x00\x05", b"\x00\x09abc", b"\x07", b"\x01" + b"\xff" * 11):
        with pytest.raises(ValueError):
            delta.decode([b"abc"], bad)


def test_several_bases_take_the_longest_run():
    a, b = bytes(range(200)), bytes(range(100)) + b"x" * 100
    _, copied = delta.encode([b, a], bytes(range(200)))
    assert copied == [0, 200]


@settings(max_examples=30, deadline=None)
@given(n=st.integers(0, 2**62))
def test_varint(n):
    assert delta.get_varint(delta.put_varint(n), 0) == (n, len(delta.put_varint(n)))


def test_paths(spark):
    given_ = [("a/b.TXT", None, ".txt"), ("a//b", "unsafe_part", ""), ("../b", "unsafe_part", ""), ("/a", "absolute", ""), ("", "empty", ""), ("a\\..\\b", "unsafe_part", ""), ("a\x00", "nul", ""), ("d/.bashrc", None, ""), (None, "empty", None)]
    df = spark.createDataFrame([(p,) for p, _, _ in given_], "p string").select("p", path_fault(F.col("p")).alias("f"), extension(F.col("p")).alias("e"))
    got = {r.p: (r.f, r.e) for r in df.collect()}
    for p, fault, ext in given_:
        assert got[p][0] == fault
        if fault is None:
            assert got[p][1] == ext


def test_range_is_a_slice(spark):
    data = bytes(range(256)) * 5
    members = spark.createDataFrame([("a", bytearray(data), len(data)), ("b", bytearray(), 0)], "path string, data binary, size long")
    chunks = members.select("path", "data", F.inline(extents.fixed_chunks(F.col("size"), 100))).select("path", "seq", "off", "len", F.expr("substring(data, cast(off + 1 as int), cast(len as int))").alias("data"))
    asked = [(0, 1), (99, 2), (0, 1280), (1279, 1), (150, 500), (1200, 900)]
    req = spark.createDataFrame([("a", *x) for x in asked], "path string, start long, length long")
    got = extents.read_ranges(extents.overlaps(chunks, req, "path"), "path").collect()
    assert {(r.start, r.length): bytes(r.data) for r in got} == {(s, n): data[s : s + n] for s, n in asked}


def test_replay_renames_against_a_loop(spark, sf):
    from sparkstore.plans import queries

    j = queries._journal(spark, sf).orderBy("gen").toPandas()
    live = {}
    for r in j.itertuples():
        new = f"u{r.user_id}/{(r.gen + 3) % 7}"
        if r.op == "put" and r.gen % 5 == 0:
            if r.path in live:
                live[new] = live.pop(r.path)
        elif r.op == "put":
            live[r.path] = (r.gen, r.sha)
        else:
            live.pop(r.path, None)
    got = queries.journal_replay_renames(spark, sf).collect()
    assert {r.path: (r.gen, r.sha) for r in got} == live and len(got) == len(live)


def test_stream_is_batch(spark, sf, tmp_path):
    from sparkstore.plans import queries

    j = queries._journal(spark, sf).select("gen", "op", "path", "sha", "size")
    for part in (2, 0, 1):  # late generations come first
        j.where(F.col("gen") % 3 == part).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    q = streaming.live(streaming.journal_stream(spark, f"{tmp_path}/in", j.schema)).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in streaming.of_live(spark.table("live")).collect()}
    assert got == {tuple(r) for r in journal.replay(j).collect()}


def test_links_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "path string, target string")
    assert {r.path: r.target for r in journal.closure(links).collect()} == {"a": "c", "b": "c", "x": None, "y": None, "s": None}


def test_greedy_packs_reset(spark):
    sizes = [5, 5, 11, 3, 7, 1]
    items = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)], "by string, i long, size long")
    got = sorted((r.i, r.pack, r.off) for r in packing.greedy(items, "by", ["i"], "size", 10).collect())
    assert got == [(0, 0, 0), (1, 0, 5), (2, 1, 0), (3, 2, 0), (4, 2, 3), (5, 3, 0)]


@pytest.mark.parametrize("parts", ["1", "13"])
def test_greedy_packs_against_a_loop(spark, parts):
    """Over many ranges of one key, keys that end inside ranges, sizes of nought and too large ones."""
    r, limit = random.Random(parts), 50
    items = [(k, i, r.choice([0, 1, 3, 7, 20, 50, 51, 90])) for k, n in (("a", 700), (None, 150), ("b", 3), ("c", 90)) for i in range(n)]
    want = []
    for k in {k for k, _, _ in items}:
        pack, used, slot = -1, 0, 0
        for _, i, n in (x for x in items if x[0] == k):
            if pack < 0 or (slot and used + n > limit):
                pack, used, slot = pack + 1, 0, 0
            want.append((str(k), i, n, pack, slot, used))
            used, slot = used + n, slot + 1
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.greedy(spark.createDataFrame(items, "by string, i long, size long").repartition(5), "by", ["i"], "size", limit).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((str(x.by), x.i, x.size, x.pack, x.slot, x.off) for x in got) == sorted(want)


def test_merkle_roots_against_a_loop(spark, monkeypatch):
    def root(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        return level[0].hex()

    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 17, 31, 33, 64]
    leaves = {n: [hashlib.sha256(f"{n}/{i}".encode()).digest() for i in range(n)] for n in sizes}
    df = spark.createDataFrame([(n, 3 * i, x.hex()) for n, xs in leaves.items() for i, x in enumerate(xs)], "k long, at long, leaf string").repartition(7)
    for folded in (2, 10):
        monkeypatch.setattr(verify, "FOLDED", folded)
        got = {r.k: r.root for r in verify.merkle_roots(df, "k", "at", spark.createDataFrame([(99,), (1,)], "k long").union(df.select("k"))).collect()}
        assert got == {**{n: root(xs) for n, xs in leaves.items()}, 99: verify.EMPTY_ROOT}


def test_long_chains_are_no_cycles(spark):
    links = [(f"p{i}", f"p{i + 1}") for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "y"), ("a", "x")]
    got = {r.path: r.target for r in journal.closure(spark.createDataFrame(links, "path string, target string")).collect()}
    assert got == {**{f"p{i}": "p100" for i in range(100)}, "x": None, "y": None, "z": None, "a": None}


def test_chains_of_generations(spark):
    gens = [(0, None, True, True), (1, 0, False, True), (2, 1, False, False), (3, 2, False, True), (4, 9, False, True), (5, 6, False, True), (6, 5, False, True), (7, 1, False, True)]
    df = spark.createDataFrame(gens, "gen long, prev long, full boolean, committed boolean")
    got = {r.gen: (r.depth, r.fault) for r in journal.chain_depths(df, most=2).collect()}
    assert got == {0: (0, None), 1: (1, None), 2: (2, None), 3: (3, "too_deep"), 4: (None, "broken"), 5: (None, "cycle"), 6: (None, "cycle"), 7: (2, None)}
    assert journal.recover(df) == 7 and journal.recover(df.where("gen < 7")) == 1 and journal.recover(df.where("gen = 2")) is None


def test_refused_pairs_leave_the_others(spark):
    big = bytearray(9 << 20)
    rows = [(1, [big], bytearray(b"x" * 100)), (2, [bytearray(b"abc" * 50)], bytearray(b"abc" * 60)), (3, None, bytearray(b"y"))]
    got = {r.id: r for r in delta.restored(delta.deltas(spark.createDataFrame(rows, "id long, bases array<binary>, target binary"))).collect()}
    assert got[1].delta is None and "bounds" in got[1].refused and got[3].refused == "null"
    assert bytes(got[2].again) == b"abc" * 60 and got[2].refused is None


@settings(max_examples=40, deadline=None)
@given(data=st.binary(max_size=300), block=st.integers(1, 40))
def test_weak_checksums_roll(data, block):
    all_ = delta.weak_checksums(data, block)
    assert len(all_) == max(0, len(data) - block + 1)
    state = None
    for i, got in enumerate(all_.tolist()):
        want = delta.weak_checksum(data[i : i + block])
        state = want if state is None else delta.roll(state, data[i - 1], data[i + block - 1], block)
        assert state == want and got == want[1] << 16 | want[0]


def test_bases_that_give_nothing_go():
    r = random.Random(1)
    a, b, c = (r.randbytes(3000) for _ in range(3))
    payload, slots = delta.compacted([c, a, b[:100]], a + b[:100], 16)
    assert slots == [1] and delta.decode([a], payload) == a + b[:100]


def test_disjoint_pairs_are_the_greedy_ones(spark):
    r = random.Random(2)
    pairs = [(g, i, j, r.randint(1, 5)) for g in range(3) for i in range(25) for j in range(i + 1, min(25, i + 5))]
    want, used = [], set()
    for g, i, j, n in sorted(pairs, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if not {(g, i), (g, j)} & used:
            used |= {(g, i), (g, j)}
            want.append((g, i, j, n))
    got = planning.fuse(spark.createDataFrame(pairs, "g long, pos long, pos2 long, gain long"), "g").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sparse_members_read_and_hash(spark):
    data = bytearray(3 << 20)
    data[5000:5003], data[1 << 20 : (1 << 20) + 9000] = b"abc", b"z" * 9000
    members = spark.createDataFrame([("s", data), ("small", bytearray(100)), ("full", bytearray(b"x" * (2 << 20))), ("zero", bytearray(1 << 20))], "path string, data binary")
    runs = extents.runs_of_zeros(members)
    assert {r.path for r in runs.collect()} == {"s", "zero"}
    parts = runs.join(members, "path").select("path", "seq", "off", "len", F.expr("substring(data, int(off + 1), int(len))").alias("data"))
    sizes = members.select("path", F.octet_length("data").cast("long").alias("size"))
    got = {r.path: r.sha for r in extents.sparse_hash(parts, sizes.where("path IN ('s', 'zero')")).collect()}
    assert got == {"s": hashlib.sha256(data).hexdigest(), "zero": hashlib.sha256(bytes(1 << 20)).hexdigest()}
    asked = [(0, 10), (4999, 5), (0, 3 << 20), ((1 << 20) - 1, 9002), ((3 << 20) - 2, 99)]
    req = spark.createDataFrame([("s", *x) for x in asked], "path string, start long, length long")
    plan = extents.filled_ranges(parts.drop("data"), req, sizes, "path")
    read = {(r.start, r.length): bytes(r.data) for r in extents.read_sparse(plan, parts.select("path", "seq", "data"), "path").collect()}
    assert read == {(a, min(n, (3 << 20) - a)): bytes(data[a : a + n]) for a, n in asked}


def test_pack_plan_sticks_to_the_usual(spark):
    plans = spark.createDataFrame([("a", 524288, 100000, 2.0), ("a", 1048576, 99500, 3.0), ("b", 524288, 100000, 2.0), ("b", 1048576, 90000, 3.0), ("c", 65536, 9, 9.0), ("c", 131072, 10, 7.0)], "by string, plan_limit long, cost long, amplification double")
    assert {r.by: r.plan_limit for r in packing.choose(plans, "by").collect()} == {"a": 524288, "b": 1048576, "c": 131072}


def test_codec_ties_and_raw(spark):
    tried = spark.createDataFrame([("a", 100, 0, 1, 50), ("a", 100, 1, 4, 50), ("b", 100, 0, 1, 84), ("c", 100, 0, 1, 83)], "sha string, raw long, trial long, codec long, total long")
    assert {r.sha: r.codec for r in codecs.tournament(tried).collect()} == {"a": 1, "b": 0, "c": 1}


def test_inflate_rejects_trailing_bytes(spark):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    s = c.compress(b"hello" * 9) + c.flush()
    got = codecs.inflate(spark.createDataFrame([(bytearray(s),), (bytearray(s + b"!"),), (bytearray(s[:-2]),)], "data binary")).collect()
    assert [r.raw and bytes(r.raw) for r in got] == [b"hello" * 9, None, None]
    assert codecs.deflate_level(b"hello" * 9, s) is not None


def test_lsh_bounds_hold(spark):
    same = spark.createDataFrame([(i, 10, 3, 0, "f") for i in range(200)], "id long, size long, size_bucket long, band int, feature string")
    got = resemblance.candidates(same, bucket=7, most=3).toPandas()
    assert got.groupby("target").size().max() == 3
    assert all(r.target - 7 <= r.base < r.target for r in got.itertuples())


def chosen(edges):
    """The sequential choice of bases."""
    whole, used, out = {}, set(), {}
    for _, b, n in edges:
        whole[b] = whole.get(b, 0) + n
    for base in sorted(whole, key=lambda b: (-whole[b], b)):
        if base in out:
            continue
        used.add(base)
        for t, n in sorted(((t, n) for t, b, n in edges if b == base), key=lambda x: (-x[1], x[0])):
            if t not in used and n > out.get(t, (0, 0))[1]:
                out[t] = (base, n)
    return sorted((t, b, n) for t, (b, n) in out.items())


def test_bases_against_the_sequential_choice(spark):
    r = random.Random(6)
    for n, m in ((6, 8), (30, 90), (60, 400)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        edges = [(t, b, r.randint(1, 9)) for t, b in pairs if t != b]
        df = spark.createDataFrame(edges, "target long, base long, saving long")
        got = sorted(map(tuple, resemblance.central_bases(df).collect()))
        assert got == chosen(edges)
        assert not {b for _, b, _ in got} & {t for t, _, _ in got}
    chain = [(i + 1, i, 1000 - i) for i in range(20)]
    assert sorted(map(tuple, resemblance.central_bases(spark.createDataFrame(chain, "target long, base long, saving long")).collect())) == chosen(chain)
    assert resemblance.central_bases(df.limit(0)).count() == 0


def test_salvage_finds_what_fits(spark):
    blob = b"MAGI" + b"\0" * 4 + (5).to_bytes(8, "little") + (5).to_bytes(8, "little") + b"\0" * 40 + b"hello"
    data = b"xx" + blob + b"MAGI" + blob[:-3]
    df = spark.createDataFrame([("f", bytearray(data))], "path string, data binary")
    assert [(r.at, r.csize) for r in sources.salvage(df, b"MAGI").collect()] == [(2, 5)]


def test_kinds_of_a_scan(spark):
    listing = spark.createDataFrame([("a/x", "f", 1, 1), ("a.txt", "f", 1, 1), ("l", "l", 1, 2), ("d", "d", 1, 3), ("p", "p", 1, 4)], "path string, mode string, dev long, ino long")
    got = {r.path: (r.kind, r.target) for r in sources.classify(listing).collect()}
    assert got == {"a/x": ("file", None), "a.txt": ("hardlink", "a/x"), "l": ("symlink", None), "d": ("dir", None)}


def test_tree_reads_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"hi")
    assert [(r.path, bytes(r.data)) for r in sources.tree(spark, str(tmp_path)).collect()] == [("d/a.txt", b"hi")]


SOUND = {
    "entries": pd.DataFrame([("f", 0, 10, 0, None), ("d", 1, 0, 0, None), ("h", 3, 10, 0, "f")], columns=["path", "kind", "size", "mtime_ns", "link_target"]),
    "blobs": pd.DataFrame([(0, 6, 6, 0), (1, 4, 4, 0)], columns=["blob_id", "usize", "csize", "codec"]),
    "extents": pd.DataFrame([("f", 0, 0, 6, 0, 0), ("f", 1, 6, 4, 1, 0)], columns=["path", "seq", "off", "len", "blob_id", "blob_off"]),
}


@pytest.mark.parametrize(
    ("table", "row", "column", "value", "rules"),
    [
        (None, 0, "", 0, set()),
        ("entries", 1, "path", "a/../b", {"path_unsafe"}), ("entries", 1, "path", "f", {"path_duplicate", "dir_with_data", "hardlink_not_file"}), ("entries", 1, "kind", 9, {"kind_unknown"}),
        ("entries", 0, "size", 11, {"extent_total"}), ("entries", 1, "size", -1, {"size_negative"}), ("entries", 2, "link_target", "zz", {"hardlink_missing"}), ("entries", 2, "link_target", "h", {"hardlink_chain"}),
        ("blobs", 0, "codec", 7, {"codec_unknown"}), ("blobs", 1, "csize", 1 << 31, {"blob_limit", "raw_size"}), ("blobs", 1, "csize", 3, {"raw_size"}),
        ("extents", 1, "off", 7, {"extent_gap"}), ("extents", 1, "blob_id", 5, {"blob_missing"}), ("extents", 1, "blob_off", 1, {"slice_outside"}), ("extents", 1, "len", 3, {"extent_total"}),
    ],
)
def test_each_mutation_is_found(spark, table, row, column, value, rules):
    given_ = {k: v.copy() for k, v in SOUND.items()}
    if table:
        given_[table].loc[row, column] = value
    schema = {"entries": "path string, kind int, size long, mtime_ns long, link_target string", "blobs": "blob_id long, usize long, csize long, codec long", "extents": "path string, seq long, off long, len long, blob_id long, blob_off long"}
    got = validate.violations(*[spark.createDataFrame(list(given_[k].itertuples(index=False, name=None)), s) for k, s in schema.items()])
    assert {r.rule for r in got.collect()} == rules


def test_gate(spark):
    side = lambda *x: spark.createDataFrame(list(x), "k string, bytes long, seconds double")
    base = side(("same", 9, 1.0), ("slow", 9, 1.0), ("tiny", 9, 0.001), ("big", 9, 1.0), ("gone", 9, 1.0), ("better", 9, 1.0))
    new = side(("same", 9, 1.0), ("slow", 9, 1.2), ("tiny", 9, 0.0015), ("big", 10, 1.0), ("better", 8, 1.0))
    got = {r.k: r.verdict for r in gate.verdicts(base, new, ["k"]).collect()}
    assert got == {"same": "pass", "slow": "fail", "tiny": "observed", "big": "fail", "gone": "missing", "better": "improved"}


def test_layout_is_partition_free(spark, sf):
    blobs = content.intern(sources.documents(spark, sf))
    one = sorted(map(tuple, content.layout(blobs).collect()))
    assert one == sorted(map(tuple, content.layout(blobs.repartition(7)).collect()))
    assert [r[0] for r in one] == list(range(len(one)))


def test_cuts_against_a_byte_loop(monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 50)
    table, r = [int(x) for x in chunking.gear()], random.Random(5)
    for _ in range(40):
        data = bytes(r.choice((r.randrange(256), 7)) for _ in range(r.randint(0, 2500)))
        least, mean, most = r.choice([(16, 64, 256), (64, 64, 300), (1, 32, 33), (100, 128, 128)])
        want, start = [], 0
        while start < len(data):
            h, end = 0, min(len(data), start + most)
            for i in range(start + least, end):
                h = (h << 1) + table[data[i]]
                if h & (2 * mean - 1 if i < start + mean else mean // 2 - 1) == 0:
                    end = i + 1
                    break
            want.append(end)
            start = end
        assert chunking.cuts(data, least, mean, most) == want


def test_recipes_rebuild(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a.txt", "hello " * 500, zipfile.ZIP_DEFLATED, 6)
        z.writestr("b.bin", bytes(range(256)), zipfile.ZIP_STORED)
        z.writestr("empty", b"")
    data = made.getvalue()
    rows = [("z", bytearray(data), len(data)), ("cut", bytearray(data[:-30]), 0), ("no", bytearray(b"plain"), 5), ("pre", bytearray(b"#!" + data), 0)]
    df = spark.createDataFrame(rows, "path string, data binary, size long")
    recipe = recipes.make(df)
    assert {r.path: bytes(r.data) for r in recipes.rebuild(recipe).collect()} == {p: bytes(d) for p, d, _ in rows}
    own = {(r.part, r["mode"]) for r in recipe.where("path = 'z'").collect()}
    assert ("payload", recipes.REGENERATE) in own and ("stored", recipes.RETAIN) in own


def test_ended_chains_leave_the_rounds(spark, monkeypatch):
    """Only open rows are doubled: a cycle beside short chains costs no rounds, and no row that has ended is written again."""
    written = []
    monkeypatch.setattr(journal, "cut", lambda df: (lambda out: (written.append(out.count()), out)[1])(df.localCheckpoint()))
    gens = [(i, None if i % 4 == 0 else i - 1, i % 4 == 0) for i in range(400)] + [(1000, 1001, False), (1001, 1000, False), (1002, 1001, False), (1003, 5000, False), (1004, None, False), (1005, 1004, False)]
    got = {r.gen: (r.depth, r.fault) for r in journal.chain_depths(spark.createDataFrame(gens, "gen long, prev long, full boolean"), most=2).collect()}
    want = {i: (i % 4, "too_deep" if i % 4 > 2 else None) for i in range(400)}
    assert got == want | dict.fromkeys((1000, 1001, 1002), (None, "cycle")) | dict.fromkeys((1003, 1004, 1005), (None, "broken"))
    assert len(written) <= 4 and sum(written) <= 3 * 406


def test_deltas_are_made_once_by_one_worker(spark):
    """A filter on a delta does not make it twice, and a round trip is one Python pass over its pairs."""
    data = [(1, [b"x" * 300 + b"tail"], b"head" + b"x" * 300), (2, [b""], b"abc"), (3, None, b"abc"), (4, [b"a" * 64], b"")]
    pairs = spark.createDataFrame(data, "id long, bases array<binary>, target binary").repartition(2)
    passes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    kept = delta.deltas(pairs).where(F.octet_length("delta") < F.octet_length("target")).select("id", F.octet_length("delta"), F.get("copied", F.lit(0)))
    assert passes(kept) == 1
    assert [r[0] for r in kept.collect()] == [1]
    told = delta.round_trips(pairs).where("refused IS NULL").select("id", (F.col("again") == F.col("target")).alias("equal"), F.octet_length("delta"))
    assert passes(told) == 1
    assert sorted(r[:2] for r in told.collect()) == [(1, True), (2, True), (4, True)]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_places_that_are_skipped_hold_no_anchor(given_):
    """The hashed search for anchors leaves out no place that a look-up at each place finds."""
    draw = lambda most: given_.draw(st.binary(max_size=most) | st.text("ab", max_size=most).map(str.encode))
    base, block = draw(300) * given_.draw(st.integers(1, 3)), given_.draw(st.sampled_from([4, 8, 13, 64]))
    target = draw(90) + base[given_.draw(st.integers(0, 80)) :] + draw(90)
    index = {base[at : at + block]: [(0, at)] for at in range(0, len(base) - block + 1, block)}
    may = set(delta._anchored(index, target, block)(0, max(0, len(target) - block + 1)))
    assert may >= {at for at in range(len(target) - block + 1) if target[at : at + block] in index}
    assert delta.decode([base], delta.encode([base], target, block)[0]) == target


def test_only_grams_of_kids_are_shuffled(spark, monkeypatch):
    """What contained keeps of its parents grows with the places that kids may have, not with the texts."""
    kept = []
    monkeypatch.setattr(splice, "cut", lambda df: (lambda out: (kept.append((out.columns, out.count())), out)[1])(df.localCheckpoint()))
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    kids = [(1, words(9)), (2, words(12)), (3, "x" * 40), (4, words(9))]
    texts = [(i, words(60)) for i in range(200)] + [(900, f"a {kids[0][1]} b {kids[0][1]}"), (901, "é" + kids[2][1] + "x"), (902, kids[1][1][:-1]), (903, None)]
    got = splice.contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(kids, "item_id long, kid string"))
    want = {(d, k, at) for d, t in texts for k, kid in kids for at in range(len(t or "")) if t.startswith(kid, at)}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 4
    assert max(n for columns, n in kept if set(columns) == {"doc_id", "h"}) < 50


def test_one_hash_goes_over_ranges(spark, monkeypatch):
    """A digest of one key that is longer than a range is handed from task to task, and is the same."""
    rnd, seen = random.Random(2), []
    data = [(rnd.choice(["x", "x", "x", "y", None]), f"{rnd.randrange(9)}/{i}", rnd.randbytes(rnd.randrange(90))) for i in range(300)]
    df = spark.createDataFrame(data, "lang string, path string, data binary")
    whole = {tuple(r) for r in verify.content_digest(df, "lang").collect()}
    monkeypatch.setattr(verify, "LINK", 3000)
    monkeypatch.setattr(verify, "cut", lambda df, *by, f=verify.cut: (lambda out: (by and seen.append([r["n"] for r in out.groupBy(*by).agg(F.sum(F.octet_length("r")).alias("n")).collect()]), out)[1])(f(df, *by)))
    assert {tuple(r) for r in verify.content_digest(df, "lang").collect()} == whole and len(whole) == 3
    x = sorted((p.split("/"), p.encode(), d) for k, p, d in data if k == "x")
    told = hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p + len(d).to_bytes(8, "big") + d for _, p, d in x)).hexdigest()
    assert ("x", len(x), told) in whole
    assert len(seen[0]) >= 5 and max(seen[0]) < 6000
