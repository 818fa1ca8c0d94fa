"""The ten operators against brute force, round trips and held-out accuracy, and on
nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkstore.llm import chat, language, licenses, mixing, orderminhash, packing, queries, simhash, tokens, toxicity, vectors
from sparkstore.llm.common import components, held_out, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row long, word string, part int, copies string"


def make(spark, rows):
    """Odd documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None, 7, 7, 7, "w", 7, "c") for i, t, lang, s in rows], SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (None, "the cat sat on the mat", "en", "a"), (4, "the cat sat on the mat", "en", "a"),
    (4, "the cat sat on the mat", "en", "a"), (5, "%%% 123 !!!", None, "b"), (6, "word " * 30000, "en", "b"), (7, "x" * 70000, "en", "b"), (8, "É é 漢字 \U0001f600 ß", "fr", "c"),
    (4, "another text with the same id", "en", "a"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def find_roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components_of_all_shapes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(len, groups.values())) == [2, 60, 61]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_targets_fill_up():
    def want(sizes, weights=(5, 2, 1), most=3):
        w = [weights[i % 3] for i in range(len(sizes))]
        left, capped = float(sum(sizes)), set()
        while True:
            level = left / (sum(x for i, x in enumerate(w) if i not in capped) or 1)
            over = {i for i in range(len(sizes)) if i not in capped and level * w[i] > most * sizes[i]}
            if not over:
                return [most * sizes[i] if i in capped else level * w[i] for i in range(len(sizes))]
            capped |= over
            left = sum(sizes) - sum(most * sizes[i] for i in capped)

    from pyspark.sql import SparkSession

    spark, r = SparkSession.getActiveSession(), random.Random(3)
    for _ in range(4):
        sizes = [r.choice([0, 1, 5, 50, 1000, 10**6]) for _ in range(r.randint(1, 7))]
        df = spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, source_size long, n long")
        got = [x.target for x in mixing.targets(df).orderBy("source").collect()]
        assert got == pytest.approx(want(sizes))


def test_mix_comes_near_its_targets(spark, sf):
    docs = table(spark, sf, "documents")
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.copies <= 3).all() and (got.taken == got.copies * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1
        assert g["size"].sum() == g.source_size.iloc[0]
    share = got.groupby("source").agg(s=("source_size", "first"), t=("target", "first"))
    assert share.t.sum() == pytest.approx(share.s.sum())
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, got[["doc_id", "copies"]].values)) == sorted(map(tuple, again[["doc_id", "copies"]].values))


def test_rounding_keeps_expectations(spark):
    items = spark.createDataFrame([("s", i, 1 + i % 5, 1) for i in range(200)], "source string, id long, size long, m long")
    stats = spark.createDataFrame([("s", 600, 200, 5.0, 240.0)], "source string, source_size long, n long, weight double, target double")
    mean = np.zeros(200)
    for seed in range(12):
        got = mixing.copies(items, stats, seed).toPandas().set_index("id")
        assert abs((got.copies * got["size"]).sum() - 240) <= 2.5
        mean[got.index] += got.copies / 12
    by_size = [mean[[i for i in range(200) if i % 5 == k]].mean() for k in range(5)]  # 480 draws each
    assert by_size == pytest.approx([0.4] * 5, abs=0.1)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and sorted(got["size"]) == sorted(len(words(t)) for _, t, _, _ in ODD)
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(none).count() == 0
    kept = mixing.apply_mix(odd)
    assert kept.columns == odd.columns and kept.count() == got.copies.sum()
    assert mixing.apply_mix(none).count() == 0


def fold_twin(items, key, seed):
    """The fold of one group, in Python: (id, size, m, whole, part) settled, and the one that is left."""
    import xxhash

    def draw(held, item):
        h = 42
        for v, wide in ((seed, 4), (key, 0), (held[0], 8), (item[0], 8), (held[1], 8), (item[1], 8)):
            data = v.encode() if not wide else (v & (1 << 8 * wide) - 1).to_bytes(wide, "little")
            h = xxhash.xxh64_intdigest(data, seed=h)
        return (h - (1 << 64) if h >> 63 else h) % (1 << 40) / 2.0**40

    held, done = list(items[0]), []
    for item in map(list, items[1:]):
        a, b = held[4] * held[1], item[4] * item[1]
        room, other = (1 - held[4]) * held[1], (1 - item[4]) * item[1]
        gain, loss = min(room, b), min(a, other)
        grows = draw(held, item) * (gain + loss) < loss
        own = room <= b if grows else a <= other
        moved = gain if grows else -loss
        if own:
            done.append((*held[:4], 1.0 if grows else 0.0))
            held = [*item[:4], (b - moved) / item[1]]
        else:
            done.append((*item[:4], 0.0 if grows else 1.0))
            held[4] = (a + moved) / held[1]
    return done, tuple(held)


def test_fold_against_a_loop(spark):
    r = random.Random(11)
    for n in (1, 2, 7, 64):
        items = [(r.randrange(1 << 40), r.randint(1, 50), 1, r.randint(0, 2), r.choice([0.25, r.random()])) for _ in range(n)]
        df = spark.createDataFrame([(items,)], "xs array<struct<id:long,size:long,m:long,whole:long,part:double>>")
        got = df.select(mixing._fold(F.col("xs"), F.lit("0/s/3"), 17).alias("r")).first().r
        done, held = fold_twin(items, "0/s/3", 17)
        assert [tuple(x) for x in got.done] == [pytest.approx(x) for x in done] and tuple(got.held) == pytest.approx(held)
        words = lambda xs: sum(x[1] * x[4] for x in xs)
        assert words([*done, held]) == pytest.approx(words(items))


def test_apply_mix_deals_the_copies_of_a_kind(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT", 3)
    rows = [(7, "one two three", "a", i) for i in range(10)] + [(7, f"x{i} two three", "a", i) for i in range(13)] + [(None, "b c", None, i) for i in range(9)]
    rows += [(100 + i, "w " * (i % 9 + 1), "abc"[i % 3], i) for i in range(60)] + [(7, "one two three", "a", 10)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __all long").withColumn("__s", F.lit(1)).withColumn("m", F.lit(2))
    want = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).collect()
    want = {(r.doc_id, r.source, r["size"]): (r.n, r.rows) for r in want}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got, each = {}, {}
    for r in out.collect():
        k = (r.doc_id, r.source, len(words(r.text)))
        got[k] = got.get(k, 0) + 1
        each.setdefault(k, {}).setdefault((r.text, r["__all"]), 0)
        each[k][r.text, r["__all"]] += 1
    assert got == {k: n for k, (n, _) in want.items() if n}
    for k, (n, m) in want.items():  # even, but for rows that are equal in all columns
        assert all(x <= -(-n // m) for (text, i), x in each.get(k, {}).items() if (text, i) != ("one two three", 10))


# 2


def brute_occurrences(h):
    seen, out = {}, []
    for x in h.tolist():
        out.append(seen.get(x, 0))
        seen[x] = seen.get(x, 0) + 1
    return out


def test_occurrences_and_kmers():
    h = orderminhash.kmers("abababababa", 3)
    assert len(h) == 9 and len(set(h.tolist())) == 2
    assert orderminhash.occurrences(h).tolist() == brute_occurrences(h)
    assert len(orderminhash.kmers("ab", 8)) == 1 and len(orderminhash.kmers("", 8)) == 0


def test_signature_is_the_least_pair_in_text_order():
    sign = orderminhash.Signer(k=4, picked=2, tuples=8)
    text = "".join(random.Random(1).choice("abc ") for _ in range(5000))  # over a block
    h = orderminhash.kmers(text, 4)
    with np.errstate(over="ignore"):
        numbered = (orderminhash._mix(h + orderminhash.occurrences(h) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        for j, key in enumerate(orderminhash._keys(8)):
            at = np.sort(np.argsort(numbered ^ key, kind="stable")[:2])
            out = np.zeros(1, np.uint64)
            for n, i in enumerate(at):
                out = orderminhash._mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1] + np.uint64(n + 1))
            assert int(out[0] >> np.uint64(32)) == sign(text)[j]


def test_order_counts_and_edits_rank():
    sign, r = orderminhash.Signer(), random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    near = lambda x: orderminhash.likeness(sign(text), sign(x))
    half = len(text) // 2
    assert near(text) == 1.0
    assert near(text[:-40] + "z" * 40) > near(text[: half + 400] + "q" * (half - 400)) > near("q" * len(text))
    assert near(text[half:] + text[:half]) < 0.8  # the same k-mers, moved


def test_edited_against_brute_force(spark, sf, odd, none):
    docs = table(spark, sf, "documents")
    got = orderminhash.edited(docs, parts=7).toPandas().set_index("doc_id")
    rows = docs.toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    texts, sign = rows.text.tolist(), orderminhash.Signer()
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        after, r = texts[(i + 1) % len(texts)], got.loc[rows.doc_id[i]]
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        if i % 20 == 0:
            assert r.fingerprint == orderminhash.hexed(sign(t)) and r.edited_fingerprint == orderminhash.hexed(sign(changed))
            assert r.near_next == orderminhash.likeness(sign(t), sign(after))
    assert orderminhash.edited(odd, parts=5).count() == len(ODD)
    assert orderminhash.edited(none).count() == 0 and orderminhash.fingerprints(odd).count() == len(ODD)
    # a hot id, equal rows, null ids: every row once, equal texts alike
    rows = [(3, "same text", 0)] * 40 + [(3, f"text {i}", 0) for i in range(40)] + [(None, f"t{i % 7}", 0) for i in range(30)] + [(i, f"text {i}", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    for parts in (1, 9, 60):
        told = orderminhash.edited(df, parts=parts).toPandas()
        assert len(told) == len(rows) and told.doc_id.isna().sum() == 30 and (told.doc_id == 3).sum() == 81
        same = told[told.fingerprint == orderminhash.hexed(sign("same text"))]
        assert len(same) == 40 and (same.near_next == 1).sum() == 39
        first = told if parts == 1 else first
        key = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
        assert sorted(map(tuple, told[key].values)) == sorted(map(tuple, first[key].values))
    one = orderminhash.edited(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# 3


def test_language_blocks_and_letters(monkeypatch):
    counter, text = language.Counter(), "Héllo wörld 12 漢字! " * 50
    whole = counter(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (counter(text) == whole).all()
    assert not language.has_letter("12 %% ½²") and language.has_letter("½ a")
    assert not language.has_letter("") and not language.has_letter(None) and language.has_letter("1é")


def test_language_on_held_out_documents(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learn(docs, 100)
    told = language.identify(docs.select("doc_id", "text", "lang"), model).where(held_out(F.col("doc_id"))).toPandas()
    assert (told.lang == told.lang_pred).mean() > 0.97 and told.lang_score.between(0, 1).all()
    assert (model.weights == 0).mean() > 0.3  # sparse
    got = language.identify(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "lang_score"]
    for r in got.collect():
        assert (r.lang_pred == "und") == (not language.has_letter(r.text))
    assert language.identify(none, language.learn(none)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.learn(none)).collect()} == {"und"}


def ftrl_twin(rows, y, classes, kept, order):
    """Per-coordinate FTRL-Proximal as it is defined, one number at a time."""
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= language.L1 else -(z[k] - np.sign(z[k]) * language.L1) / ((language.BETA + n[k] ** 0.5) / language.ALPHA + language.L2)
    for i in order:
        if kept[i]:
            continue
        at, x = rows[i]
        at, x = [*at.tolist(), language.ROWS], [*x.tolist(), 1.0]
        s = [sum(weight((a, c)) * v for a, v in zip(at, x, strict=True)) for c in range(classes)]
        e = np.exp(np.array(s) - max(s))
        p = e / e.sum()
        for c in range(classes):
            g0 = p[c] - (y[i] == c)
            for a, v in zip(at, x, strict=True):
                k, g = (a, c), g0 * v
                w = weight(k)
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / language.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w, n.get(k, 0.0) + g * g
    return weight, z


def test_ftrl_against_its_definition(monkeypatch):
    r = np.random.default_rng(4)
    rows, y = [], []
    for i in range(40):
        at = np.sort(r.choice(50, 6, replace=False))
        rows.append((at, r.random(6)))
        y.append(int(at[0] % 3))
    y = np.array(y)
    w, t = language.fit(rows, y, 3)
    r2 = np.random.default_rng(language.SEED)
    kept = r2.random(len(rows)) < 0.2
    order = np.concatenate([r2.permutation(np.flatnonzero(~kept)) for _ in range(language.EPOCHS)])
    weight, z = ftrl_twin(rows, y, 3, kept, order)
    for a, c in z:
        assert w[a, c] == pytest.approx(weight((a, c)), abs=1e-9)
    assert not w[[a for a in range(language.ROWS) if (a, 0) not in z]].any()
    logits = np.array([np.append(x, 1) @ w[np.append(at, language.ROWS)] for (at, x), k in zip(rows, kept, strict=True) if k])
    loss = lambda t: -np.log(language._softmax(logits / t)[np.arange(kept.sum()), y[kept]]).mean()
    assert loss(t) == pytest.approx(min(loss(g) for g in np.geomspace(0.05, 20, 121)))


def test_language_counts_and_samples(spark):
    texts = [(i, f"{'der die das' if i % 2 else 'the of and'} {i % 5} {'x' * (i % 7)}", "de" if i % 2 else "en") for i in range(120)]
    odd = [(None, "le la les", "fr")] * 50 + [(5, None, "en"), (6, "", "en"), (201, "123", "xx"), (8, "solo", "one")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, lang string")
    model = language.learn(docs, 20)
    assert model.languages == ["de", "en", "fr", "one", "xx"]
    counter, df, n = language.Counter(), np.zeros(language.ROWS), 0
    for i, t, _ in texts + odd:
        if t is not None and (i is None or __import__("zlib").crc32(str(i).encode()) % 4 != 2) and language.has_letter(t):
            df += counter(t) > 0
            n += 1
    assert model.idf == pytest.approx((np.log((1 + n) / (1 + df)) + 1).astype(np.float32))
    own = docs.where("text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {"de": 60, "en": 62, "fr": 1, "xx": 1, "one": 1}
    got = language.sample(own, sizes, 20).toPandas()
    assert got.groupby("lang").size().to_dict() == {"de": 20, "en": 20, "fr": 1, "xx": 1, "one": 1}
    least = own.where("lang = 'de'").toPandas().h.drop_duplicates().nsmallest(20)
    assert set(got[got.lang == "de"].h) == set(least)
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("lang_pred", F.lit("mine")), model)
    told = language.identify(docs.withColumn("__told", F.lit(1)), model, ("p", "s"))
    assert told.columns == [*docs.columns, "__told", "p", "s"] and told.groupBy("text").agg(F.count_distinct("p", "s").alias("n")).where("n > 1").count() == 0


# 4


def test_masks_cover_every_pair():
    masks, r = simhash.masks(), random.Random(4)
    assert len(masks) == 31
    for bits in itertools.chain(itertools.combinations(range(0, 64, 5), 4), (r.sample(range(64), r.randint(1, 4)) for _ in range(3000))):
        diff = sum(1 << b for b in bits)
        assert any(m & diff == 0 for m in masks)


def test_fingerprint_against_the_definition():
    import xxhash

    for text in ("A b", "one two three four five six one two three four", " é É ÀB  c d\x0be ", "a"):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


@pytest.mark.parametrize("bucket", [2048, 1])
def test_links_lose_no_pair(spark, bucket):
    r = random.Random(bucket)
    seeds = [r.getrandbits(64) for _ in range(6)]
    prints = list({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(12)})
    signed = [simhash._signed(p) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket)
    got = {x.node: x.root for x in components(edges).collect()}
    root = find_roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for i in range(len(prints)):
        for j in range(i):
            same = got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])
            assert same == (root[i] == root[j])


def test_simhash_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == len(ODD)
    by = got.groupby("fp").component_id.first()
    assert by.loc[0] == 1 and 4 in by.values
    kept = simhash.keep_one(odd)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == odd.columns and texts.count("the cat sat on the mat") == 1 and "another text with the same id" in texts
    assert sum(not words(t) for t in texts) == 1 and len(texts) == 7
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# 5


def brute_vectors(rows):
    ids, out = [r[0] for r in rows], []
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if k else None for r, k in zip(rows, ok, strict=True)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    root = find_roots(len(rows), pairs)
    for i in range(len(rows)):
        out.append((ids[i], sum(i in p for p in pairs), min(ids[j] for j in range(len(rows)) if root[j] == root[i])))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [8192, 16])
def test_vectors_against_brute_force(spark, slice_rows):
    r = np.random.default_rng(slice_rows)
    seeds = r.standard_normal((12, 8))
    rows = [(i, (seeds[i % 12] + r.standard_normal(8) * r.choice([0, 0.05, 0.15, 0.4])).tolist(), int(i % 2)) for i in range(160)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] + [1.0] * 7, 1), (503, rows[0][1], None), (504, [None] + [1.0] * 7, 0), (505, [-0.0, 1.0], 0), (506, [0.0, 1.0], 0), (507, [], 0), (508, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "vec_id long, embedding array<float>, label int, key string")
    exact = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lb) for i, e, lb in rows]
    got = vectors.near_duplicates(df, slice_rows=slice_rows, cell_rows=10)
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got.collect()) == brute_vectors(exact)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.collect())
    more = df.unionByName(df.where("vec_id < 3")).unionByName(df.where("vec_id = 4").withColumn("vec_id", F.lit(None).cast("long")))
    told = vectors.near_duplicates(more, slice_rows=slice_rows, cell_rows=10).toPandas()
    assert len(told) == len(rows) + 4 and told.vec_id.isna().sum() == 1 and told[told.vec_id == 1].n_links.nunique() == 1
    base = got.toPandas().set_index("vec_id").n_links
    assert told[told.vec_id == 1].n_links.iloc[0] >= base[1] + 1 and told[told.vec_id.isna()].n_links.iloc[0] >= 1
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# 6


def test_licenses_base_and_changes(spark, odd, none):
    texts = {
        1: "Used UNDER the MIT\n License; apache-license, Version 2.0. cc/by-nc CC BY NC", 2: "Licensed under the very GNU General Public License, version 3", 3: "This work is licensed under the new GNU General Public License, version 3.",
        4: "public license general", 5: "released under the mit license " * 3,
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].base_labels, got[1].first_word, got[1].last_word, got[1].n_words) == (4, "apache-2,cc-by-nc,mit", 1, 13, 16)
    assert got[3].labels == "gpl-3" and 0.75 <= got[3].score <= 1 and got[3].base_labels == ""
    assert got[4].labels == "" and got[4].score == 0
    assert got[5].n_base == 3 and got[5].last_word == 11 and got[5].labels == "mit"
    rows = licenses.scan(odd).collect()
    want = sorted(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, _, _ in ODD)
    assert sorted(r.n_words for r in rows) == want and all(r.labels == "" for r in rows)
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("sent", [licenses.SENT, 0])
def test_phrases_that_begin_at_one_place_all_count(spark, monkeypatch, sent):
    monkeypatch.setattr(licenses, "SENT", sent)
    docs = spark.createDataFrame([(1, "x cc by nc sa y cc by nc")], "doc_id long, text string")
    got = licenses.scan(docs, templates={"t": ("a b c d",)}, phrases={"nc": "cc by nc", "sa": "cc by nc sa"}).first()
    assert (got.n_base, got.base_labels, got.first_word, got.last_word) == (3, "nc,sa", 1, 6)


def test_licenses_against_plain_search(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        w = licenses.words_of(r.text)
        at = {(i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert set(filter(None, g.base_labels.split(","))) == {x for _, x in at} <= set(g.labels.split(",")) | {""}
        grams = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for label, texts in licenses.TEMPLATES.items():
            if any(" ".join(licenses.words_of(t)) in " ".join(w) and set(zip(*[licenses.words_of(t)[i:] for i in range(3)], strict=False)) <= grams for t in texts):
                assert label in g.labels.split(",")


# 7

TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x", "\\", "<|im_<|im_end|>", "", "[\\INST]<<SYS>>", "a\nb\n", "<\\s>"]


def test_turns_round_trip():
    for role, text in itertools.product(["user", "assistant", "a\nb\\n", "<s>"], TRICKY):
        turn, a, b = chat.render(role, text)
        assert chat.parse(turn) == (role, text) and chat.unescape(turn[a:b]) == text
        assert turn.count(chat.OPEN) == turn.count(chat.CLOSE) == 1 and "[INST]" not in turn[a:b]


def test_events_fold(spark):
    log = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "delta", "m", "assistant", "he"), (1, 3, "delta", "m", None, "llo"), (1, 4, "message", None, "user", "gone"), (1, 5, "regenerate", "m", None, None),
        (1, 6, "delta", "m", None, "hey"), (1, 7, "edit", "e", "user", "v1"), (1, 8, "edit", "e", None, "v2"), (1, 9, "message", "d", "user", "x"), (1, 10, "delete", "d", None, None),
        (2, 1, None, None, None, None), (None, 1, "message", None, "user", "null conversation"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = sorted(((r.conv_id or 0), r.seq, r.role, r.text) for r in chat.messages(df).collect())
    assert got == [(0, 1, "user", "null conversation"), (1, 1, "user", "hi"), (1, 2, "assistant", "hey"), (1, 7, "user", "v2"), (2, 1, "", "")]
    assert chat.digests(chat.format_conversations(df)).count() == 3
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def in_order(log):
    """A plain fold of each conversation in order of seq: what ``messages`` has to give."""
    out = {}
    for conv in {e[0] for e in log}:
        told, texts = {}, {}
        rows = sorted((e for e in log if e[0] == conv), key=lambda e: (e[1], e[2], e[5] or ""))
        for i, (_, seq, kind, mid, role, text) in enumerate(rows):
            mid = mid or f"-{i}"
            if kind in ("regenerate", "delete") and mid.startswith("-"):
                continue
            if mid not in told:
                told[mid] = [seq, None, True]
            told[mid][1] = role if role is not None else told[mid][1]
            if kind == "regenerate":
                start = told[mid][0]
                for other in [m for m, (s, _, _) in told.items() if start < s < seq]:
                    told[other][2] = False  # dropped, whatever comes to it later
                texts[mid] = ""
            elif kind == "delete":
                texts[mid] = None
            elif kind == "delta" and texts.get(mid) is not None:
                texts[mid] += text or ""
            else:
                texts[mid] = text or ""
        out[conv] = sorted((s, r or "", texts[m]) for m, (s, r, stays) in told.items() if stays and texts[m] is not None)
    return out


def test_random_logs_against_a_fold_in_order(spark):
    r, log = random.Random(7), []
    for conv in range(25):
        for seq in range(r.randint(1, 25)):
            kind = r.choice(["delta", "delta", "message", "edit", "regenerate", "delete", "delta"])
            log.append((conv, seq, kind, r.choice([None, "a", "b", "c"]), r.choice([None, "user", "assistant"]), r.choice(["x", "yy", "", None])))
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(5)
    got = {c: [] for c in range(25)}
    for m in chat.messages(df).collect():
        got[m.conv_id].append((m.seq, m.role, m.text))
    assert {c: sorted(x) for c, x in got.items()} == in_order(log)


def test_texts_as_events_come_back(spark):
    long = "long " * 20000 + "end"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ab"), (1, 1, "assistant", "ab"), (1, 1, "user", ""), (1, 2, None, None), (2, None, "assistant", TRICKY[0]), (None, 5, "assistant", long), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumn("id", F.lit(1)).withColumn("kind", F.lit("delete"))
    log = chat.as_events(df)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds == {"delta": 5 * len(rows), "message": len(rows), "edit": len(rows), "regenerate": len(rows)}
    got = sorted((m.conv_id or 0, m.role, m.text) for m in chat.messages(log).collect())
    assert got == sorted((c or 0, r or "", t or "") for c, _, r, t in rows)
    plain = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.turns(df.select("conv_id", "seq", "role", "text"))).collect()}
    assert {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_conversations(log)).collect()} == plain


def test_digests_against_a_loop(spark):
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], TRICKY[(c * 3 + t) % len(TRICKY)] + f" {t}") for c in range(9) for t in range(c)]
    shown = chat.turns(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").repartition(3))
    got = {r.conv_id: r for r in chat.digests(shown).collect()}
    texts = {}
    for r in sorted(shown.collect(), key=lambda r: (r.conv_id, r.seq)):
        assert r.start == len(texts.get(r.conv_id, ""))
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.turn
    for c in range(1, 9):
        own = [x for x in rows if x[0] == c]
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        lost = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(texts[c]))


# 8


def test_boundaries_are_optimal():
    r = np.random.default_rng(8)
    for _ in range(150):
        n, k = r.integers(1, 8), int(r.integers(1, 5))
        size, count = np.sort(r.choice(40, n, replace=False)), r.integers(1, 9, n)
        cost = lambda tops, size=size, count=count: sum(c * (min(t for t in tops if t >= s) - s) for s, c in zip(size, count, strict=True))
        got = packing.boundaries(size, count, k)
        assert len(got) <= k and cost(got) == min(cost({*x, size[-1]}) for m in range(k) for x in itertools.combinations(size[:-1], m))
    assert packing.boundaries(np.array([]), np.array([])) == []


def test_packing_holds_every_word(spark, sf, odd, none):
    for docs, rows in ((table(spark, sf, "documents"), None), (odd, ODD)):
        got = packing.pack(docs, max_length=100, buckets=5, batch_tokens=1000).toPandas()
        want = sorted(len(words(r.text)) for r in docs.select("text").collect())
        own = got.groupby([got.doc_id.fillna(-1), "copy", got.groupby([got.doc_id.fillna(-1), "copy"])["piece"].transform("size")])
        assert got["length"].sum() == sum(want) and (got["length"] <= got.bucket).all() and len(own) > 0
        batch = got.groupby("batch").agg(n=("slot", "size"), b=("bucket", "first"), kinds=("bucket", "nunique"), top=("slot", "max"))
        assert (batch.kinds == 1).all() and ((batch.n * batch.b <= 1000) | (batch.n == 1)).all() and (batch.top + 1 == batch.n).all()
        assert got.bucket.nunique() <= 5
    assert packing.pack(none).count() == 0


# 9


def test_gradient_against_differences():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = toxicity.Features()
    parts = [f.ids(toxicity.words(t)) for t in ("a bad one here", "fine", "one more fine text")]
    hashed, (idx, length), y = f.hashed(), toxicity._padded(parts), np.array([1.0, 0.0, 1.0])
    loss = lambda: net.gradient(net.inputs(hashed), hashed, idx, length, y)[0]
    _, g = net.gradient(net.inputs(hashed), hashed, idx, length, y)
    r = np.random.default_rng(0)
    for k in ("Wf", "Ub", "Uf", "bf", "a", "o", "ob", "E", "C"):
        p, flat = net.p[k].reshape(-1), np.abs(g[k].reshape(-1))
        for i in {int(flat.argmax()), int(r.choice(np.flatnonzero(flat)))}:
            old, eps = p[i], 3e-3
            p[i] = old + eps
            up = loss()
            p[i] = old - eps
            down = loss()
            p[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(float(g[k].reshape(-1)[i]), rel=0.1, abs=3e-5), k


def test_windows_cover_all_words():
    for n in (0, 1, 48, 49, 84, 85, 1000):
        got = toxicity.windows(np.arange(n))
        assert set(np.concatenate(got).tolist()) == set(range(n)) and max(map(len, got)) <= toxicity.WINDOW
        assert all(a[0] < b[0] <= a[-1] + 1 for a, b in itertools.pairwise(got))
    assert "".join(toxicity.words("x" * 1000)) == "x" * 1000


def test_toxicity_on_held_out_documents(spark, none):
    r = random.Random(9)
    plain = ["".join(r.choice("aeioulrnst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(600):
        w, bad = [r.choice(plain) for _ in range(r.randint(5, 150))], i % 3 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["grumpf", "grumpfen", "xyzzer"]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(601, None), (602, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).withColumn("h", held_out(F.col("doc_id"))).toPandas()
    own = got[got.h & (got.doc_id < 600)]
    assert len(got) == 603 and got.tox_score.between(0, 1).all()
    assert (own.tox_predicted == (own.doc_id % 3 == 0)).mean() > 0.95
    assert got[got.doc_id.isin([601, 602])].tox_score.nunique() == 1
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels.limit(0)).agg(F.max('tox_score'), F.count('*')).first() == (pytest.approx(0, abs=1e-6), 603)


def test_samples_are_bounded_whatever_repeats(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 1), (None, 1), (5, 7)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(1, f"copy {i}") for i in range(500)] + [(None, "x")] * 9, "doc_id long, text string")
    texts, y, w = toxicity.labelled_sample(docs, labels, 20)
    assert len(texts) == 40 and sum(y) == 20 and w[0] > 1
    again = toxicity.labelled_sample(docs.repartition(7), labels.repartition(3), 20)
    assert again == (texts, y, w)
    one, y1, _ = toxicity.labelled_sample(docs.where("doc_id = 1"), labels, 500)
    assert len(one) == 1 and y1 == [1]


def test_toxicity_of_long_texts_repeats_and_clashes(spark, none):
    net = toxicity.Network(3)
    clean, bad = "plain words here " * 3000, "one awful window " * 20
    assert toxicity.score_texts(net, [clean + bad + clean])[0] >= max(toxicity.score_texts(net, [clean])[0] - 1e-6, 0)
    docs = spark.createDataFrame([(1, clean, 1), (1, clean, 1), (2, None, 1), (None, "", 1)], "doc_id long, text string, h int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, names=("a", "b"))
    assert got.columns == ["doc_id", "text", "h", "a", "b"] and len({r.a for r in got.where("doc_id = 1").collect()}) == 1 and got.count() == 4
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("TOX_SCORE", F.lit(1)), labels)


def test_scores_do_not_hang_on_company():
    net = toxicity.Network(2)
    texts = ["one two three " * 40, "four", "", None, "five six " * 300]
    together = toxicity.score_texts(net, texts)
    assert together == pytest.approx([toxicity.score_texts(net, [t])[0] for t in texts], abs=1e-5)


# 10


def brute_attribute(ends, bounds, rule):
    n, crossing, start = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
    for e in ends:
        by = [sum(bounds[s] <= x < bounds[s + 1] for x in range(start, e)) for s in range(len(n))]
        touched = [s for s, b in enumerate(by) if b]
        own = {"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda s: (by[s], -s))}[rule]
        n[own] += 1
        crossing[own] += len(touched) > 1
        start = e
    return n, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_against_brute_force(rule):
    r = random.Random(rule)
    for _ in range(200):
        size = r.randint(0, 40)
        ends = sorted({r.randint(1, size) for _ in range(size // 3)} | {size}) if size else []
        bounds = [0, *sorted(r.randint(0, size) for _ in range(r.randint(0, 6))), size]
        got = tokens.attribute(np.array(ends, int), np.array(bounds), rule)
        assert tuple(x.tolist() for x in got) == brute_attribute(ends, bounds, rule)


def test_tokens_add_up(spark, sf, odd, none):
    with open(queries.TOKENIZER, "rb") as f:
        coding = tokens.Encoder(f.read()).coding
    for docs in (table(spark, sf, "documents"), odd):
        got = tokens.count_tokens(docs, queries.TOKENIZER).toPandas()
        want = sorted(len(coding.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
        assert got.n_tokens.sum() == sum(want) and got.n_chars.sum() == sum(len(r.text or "") for r in docs.select("text").collect())
    fields = tokens.count_tokens(make(spark, [(1, "ab\ncd", "en", None)]), queries.TOKENIZER, fields=("lang", "source", "text"), by="field", joiner="").toPandas()
    assert fields.n_chars.tolist() == [2, 0, 5] and fields.n_tokens.sum() == len(coding.encode_ordinary("enab\ncd"))
    assert fields.n_crossing.sum() >= 0 and fields.field.tolist()[0] == 0
    lines = tokens.count_tokens(make(spark, [(1, "a\n\n\nb", None, None)]), queries.TOKENIZER).toPandas()
    assert lines.n_chars.tolist() == [2, 1, 1, 1] and lines.n_crossing.sum() == 1
    assert tokens.count_tokens(none, queries.TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(none, queries.TOKENIZER, rule="none")


def test_frames_have_fixed_columns(spark, sf):
    assert pd.DataFrame(packing.pack(table(spark, sf, "documents")).dtypes)[0].tolist() == ["doc_id", "copy", "piece", "start", "length", "bucket", "batch", "slot"]
