"""The pipeline's near-duplicate stage against every pair, and on planted copies at 0.8."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkstore.llm import similar, simhash
from sparkstore.llm.common import cut, named_only

SCHEMA = "doc_id long, text string, t long, n long"


def make(spark, rows):
    return spark.createDataFrame([(i, x, 7, 7) for i, x in rows], SCHEMA)


def brute(rows):
    """Smallest ids of the components of all pairs at a likeness of 0.8 or more."""
    def grams(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(x) for _, x in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def planted(r):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, shared = [], [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        for share in (0, 0, 0.02, 0.05, 0.09, 0.1, 0.11, 0.12, 0.15):  # about 0.8 at 0.11
            n = int(len(base) * share)
            rows.append(base[: len(base) - n] + [word() for _ in range(n)])
        step = len(base) // 12
        for k in range(6):  # a chain, ends far apart
            rows.append(base[k * step :] + [f"w{i}" for i in range(k * step)])
    for _ in range(40):  # only a passage in common
        rows.append(shared + [word() for _ in range(r.randint(3, 60))])
    for n in (0, 1, 2, 4, 5, 6, 8, 9, 10):
        rows += [shared[:n], shared[:n], [w.upper() for w in shared[:n]]]
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_no_pair_at_four_fifths_is_lost(spark, sf, monkeypatch):
    rows = planted(random.Random(5))
    want = brute(rows)
    for told in (similar.TOLD, 3):
        monkeypatch.setattr(similar, "TOLD", told)
        kept = dict(pipeline.STAGES)["near_duplicates"](spark, make(spark, rows), sf)
        assert sorted(x.doc_id for x in kept.collect()) == want


def test_stage_on_odd_rows(spark):
    text = "the cat sat on the mat and slept"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, text), (5, text), (5, text), (5, "another text of the same id here"), (None, "no id here at all"), (None, "no id here at all")]
    got = simhash.keep_one(make(spark, rows))
    assert got.columns == ["doc_id", "text", "t", "n"]
    assert sorted((str(x.doc_id), x.text) for x in got.collect()) == sorted([("1", None), ("5", text), ("5", "another text of the same id here"), ("None", "no id here at all")], key=lambda x: (x[0], x[1] or ""))
    assert simhash.keep_one(make(spark, rows).where(F.lit(False))).count() == 0


def test_pairs_of_two_parts_are_asked_in_rounds(spark, monkeypatch):
    """Copies of a text that is not there, with two changes (alike) or three (alike to some)."""
    r = random.Random(3)
    base, rows = [f"v{i}" for i in range(200)], []
    for k in range(90):
        text = list(base)
        for place in r.sample(range(5, 195), 2 if k < 65 else 3):
            text[place] = f"k{k}x{place}"
        rows.append((k, " ".join(text)))
    asked, confirmed = [], similar.confirmed

    def counted(docs, sets, pairs, shingle=similar.SHINGLE):
        pairs = pairs.persist()
        asked.append(pairs.count())
        return confirmed(docs, sets, pairs, shingle)

    monkeypatch.setattr(similar, "confirmed", counted)
    kept = simhash.keep_one(make(spark, rows)).collect()
    assert sorted(x.doc_id for x in kept) == brute(rows)
    assert sum(asked) < 1500, asked


def test_named_only(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) t", "id", "repeat('x', 50) text")
    for n in (0, 1, 300):
        named = cut(rows.where(f"id < {n}").select("t"))
        got = named_only(rows, "t", named)
        assert got.columns == rows.columns and sorted(x.id for x in got.collect()) == list(range(n))
