"""The pipeline's stages by themselves and together, and the registered queries."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as pipeline
from sparkstore.llm import language, queries, simhash, toxicity
from sparkstore.llm.common import table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    before = {r.doc_id for r in docs.collect()}
    kept = pipeline.drop_near_copies(spark, docs, sf)
    found = simhash.near_duplicates(docs).toPandas()
    assert kept.columns == docs.columns
    assert len(before) > kept.count() and {r.doc_id for r in kept.collect()} <= before and found.component_id.isin([r.doc_id for r in kept.collect()]).mean() > 0.9
    toxic = {r.doc_id for r in toxicity.score(docs, table(spark, sf, "labels")).where("tox_predicted = 1").collect()}
    assert {r.doc_id for r in pipeline.drop_toxic(spark, docs, sf).collect()} == before - toxic
    und = docs.limit(3).withColumn("text", F.lit("123 %%"))
    more = docs.unionByName(und)
    clean = pipeline.keep_known_language(spark, more, sf)
    assert clean.count() == docs.count() and clean.columns == docs.columns
    assert language.UNKNOWN == "und"


def test_whole_run(spark, sf):
    out = pipeline.run(spark, sf).toPandas()
    assert len(out) and out["length"].gt(0).all() and [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "packing"]


def test_empty_table(spark, tmp_path, sf):
    table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, repeats, long texts, ties and columns with the operators' names, in each stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, tox_score double, tox_predicted int, lang_pred string, lang_score double, __told string, __all long, m int, t long, n long, bits binary"
    text = "the cat sat on the mat and slept all day in the warm sun of spring"
    far = 100000
    own = [(1, None, None, None), (2, "", "en", "a"), (None, text, "en", "a"), (4, text, "en", "b"), (4, text, "en", "b"), (5, text + " again", "en", "b"), (6, "word other " * 30000, "en", "c"), (7, "x" * 70000, "fr", "c"), (4, "another text of the same id that is here", "en", None)]
    docs = spark.createDataFrame([(r[0] and r[0] + far, *r[1:], None, 0.5, 1, "mine", 0.5, "x", 7, 7, 7, 7, bytearray(b"k")) for r in own], schema)
    base = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(base, allowMissingColumns=True)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        if name == "packing":
            assert len(got) >= docs.count()
            continue
        assert out.columns == docs.columns and got
        kept = [r for r in got if r.lang_pred is not None]
        assert all((r.lang_pred, r["__told"], r["__all"], bytes(r.bits)) == ("mine", "x", 7, b"k") for r in kept)
        if name == "near_duplicates":
            assert sorted((str(r.doc_id - far), (r.text or "")[:10]) for r in kept) == sorted([("1", ""), ("4", text[:10]), ("6", "word other "[:10]), ("7", "x" * 10), ("4", "another te")])
        if name == "language":
            assert not [r for r in kept if not r.text]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}
    assert "pipeline" in __spark_entry__.queries()
