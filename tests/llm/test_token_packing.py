"""Packing by tokens: operator 8 and the pipeline's last stage."""

import pytest

import corpus_pipeline as pipeline
from sparkstore.llm import packing, queries, tokens
from sparkstore.llm.common import table


@pytest.fixture(scope="module")
def encoder():
    with open(queries.TOKENIZER, "rb") as f:
        return tokens.Encoder(f.read())


def sums(got):
    return got.groupby("doc_id")["length"].sum().to_dict()


def test_lengths_are_tokens(spark, sf, encoder):
    docs = table(spark, sf, "documents")
    want = {r.doc_id: len(encoder.ends(r.text or "")) for r in docs.collect()}
    for out in (queries.op8_pack_buckets(spark, sf), pipeline.pack_batches(spark, docs, sf)):
        got = out.toPandas()
        assert sums(got) == want and got["length"].max() <= packing.MAX_LENGTH
        batch = got.groupby("batch").agg(n=("slot", "size"), b=("bucket", "first"))
        assert ((batch.n * batch.b <= packing.BATCH_TOKENS) | (batch.n == 1)).all()


def test_texts_without_spaces_fill_batches(spark, encoder):
    rows = [(1, "x" * 70000), (2, "漢字" * 3000), (3, None), (4, ""), (5, "<|endoftext|> a"), (6, "one two")]
    got = packing.pack_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER).toPandas()
    assert sums(got) == {i: len(encoder.ends(t or "")) for i, t in rows}
    assert (got[got.doc_id == 1].sort_values("piece").start.diff().dropna() == packing.MAX_LENGTH).all() and (got.doc_id == 1).sum() > 1
    again = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER).groupBy("doc_id").sum("n_tokens").collect()
    assert sums(got) == {r[0]: r[1] for r in again}
    assert packing.pack_tokens(spark.createDataFrame([], "doc_id long, text string"), queries.TOKENIZER).count() == 0
