"""Encoding and decoding in one pass: same columns as one after the other, one Python worker a task."""

from __future__ import annotations

import corpus_pipeline
from fieldtally.llm import bpe


def docs_of(spark):
    texts = [None, "", " a", "<|endoftext|> x", "é日本🙂", "word " * bpe.CHUNK, "It's what'll they'd  say\n\n", *[f"row {i}\t{i * 7919}" for i in range(50)]]
    return spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")


def test_round_trip_is_encode_then_decode(spark):
    docs = docs_of(spark)
    for keep in (True, False):
        want, got = bpe.decode(bpe.encode(docs, keep_text=keep)), bpe.round_trip(docs, keep_text=keep)
        assert got.columns == want.columns and [tuple(x) for x in got.collect()] == [tuple(x) for x in want.collect()]
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_pipeline_encodes_and_decodes_in_one_worker(spark):
    plan = corpus_pipeline.bpe_stage(spark, docs_of(spark), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
