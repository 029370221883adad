"""Queries with SQL against DuckDB, and the pipeline against its stages by brute force."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(x[k]) for k in order) for x in df.collect())
    assert order == sorted(want.columns)
    assert got == sorted(tuple(plain(r[want.columns.index(k)]) for k in order) for r in want.fetchall())


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before.count(), docs.count())
    assert seen["quality"][1] < seen["quality"][0] and seen["near_dups"][1] < seen["near_dups"][0]
    # no near-duplicates are left before the mix, and the last stage gives the library's ids of each text
    rows = docs.dropDuplicates(["doc_id"]).collect()
    sets = []
    for r in rows:
        w = _words(r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or 100 * len(a & b) < 85 * len(a | b)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.bpe.default_vocabulary())
    text = {r.doc_id: r.text for r in rows}
    out = p.STAGES[-1][1](spark, docs, SF).withColumn("n", F.length("ids")).collect()
    assert len(out) == docs.count()
    for x in out:
        assert bytes(x.ids) == b"".join(i.to_bytes(4, "little") for i in t.encode(text[x.doc_id], add_special_tokens=False).ids)
