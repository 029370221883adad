"""The queries that SQL can't express, with their digests, against brute force over the smallest tables."""

import hashlib
import os
import struct
from collections import Counter

import pytest

from fieldtally.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_op3(spark, texts, library):
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in queries.op3_bpe_roundtrip(spark, SF).collect()}
    want = {k: (len(ids := library(t)), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t)) for k, t in texts.items()}
    assert got == want


def test_op13(spark, texts):
    from test_new_operators import tiktoken_ids

    ids = tiktoken_ids()
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in queries.op13_rank_bpe(spark, SF).collect()}
    assert got == {k: (len(i := ids(t)), sha(",".join(map(str, i))), sha(t)) for k, t in texts.items()}


def test_op4(spark, texts):
    from test_brute import components_of

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {k: [w for w in t.translate(lower).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] for k, t in texts.items()}
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for k, w in words.items()}
    least = components_of(sets)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in queries.op4_near_dups(spark, SF).collect()}
    assert got == {k: (len(sets[k]), least[k], least[k] == k) for k in texts}


def test_op5(spark, texts):
    data = {k: t.encode() for k, t in texts.items()}
    seen = Counter(hash(b[i : i + 200]) for b in data.values() for i in range(len(b) - 199))
    want = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        want[k] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in queries.op5_substring_dedup(spark, SF).collect()}
    assert got == want


def test_op7(spark, texts, library):
    got = {x.doc_id: x for x in queries.op7_token_counts(spark, SF).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        n, third, two = len(t), len(t) // 3, 2 * len(t) // 3
        cut = t[:third] + t[third + 7 :]
        now = cut[:two] + " [edit] " + cut[two:]
        x = got[k]
        assert (x.n_tokens, x.n_chars) == (len(library(t)), n)
        assert (x.n_tokens_after, x.n_chars_after) == (len(library(now)), len(now)) and x.n_chars_reencoded >= 8
