"""Lexical search, Merkle manifest and BPE by rank: edge cases and brute force."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import lexical, manifest, rank_bpe

LONG = "lorem ipsum dolor sit amet " * 5_000
OWN = "row g at n digest block top item term tf m k c t text2 a.b Upper word ids_ salt part".split()


def tiktoken_ids():
    import public_tokenizers
    import tiktoken

    with open(rank_bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def awkward_texts():
    r = random.Random(1)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    mixed = lambda: some([*map(chr, range(32, 127)), *map(chr, range(0xA0, 0x250)), "中", "文", "ก", "😀", "\n", "\t", "　"], 150)
    return [None, "", " ", "\n\n \t x", "It's what'll they'd  say", "a" * 3000, some("ab", 700), some("etaoin", 4000), "é中文字" * 200, " " * 500 + "x", "\x00\u0085​ x", LONG, *[mixed() for _ in range(20)]]


@pytest.mark.parametrize("memo", [rank_bpe.MEMO, 4])
def test_ranks_give_the_ids_of_the_library(spark, memo):
    texts = awkward_texts()
    rows = [(i // 2 if i % 5 else None, x, *["x"] * len(OWN)) for i, x in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    ids = tiktoken_ids()
    out = rank_bpe.decode(rank_bpe.encode(docs, memo=memo)).collect()
    assert len(out) == len(rows)
    for x in out:
        assert list(x.ids) == ids(x.text or "") and x.n_tokens == len(x.ids)
        assert bytes(x.decoded) == (x.text or "").encode() and all(x[c] == "x" for c in OWN)
    assert rank_bpe.decode(rank_bpe.encode(docs.limit(0))).count() == 0


def test_chunks_that_cannot_be_joined_have_another_way(spark, monkeypatch):
    monkeypatch.setattr(rank_bpe, "WINDOWS", (1,))
    r = random.Random(2)
    texts = ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (97, 130, 200, 333)] + ["ab" * 150]
    ids = tiktoken_ids()
    for x in rank_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert list(x.ids) == ids(x.text)


def test_ids_outside_of_the_vocabulary_are_an_error(spark):
    for bad in ([10_000_000], [None]):
        with pytest.raises(Exception, match="unknown token id"):
            rank_bpe.decode(spark.createDataFrame([(bad,)], "ids array<int>")).collect()


def ranked(docs, items, k):
    """What the search returns, by scoring every document: (item_id, rank, doc_id, score) and all texts' places."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [x for x in found if x[1]]
    big_n, big_l = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, (d, c) in enumerate(found):
            m = 50 + 50 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, i))
        out += [(item, n, None if none else d, -s) for n, (s, none, d, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, small", [(50, lexical.SMALL), (3, 0)])
def test_search_equals_scoring_every_document(spark, monkeypatch, k, small):
    monkeypatch.setattr(lexical, "SMALL", small)
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Ünï", "中文"]
    pick = lambda n: " ".join(words[min(int(r.expovariate(0.02)), 303)] if r.random() < 0.8 else r.choice(["the", "of", "The-of"]) for _ in range(n))
    docs = [(i, pick(r.randint(1, 80))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "-- \n"), (None, pick(30)), (None, pick(30)), (7, "the w1 w2"), (7, "the w1 w2"), (1003, LONG)]
    docs += [(2000 + i, "same words here w5 w6") for i in range(60)]
    items = [(i, pick(r.randint(1, 25))) for i in range(25)] + [(90, None), (91, ""), (None, "w5 w6"), (1, "w5 w6 w7"), (92, "nowhere-to-be-found"), (93, "THE")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(lexical.index(d, q, k), k).collect()
    assert sorted([tuple(x) for x in got], key=str) == ranked(docs, items, k)
    assert lexical.search(lexical.index(d.limit(0), q, k), k).count() == 0 and lexical.search(lexical.index(d, q.limit(0), k), k).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and each node's siblings (before, after) of a list of digests."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            first = where[i] // 3 * 3
            p.append(("".join(nodes[first : where[i]]), "".join(nodes[where[i] + 1 : first + 3])))
            where[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


@pytest.mark.parametrize("levels", [manifest.LEVELS, 1])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    r = random.Random(6)
    rows = [(i, f"t{i}", "en", r.choice(["a", "é", "z", None]), i) for i in range(70)]
    rows += [(None, None, None, None, None), (None, "x", "", "one", 1), (5, "again", None, "a", 1), (5, "again", None, "a", 1), (-3, LONG, "en", "", 2)]
    rows = [(*x, *["y"] * len(OWN)) for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN))
    out = manifest.manifest(docs.withColumn("leaf", manifest.leaf())).withColumns({"folded": manifest.folded(F.col("leaf"), F.col("path")), "proof": manifest.proof(F.col("path"))}).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda x: h(*map(part, (x[0], x[3], x[2], x[4], x[1])))
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is not None, (s or "").encode()))
    want, tops = [], []
    for s in sources:
        own = sorted((x for x in rows if x[3] == s), key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        tops.append((tree([leaf(x) for x in own]), own))
    root, above = tree([top for (top, _), _ in tops])
    for ((top, paths), own), rest in zip(tops, above):
        want += [(str(x[0]), leaf(x), top, root, h(*[a + b for a, b in p + rest])) for x, p in zip(own, paths)]
    assert sorted((str(x.doc_id), x.leaf, x.subroot, x.root, x.proof) for x in out) == sorted(want)
    assert all(x.folded == root and all(x[c] == "y" for c in OWN) for x in out)
    assert manifest.manifest(docs.limit(0).withColumn("leaf", manifest.leaf())).count() == 0
    alone = manifest.manifest(docs.where("doc_id = 0").withColumn("leaf", manifest.leaf())).first()
    assert alone.leaf == alone.subroot == alone.root and alone.path == []
