"""Pre-tokens that are counted together, and those found by plain expressions, against the ways one by one."""

from __future__ import annotations

import random

from fieldtally.llm import bpe, counts


def texts(n):
    r = random.Random(7)
    parts = ["the", "ing", " ", "  ", "\n", "'s", "'ll", "é", "Ñ", "ß", "日本", "٣", "½", "ⅷ", " ", " ", "\x1c", "\x85", "𝒳", "𐒠", "🙂", "_", "...", "x" * 30, "7", "<|endoftext|>"]
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    return ["".join(r.choice(parts) if r.random() < 0.3 else "".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_counts_together():
    e = bpe.encoder(None)
    c = bpe.Counts(e.v)
    pieces = {p for t in texts(200) for p in e.find.findall(t)}
    c.learn(pieces)
    assert all(c[p] == len(bpe.Pieces(e.v)[p]) // 4 for p in list(pieces)[:2000])


def test_batch_is_not_searched_one_by_one(monkeypatch):
    e, docs = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary())), texts(100)
    want = [counts.cut(e, t) for t in docs]
    e.counts = bpe.Counts(e.v)
    single = bpe.Counts._count

    def long_only(self, data):
        assert len(data) > bpe.WIDTHS[-1]
        return single(self, data)

    monkeypatch.setattr(bpe.Counts, "_count", long_only)
    assert list(counts.cut_all(e, docs)) == want


def test_long_text_keeps_its_place():
    e, docs = bpe.encoder(None), ["first one", "longer " * bpe.CHUNK, "", "last"]
    assert list(counts.cut_all(e, docs)) == [counts.cut(e, t) for t in docs]


def test_plain_expression():
    e = bpe.encoder(None)
    for t in ["".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), *texts(300)]:
        assert e.found(t) == e.find.findall(t)
        narrow = e.beyond.sub("", t)
        assert e.plain.findall(narrow) == e.find.findall(narrow)
