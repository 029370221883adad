"""The faster pre-token pattern against the published one."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F

from fieldtally.llm import rank_bpe


def test_plain_pattern(spark):
    assert rank_bpe.pattern() == rank_bpe.PLAIN
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    r = random.Random(3)
    parts = ["'", "s", "ll", " ", "  ", "\n", "é", "\x85", "\x1c", "\xa0", "​", "　", " ", "7", "½", ".", "𝒳", "re", "'ve", "᠎"]
    texts = ["".join(every), " ".join(every), *["".join(r.choices(parts, k=40)) for _ in range(500)]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    published = F.regexp_extract_all("text", F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))
    assert docs.where(rank_bpe.pieces(F.col("text")) != published).count() == 0
