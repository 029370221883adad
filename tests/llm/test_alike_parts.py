"""Contexts are cut to what another one can repeat before they go to suffix arrays; no repeat is lost."""

from __future__ import annotations

import random

from fieldtally.llm.substrings import PIECE, SPAN, WIDTH, alike_parts
from fieldtally.llm.suffixes import repeated_starts


def made(r):
    """Contexts of one anchor: sides that agree with others' up to some byte; windows are equal at equal places only."""
    anchor, left, right = (bytes(r.randrange(256) for _ in range(n)) for n in (PIECE, SPAN - 1, SPAN - 1))
    other = lambda n: bytes(r.randrange(256) for _ in range(n))
    data, places = [], []
    for _ in range(r.randint(1, 7)):
        a, b = r.randint(0, SPAN - 1), r.randint(0, SPAN - 1)
        same_a, same_b = r.randint(0, a), r.randint(0, b)
        if a + PIECE + b >= WIDTH:
            data.append(other(a - same_a) + left[len(left) - same_a :] + anchor + right[:same_b] + other(b - same_b))
            places.append(a)
    return data, places


def test_no_repeat_is_lost():
    r, less = random.Random(3), 0
    for _ in range(150):
        data, places = made(r)
        found = [[] for _ in data]
        parts = alike_parts(data, places)
        for (i, first, part), starts in zip(parts, repeated_starts([p for *_, p in parts], WIDTH) if parts else ()):
            assert data[i][first : first + len(part)] == part and len(part) >= WIDTH
            found[i] = [first + s for s in starts]
        assert found == (repeated_starts(data, WIDTH) if data else [])
        less += sum(map(len, data)) - sum(len(p) for *_, p in parts)
    assert less > 0


def test_contexts_that_share_the_anchor_alone_are_left_out():
    r = random.Random(4)
    anchor = bytes(range(PIECE))
    data = [bytes(r.randrange(256) for _ in range(100)) + anchor + bytes(r.randrange(256) for _ in range(100)) for _ in range(5)]
    assert alike_parts(data, [100] * 5) == [] and len(alike_parts(data + data[:1], [100] * 6)) == 2
