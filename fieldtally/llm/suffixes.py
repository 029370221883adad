"""Suffix arrays by linear grouping.

Suffixes are grouped by a known prefix, at first one letter. Groups are taken in descending order. When a group's turn
comes its prefix u is the Lyndon prefix of its members. A member s extends the one suffix p that ends its own prefix
at s and is in a lower group (s's previous smaller suffix): p's prefix grows by u, as often as u follows on itself.
Extended suffixes leave their group for new ones just above it, more repeats further up. Each s has one such p, so
this is linear. Then the order inside groups follows without renaming anything: in ascending order, a suffix that is
emitted appends to their groups all suffixes that continue with it behind their Lyndon prefix.
"""

from __future__ import annotations

from collections.abc import Sequence


def _above(h: int, under: int, found: list[int], size: int, group: list[int], members: list[list[int]], length: list[int], above: list[int], below: list[int], alive: list[int]) -> int:
    """A new group just above ``under`` of the members ``found`` of ``h``, whose prefix grows by ``size``."""
    new, over = len(length), above[under]
    members.append(found)
    length.append(length[h] + size)
    alive.append(len(found))
    alive[h] -= len(found)
    above.append(over)
    below.append(under)
    above[under] = new
    if over >= 0:
        below[over] = new
    for p in found:
        group[p] = new
    return new


def _lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, prefix length of each group, groups in ascending order)."""
    n = len(text)
    letters = sorted(set(text))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for s, g in enumerate(group):
        members[g].append(s)
    length = [1] * len(letters)
    above = [*range(1, len(letters)), -1]
    below = [*range(-1, len(letters) - 1)]
    alive = [len(m) for m in members]  # members that have not left their group
    back = [*range(-1, n)]  # back[s]: the suffix, not yet taken, whose prefix ends at s
    g = len(letters) - 1
    while g >= 0:
        size = length[g]
        once: dict[int, list[int]] = {}
        repeats: dict[int, dict[int, list[int]]] = {}
        for s in members[g]:
            if group[s] != g:
                continue
            p = back[s]
            if p < 0:
                end = s + size
                while end < n and group[end] == g:
                    end += size
                back[end] = p
                continue
            h = group[p]
            if h == g:  # inside a run of the same prefix; its first member counts
                continue
            end = s + size
            if end < n and group[end] == g:
                times = 1
                while end < n and group[end] == g:
                    end += size
                    times += 1
                repeats.setdefault(h, {}).setdefault(times, []).append(p)
            elif h in once:
                once[h].append(p)
            else:
                once[h] = [p]
            back[end] = p
        for h, by_times in repeats.items():
            if h in once:
                by_times[1] = once.pop(h)
            under = h
            for times in sorted(by_times):
                under = _above(h, under, by_times[times], times * size, group, members, length, above, below, alive)
        for h, found in once.items():
            if len(found) == alive[h]:  # all of a group grow alike: it stays one
                length[h] += size
            else:
                _above(h, h, found, size, group, members, length, above, below, alive)
        members[g] = []
        g = below[g]
    order, g = [], 0
    while g >= 0:
        order.append(g)
        g = above[g]
    return group, length, order


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of a text, in ascending order; a suffix is smaller than what it begins."""
    n = len(text)
    if not n:
        return []
    group, length, order = _lyndon_groups(text)
    # the suffixes that continue with e behind their Lyndon prefix, as a chain from head[e]
    head, following = [-1] * (n + 1), [-1] * n
    slots: list[list[int]] = [[] for _ in length]
    for s in range(n):
        e = s + length[group[s]]
        following[s] = head[e]
        head[e] = s
    s = head[n]
    while s >= 0:
        slots[group[s]].append(s)
        s = following[s]
    out: list[int] = []
    for g in order:
        here = slots[g]
        for e in here:  # grows while it is read
            s = head[e]
            while s >= 0:
                slots[group[s]].append(s)
                s = following[s]
        out += here
    return out


def repeated_starts(texts: list[bytes], width: int) -> list[list[int]]:
    """For each text, starts of strings of ``width`` bytes that also begin elsewhere in these texts."""
    data = b"\0".join([*texts, b""])
    places, ends = [], []
    for t in texts:
        at = len(ends)
        places.append(at)
        ends += [at + len(t) - width] * (len(t) + 1)
    letters = [b + 1 for b in data]
    for t, at in zip(texts, places):
        letters[at + len(t)] = 0
    found: list[int] = []
    last, last_key, marked = -1, b"", False
    for s in suffix_array(letters):
        if s > ends[s]:
            continue
        key = data[s : s + width]
        if key == last_key:
            if not marked:
                found.append(last)
            found.append(s)
            marked = True
        else:
            marked = False
        last, last_key = s, key
    found.sort()
    out: list[list[int]] = [[] for _ in texts]
    i = 0
    for s in found:
        while i + 1 < len(places) and s >= places[i + 1]:
            i += 1
        out[i].append(s - places[i])
    return out
