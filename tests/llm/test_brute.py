"""Operators against brute force, on generated tables with copies, near copies and shared passages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtally.llm import bpe, chat, components, counts, mixing, near_dups, substrings, suffixes, urls

WORDS = [f"w{i}" for i in range(400)]


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(3, 120))] for _ in range(n)]
    passage = [r.choice(WORDS) for _ in range(70)]
    hot = [r.choice(WORDS) for _ in range(90)]
    for i in range(n):
        kind = r.random()
        if kind < 0.15:
            base[i] = list(base[r.randrange(n)])
        elif kind < 0.4:
            base[i] = list(base[r.randrange(n)])
            for _ in range(r.randint(1, 3)):
                base[i][r.randrange(len(base[i]))] = r.choice(WORDS)
        elif kind < 0.55:
            at = r.randint(0, len(base[i]))
            base[i][at:at] = passage
        elif kind < 0.8:
            base[i] = list(hot)
            for _ in range(r.randint(0, 4)):
                base[i][r.randrange(len(hot))] = r.choice(WORDS)
    return [" ".join(b) for b in base]


def components_of(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_dups_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "DENSE", 60)
    monkeypatch.setattr(near_dups, "CHUNK", 16)
    t = texts(5, 400)
    sets = {}
    for i, x in enumerate(t):
        w = x.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    want = components_of(sets)
    r = near_dups.group(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in r} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def passages(seed: int, n: int) -> list[str]:
    """A common piece with ends that are common for some way: windows that are equal across blocks of one anchor."""
    r = random.Random(seed)
    letters = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    piece, left, right = letters(60), [letters(160) for _ in range(5)], [letters(160) for _ in range(5)]
    return [letters(60) + r.choice(left)[r.randrange(160) :] + piece + r.choice(right)[: r.randrange(160)] + letters(60) for _ in range(n)]


@pytest.mark.parametrize("made", ["documents", "passages"])
def test_substrings_remove_exactly_the_repeats(spark, monkeypatch, made):
    monkeypatch.setattr(substrings, "BLOCK", 8)
    t = [x + "é" * (i % 3) for i, x in enumerate(texts(9, 250))] + ["ab" * 300, "", None] if made == "documents" else passages(4, 300)
    data = [(x or "").encode() for x in t]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    want = {}
    for k, d in enumerate(data):
        gone = set()
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        spans = sum(1 for i in gone if i - 1 not in gone)
        want[k] = (len(d), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(d) if i not in gone)).hexdigest())
    r = substrings.dedup_substrings(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept_bytes).hexdigest()) for x in r} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=60))
def test_suffix_array(t):
    assert suffixes.suffix_array([ord(c) for c in t]) == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "'", "'ll", "\n", "é", "1", "!", "<|endoftext|>", "中", "th"]), max_size=40).map("".join))
def test_streaming_ids_equal_the_library(t):
    from tokenizers import Tokenizer

    e = bpe.encoder(None)
    want = _tokenizer(Tokenizer).encode(t, add_special_tokens=False).ids
    packed = list(e.stream(t))
    assert b"".join(packed) == b"".join(i.to_bytes(4, "little") for i in want)
    assert "".join(bpe.decode_stream(e.v.bytes_of, packed)) == t
    chunked = [(c, False) for c in t] + [("", True)]
    assert b"".join(e.stream(chunked)) == b"".join(packed)


def test_every_byte_passes_the_transducer(monkeypatch):
    """Neither short nor long pre-tokens have another way, and chunks of any size give equal ids."""
    fed = []
    read = bpe.Transducer._read
    monkeypatch.setattr(bpe.Transducer, "_read", lambda self, data: (fed.append(len(data)), read(self, data))[1])
    e = bpe.Encoder(bpe.encoder(None).v)
    t = " one two, three " + "x" * 500 + " é中"
    pieces = [p for ps, _ in e.lists([(t, True)]) for p in ps]
    out = b"".join(e.stream(t))
    assert len(set(pieces)) == len(pieces) and sum(fed) == len(t.encode()) == sum(len(p.encode()) for p in pieces)
    assert out == b"".join(e.stream((c, i == len(t) - 1) for i, c in enumerate(t)))


def test_merge_list_parts_neighbours_as_merging_does():
    v, r = bpe.encoder(None).v, random.Random(6)

    def merged(piece):
        ids = [v.base[b] for b in piece]
        while len(ids) > 1:
            rank, i = min((v.merges.get(p, (1 << 30,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            ids[i : i + 2] = [v.merges[ids[i], ids[i + 1]][1]]
        return ids

    all_ids = list(v.ids.values())
    short = [i for i in all_ids if len(v.bytes_of[i]) < 4]
    for k in range(20_000):
        a, b = (r.choice(short), r.choice(short)) if k % 2 else (r.choice(all_ids), r.choice(all_ids))
        assert v.apart(a, b) == (merged(v.bytes_of[a] + v.bytes_of[b]) == [a, b])


def test_state_is_bounded_by_the_lookahead(monkeypatch):
    """A stream of 20 million letters, without a break and with breaks: neither text, pre-token nor ids pile up."""
    import tracemalloc

    e = bpe.Encoder(bpe.encoder(None).v)
    for chunk in ("ab" * 32_768, "word and " * 8_192):
        tracemalloc.start()
        n, most = 0, 0
        for packed in e.stream((chunk, i == 7) for i in range(8)):
            n, most = n + len(packed), max(most, len(e.pieces.transducer.buffer))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and most <= 6 * e.v.lookahead and peak < 40 << 20


_CACHE: dict = {}


def _tokenizer(kind):
    return _CACHE.setdefault("t", kind.from_file(bpe.default_vocabulary()))


@pytest.mark.parametrize("t", ["a" * 3000, "ab" * 2000, " " * 2000, "x" * 65534 + "'ll hi", "=-" * 1500])
def test_long_pre_tokens(t):
    from tokenizers import Tokenizer

    e = bpe.encoder(None)
    assert b"".join(e.stream(t)) == b"".join(i.to_bytes(4, "little") for i in _tokenizer(Tokenizer).encode(t, add_special_tokens=False).ids)
    assert len(e.pieces.transducer.buffer) == 0


def test_edit_counts_equal_a_full_recount():
    from tokenizers import Tokenizer

    e = bpe.encoder(None)
    r = random.Random(3)
    parts = ["a", "the", "'", " ", "  ", "\n", "word ", "é", "1", "!", "<|endoftext|>", "<|end", "oftext|>", " x"]
    make = lambda n: "".join(r.choice(parts) for _ in range(r.randint(0, n)))
    count = lambda x: len(_tokenizer(Tokenizer).encode(x, add_special_tokens=False).ids)
    for _ in range(80):
        x = make(2000)
        tree = counts.CountTree(e, counts.cut(e, x))
        for _ in range(4):
            s, n, y = r.randint(0, len(x)), r.choice([0, 1, 3, 60, 900]), make(r.choice([0, 3, 150]))
            tree.edit(s, n, y)
            x = x[:s] + y + x[s + n :]
            assert tree.n_tokens == count(x) and tree.n_chars == len(x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<#/:bhlc \n>turn", max_size=30))
def test_escapes_can_be_undone(t):
    out = t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    assert "<" not in out and "#" not in out and chat.END not in out
    assert out.replace("\\l", "<").replace("\\h", "#").replace("\\c", ":").replace("\\b", "\\") == t


def test_components(spark):
    r = random.Random(2)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(200))] + [(f"{i:03}", f"{i + 1:03}") for i in range(400, 460)]
    parent: dict = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    own = {n for a, b in edges if a != b for n in (a, b)}
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: root(n) for n in own}


def test_systematic_draws_stay_near_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["x"] * min(3000, int(r.paretovariate(1.2) * 20))), r.choice("aaab") if i % 9 else None) for i in range(3000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for x in m:
        taken[x.source] += x.mix.copies * x.mix.size
        target[x.source] = x.mix.target
        most[x.source] = max(most[x.source], x.mix.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * most[s]


def templates_by_hand(rows):
    """Template, share and support of each (host, segments), level by level, from rows (host, segments, bad or None)."""
    z, prior = urls.ALIKE_Z, urls.PRIOR
    looks = re.compile(urls.IDENTIFIER)
    share_all = (sum(b or 0 for *_, b in rows) + prior * urls.PRIOR_BAD) / (sum(b is not None for *_, b in rows) + prior)

    def alike(own, pool):
        (b, n), (pb, pn) = own, pool
        if not n or pn == n:
            return None
        p = pb / pn
        v = max(p * (1 - p), 0.01) * (1 / n + 1 / (pn - n))
        return abs(b / n - (pb - b) / (pn - n)) < z * v**0.5

    def counted(rs):
        return sum(b or 0 for *_, b in rs), sum(b is not None for *_, b in rs)

    out = {}

    def walk(rs, template, up):
        bad, labelled = counted(rs)
        share = (bad + prior * up) / (labelled + prior)
        depth = len(template)
        for h, s, _ in rs:
            if len(s) == depth:
                out[h, s] = (template, share, labelled)
        kids = defaultdict(list)
        for r in rs:
            if len(r[1]) > depth:
                kids[r[1][depth]].append(r)
        named = {k: v for k, v in kids.items() if not looks.search(k)}
        opaque = {k: v for k, v in kids.items() if looks.search(k)}
        sides = {}
        for k, v in named.items():
            b, n = counted(v)
            sides[k] = ("{bad}" if b >= urls.REJECT * n else "{good}") if n else None
        pool = lambda ks: tuple(map(sum, zip(*[counted(kids[k]) for k in ks])))
        varies = len(named) >= urls.MANY and sum(map(len, named.values())) < urls.RARE * len(named)
        merged = defaultdict(list)
        for k, v in kids.items():
            to = k
            if k in opaque:
                if alike(counted(v), pool(opaque)) in (None, True):
                    to = "*"
            elif varies:
                to = "*"
            elif sides[k] and alike(counted(v), pool([x for x in named if sides[x] == sides[k]])):
                to = sides[k]
            merged[to] += v
        for to, v in merged.items():
            walk(v, (*template, to), share)

    for host in {h for h, *_ in rows}:
        walk([r for r in rows if r[0] == host], (), share_all)
    return out


def test_templates_equal_those_made_by_hand(spark):
    r = random.Random(12)
    kinds = {"news": 0.05, "blog": 0.1, "promo": 0.9, "win": 0.85, "mixed": 0.5}
    rows = []
    for i in range(3000):
        host = r.choice(["a.org", "b.org", "c.net"])
        kind = r.choice(list(kinds))
        path = [kind] + [r.choice(["x", "y", f"p{r.randrange(40)}", str(r.randrange(900)), "deadbeef" * 2, "wörter"]) for _ in range(r.randrange(4))]
        if r.random() < 0.1:
            path = [f"word{'abcdefghij'[r.randrange(10)]}{'klmnopqrst'[r.randrange(10)]}"]
        bad = None if r.random() < 0.3 else int(r.random() < kinds[kind])
        rows.append((host, tuple(path), bad))
    want = templates_by_hand(rows)
    p = spark.createDataFrame([(i, f"http://{h}/" + "/".join(s), None if b is None else bool(b)) for i, (h, s, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = urls.judge(p, [("allow", "c.net/news")], "bad").collect()
    seen = set()
    for x in got:
        h, s, _ = rows[x.page_id]
        template, share, support = want[h, s]
        assert (x.template, x.support) == ("/" + "/".join(template), support) and abs(x.bad_share - share) < 1e-9
        ruled = h == "c.net" and x.path.startswith("/news")
        assert x.verdict == ("allow" if ruled or support == 0 or share < urls.REJECT else "block")
        seen.update(template)
    assert {"*", "{good}", "{bad}"} <= seen and {x.verdict for x in got} == {"allow", "block"}


def test_no_label_no_block(spark):
    p = spark.createDataFrame([(1, "http://x.org/bad/1", True), (2, "http://y.org/q/2", None)], "page_id long, url string, bad boolean")
    assert {x.page_id: x.verdict for x in urls.judge(p, [], "bad").collect()} == {1: "block", 2: "allow"}


def test_templates_reject_what_labels_reject(spark):
    """Held-out purity: unlabelled pages of a bad template are blocked, those of a good one aren't."""
    rows = []
    for i in range(600):
        kind = "promo" if i % 3 == 0 else "news"
        label = None if i % 5 == 0 else kind == "promo"
        rows.append((i, f"http://site.org/{kind}/{i}", label))
    p = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    r = urls.judge(p, [], "bad").collect()
    held = [x for x in r if x.page_id % 5 == 0]
    assert sum((x.verdict == "block") == ("promo" in x.url) for x in held) == len(held)
    assert {x.template for x in r} == {"/promo/*", "/news/*"}


def test_templates_part_at_any_depth(spark):
    """Branches that part at the fifth segment are told apart, and so are labelled segments that hold digits."""
    rows = []
    for i in range(600):
        kind = "casino" if i % 3 == 0 else "news"
        label = None if i % 5 == 0 else kind == "casino"
        rows.append((i, f"http://site.org/en/shop/a/b/{kind}/x/{i}", label))
        rows.append((i + 600, f"http://deals.org/{'web2-spam' if kind == 'casino' else 'top10'}/{i}", label))
    p = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    r = urls.judge(p, [], "bad").collect()
    held = [x for x in r if x.page_id % 5 == 0]
    assert len(r) == 1200
    assert [x.url for x in held if (x.verdict == "block") != ("casino" in x.url or "spam" in x.url)] == []
    assert {x.template for x in r} == {"/en/shop/a/b/casino/x/*", "/en/shop/a/b/news/x/*", "/web2-spam/*", "/top10/*"}


def test_counts_are_those_of_the_ids():
    from fieldtally.llm import bpe

    e = bpe.encoder(None)
    r = random.Random(5)
    letters = ["ab", "etaoinshr", " \n\t", "éñüß", "0123456789", "中文字", ".,;:!-=#*", "aÁ😀"]
    pieces = {"".join(r.choice(r.choice(letters)) for _ in range(r.randint(1, 24))) for _ in range(20_000)} | {"a" * 3000, "ab" * 400}
    assert all(e.counts[p] == len(e.pieces[p]) // 4 for p in pieces)


def test_stored_leaves_with_nulls_are_made_anew(spark):
    from fieldtally.llm import counts

    kinds = f"text string, leaves {counts.LEAVES}, edits array<struct<start: long, length: int, text: string>>"
    d = spark.createDataFrame([("some words", x, None) for x in (None, [], [None], [(None, 2)], [(10, 2)])], kinds)
    got = counts.revise(d, "edits").collect()
    assert [(x.n_tokens_after, x.n_chars_after) for x in got][:4] == [(got[0].n_tokens_after, 10)] * 4 and got[4].n_chars_reencoded == 0
