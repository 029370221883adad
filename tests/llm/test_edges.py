"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import bpe, chat, counts, lines, media, mixing, near_dups, quality, substrings, urls

LONG = "lorem ipsum dolor sit amet " * 20_000
BASE = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ledger string, mix string, n_lines string, host string, regions string"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, BASE, "en", "b", 1),
    (5, BASE, "en", "b", 1),
    (6, BASE, None, None, 1),
    (None, BASE, "en", "a", 1),
    (None, None, "en", "a", 1),
    (7, "é中\x00" * 100, "xx", "c", 300),
    (8, "one\ntwo\nthree\nfour", "en", "c", 1),
    (9, "one\ntwo\nthree\nfive", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality(docs, empty):
    r = {(x.doc_id, x.text): x for x in quality.ledger(docs).collect()}
    assert r[1, None].ledger.n_words == 0 and r[1, None].ledger.failed_bits & 1
    assert r[4, LONG].ledger.n_words == 100_000 and r[4, LONG].ledger.n_repeat_words == 100_000
    assert r[5, BASE].ledger.failed_bits == 0 and r[5, BASE].host == "x"
    assert quality.apply_policy(quality.ledger(docs)).count() == 4
    assert quality.ledger(empty).count() == 0
    a = {x.rule: x for x in quality.ablations(quality.ledger(docs)).collect()}
    assert a["(any)"].failed == 8 and a["too_few_words"].failed == 7
    assert {x.failed for x in quality.ablations(quality.ledger(empty)).collect()} == {0}


def test_mixing(docs, empty):
    m = mixing.mix(docs).collect()
    assert len(m) == len(ROWS) and all(0 <= x.mix.copies <= 2 for x in m)
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.emit(mixing.mix(docs)).columns == [c for c in docs.columns if c != "mix"]
    assert mixing.mix(empty).count() == 0
    equal = docs.where("doc_id = 6").crossJoin(docs.sparkSession.range(100)).drop("id")
    drawn = [x.mix.copies for x in mixing.mix(equal, share=2.5, most=2.5).collect()]
    assert sum(drawn) == 250 and set(drawn) == {2, 3} and mixing.emit(mixing.mix(equal, share=2.5, most=2.5)).count() == 250
    t = {x.source: x for x in mixing.targets(mixing.mix(docs).select("source", F.col("mix.size").alias("size"))).collect()}
    total = sum(x.source_size for x in t.values())
    assert sum(x.target for x in t.values()) == pytest.approx(1.5 * total)
    assert all(x.target <= 2 * x.source_size + 1e-9 for x in t.values())


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    for x in bpe.decode(bpe.encode(docs)).collect():
        want = t.encode(x.text or "", add_special_tokens=False).ids
        assert x.n_tokens == len(want) and bytes(x.ids) == b"".join(i.to_bytes(4, "little") for i in want)
        assert x.decoded == (x.text or "") and x.host == "x"
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_near_dups(docs, empty):
    r = near_dups.group(docs).collect()
    assert len(r) == len(ROWS)
    same = [x for x in r if x.n_shingles == 56]
    assert {x.component_id for x in same} == {5} and [x.kept for x in same].count(True) == 2
    assert all(x.kept and x.component_id == x.doc_id for x in r if x.n_shingles == 0)
    assert near_dups.group(empty).count() == 0
    assert set(near_dups.keep_one(docs).columns) == set(docs.columns)


def test_substrings(docs, empty):
    r = substrings.dedup_substrings(docs).collect()
    assert len(r) == len(ROWS)
    by = {x.doc_id: x for x in r if x.doc_id is not None}
    assert by[4].n_removed == len(LONG) and by[4].n_spans == 1 and by[1].n_bytes == 0
    assert by[5].n_removed == by[6].n_removed == len(BASE) and bytes(by[5].kept_bytes) == b""
    assert by[7].n_removed == 600 and by[8].n_removed == 0
    assert substrings.dedup_substrings(empty).count() == 0


def test_urls(spark):
    rows = [(1, None, 1), (2, "no host", 1), (3, "HTTP://A.Example.COM/en/x", 1), (4, "http://x.com?q", 1), (4, "http://x.com?q", 1), (5, "://", 1), (6, "http://bad.net/fr/1" + "/y" * 200, 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, verdict int").withColumn("bad", F.expr("if(page_id = 4, null, page_id > 3)"))
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("block", "net/fr/")]
    r = {x.page_id: x for x in urls.judge(p, rules, "bad").collect()}
    assert (r[1].host, r[1].path, r[1].verdict) == ("", "", "allow")
    assert (r[3].host, r[3].rule, r[3].verdict) == ("a.example.com", "example.com/en/", "block")
    assert (r[4].host, r[4].path, r[4].rule, r[4].support, r[4].verdict) == ("x.com", "", None, 0, "allow")
    assert r[6].verdict == "block" and urls.judge(p, rules, "bad").count() == 7
    assert urls.judge(p.limit(0), rules, "bad").count() == 0


def _jobs(spark, run) -> int:
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before


def test_url_jobs_grow_with_branching_points_and_not_with_length(spark):
    def judged(urls_):
        p = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").withColumn("bad", F.col("page_id") % 2 == 0)
        return lambda: urls.judge(p, [("block", "net/")], "bad").collect()

    # the second pair shares a long beginning; in the third, each path is the beginning of the next
    few = _jobs(spark, judged(["http://a.com/x/1", "http://a.com/x/b"]))
    assert _jobs(spark, judged(["http://a.com/" + "x/" * 60 + "1", "http://a.com/" + "x/" * 60 + "b"])) <= few + 5
    assert _jobs(spark, judged(["http://a.com/" + "x/" * k for k in range(1, 60)])) <= few + 5


def test_near_dups_with_many_rows_of_one_id_and_of_none(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(None if i % 2 else 7, text(i // 4 if i < 2000 else i)) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    r = near_dups.group(d).collect()
    assert len(r) == 4000 and all(x.n_shingles == 8 for x in r)
    # four rows of a text, two of them without an id: the group's least id is 7, as it is for rows of id 7 alone
    assert sum(x.component_id == 7 for x in r) == 2000 + 1000 and sum(x.kept for x in r) == 3000


#: Names that operators give to columns of their own, now or in the past, and awkward ones.
OWN = """row k1 k2 n u r segments value stored todo edits doc id data lo hi place first size rate target starts later all copies
source_size h c p here before m mix2 node key label region bad support_ d k _n _c _p _size _rate _copy _u _s _r _k1 _k2 _lo _data _source
_kept_id _text _edits a.b Upper sig part chunk hub out_ i j mine theirs""".split()


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(1, "one two three\nfour\nfive\nsix", "a"), (2, "one two three\nfour\nfive\nsix", "a"), (3, None, None), (4, "x" * 300 + " y", "b")]
    return spark.createDataFrame([(*r, *[f"{r[0]}:{c}" for c in OWN]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in OWN))


OPERATORS = {
    "quality": lambda d: quality.ledger(d),
    "quality_keep": lambda d: quality.keep(d),
    "mix": lambda d: mixing.mix(d),
    "emit": lambda d: mixing.emit(mixing.mix(d)),
    "encode": lambda d: bpe.encode(d),
    "decode": lambda d: bpe.decode(bpe.encode(d)),
    "near_dups": lambda d: near_dups.keep_one(d),
    "substrings": lambda d: substrings.dedup_substrings(d),
    "urls": lambda d: urls.judge(d.withColumn("lbl", F.lit(True)), [("block", "net/")], "lbl", "text"),
    "plant": lambda d: counts.plant(d),
    "counts": lambda d: counts.count_tokens(d.withColumn("todo2", F.expr("array(named_struct('start', 1L, 'length', 2, 'text', 'zz'))")), "todo2"),
    "lines": lambda d: lines.dedup_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_pass_through(crowded, name):
    out = OPERATORS[name](crowded).collect()
    assert out or name == "quality_keep"
    for x in out:
        assert [x[c] for c in OWN] == [f"{x.doc_id}:{c}" for c in OWN]


def test_pipeline_stages_take_any_columns(spark, crowded):
    import corpus_pipeline as p

    plain = crowded.withColumn("ledger", F.lit("mine")).withColumn("n_chars", F.lit(7).cast("long"))
    for name, stage in p.STAGES:
        for docs in (plain, plain.limit(0), plain.union(plain)):
            out = stage(spark, docs, "")
            want = [c for c in docs.columns if name != "bpe" or c != "text"]
            assert out.columns == (want if name != "bpe" else [*want, "n_tokens", "ids", "decoded_sha256"])
            for x in out.collect():
                assert x.ledger == "mine" and [x[c] for c in OWN] == [f"{x.doc_id}:{c}" for c in OWN]


def test_counts(docs, empty):
    e = docs.withColumn("edits", F.when(F.col("doc_id") != 8, F.expr("array(named_struct('start', 3L, 'length', 2, 'text', 'zz'), null)")))
    for x in counts.count_tokens(e, "edits").collect():
        assert x.n_chars == len(x.text or "") and (x.doc_id != 8 or x.n_chars_reencoded == 0)
    assert counts.count_tokens(empty.withColumn("edits", F.expr("cast(null as array<struct<start:long,length:int,text:string>>)")), "edits").count() == 0


def test_media(docs, empty):
    r = media.store_and_read(docs).collect()
    assert len(r) == len(ROWS) and all(x.error is None for x in r)
    got = sorted((x.key or "", x.n_bytes, hashlib.sha256(x.payload).hexdigest()) for x in r)
    want = sorted((str(k) if k is not None else "", len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for k, t, *_ in ROWS)
    assert got == want
    assert media.store_and_read(empty).count() == 0
    none = media.store_and_read(docs.select(F.expr("if(doc_id = 8, 'None', null)").alias("k"), "text"), "k").groupBy("key").count().collect()
    assert {x.key: x["count"] for x in none} == {"None": 1, None: len(ROWS) - 1}


def test_media_are_what_other_libraries_read(spark, docs, tmp_path):
    """ZIP and PNG by the JVM's own readers; digests, feature and CRC of the query by the standard library."""
    import math
    import zlib
    from collections import Counter

    from fieldtally.llm import queries

    folder = f"file://{tmp_path}/b"
    media.write_archives(docs.coalesce(1), "doc_id", "text", folder)
    jvm, seen = spark.sparkContext._jvm, 0
    for name in (tmp_path / "b").glob("*.zip"):
        archive = jvm.java.util.zip.ZipFile(str(name))
        for entry in archive.entries():
            image = jvm.javax.imageio.ImageIO.read(archive.getInputStream(entry))
            place = int(entry.getName().split("/")[0])
            text = (ROWS[place][1] or "").encode()
            assert (image.getWidth(), image.getHeight()) == (192, max(1, -(-len(text) // 192)))
            raster = image.getRaster()
            for y in {0, image.getHeight() - 1}:
                line = raster.getPixels(0, y, 192, 1, spark.sparkContext._gateway.new_array(jvm.int, 192))
                assert bytes(line) == media.padded(text)[192 * y : 192 * y + 192]
            seen += 1
    assert seen == len(ROWS)
    docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates().write.parquet(f"{tmp_path}/documents.parquet")
    texts = {k: (t or "").encode() for k, t, *_ in ROWS if k is not None}
    for x in queries.op8_media(spark, str(tmp_path)).collect():
        data = texts[x.doc_id].ljust(max(192, -(-len(texts[x.doc_id]) // 192) * 192), b" ")
        n = Counter(data)
        bits = -sum(c / len(data) * math.log2(c / len(data)) for c in n.values())
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32) == (len(texts[x.doc_id]), len(data), zlib.crc32(data[-16:]))
        assert x.payload_sha256 == hashlib.sha256(data).hexdigest()
        assert x.media_sha256 == hashlib.sha256(media.to_image(texts[x.doc_id])).hexdigest() and x.media_bytes == len(media.to_image(texts[x.doc_id]))
        assert x.feature == f"192x{len(data) // 192};mean={sum(data) / len(data):.3f};bits={abs(bits):.3f}"


def test_media_survives_a_broken_member(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    media.write_archives(docs.coalesce(1), "doc_id", "text", folder)
    one = next((tmp_path / "a").glob("*.zip"))
    data = bytearray(one.read_bytes())
    at = data.index(b"IDAT", len(data) // 2 if data.count(b"IDAT") < 2 else 0) + 6
    data[at] ^= 0xFF
    one.write_bytes(bytes(data))
    r = media.measured(media.read_archives(spark, folder, 300)).collect()
    assert len(r) == len(ROWS) and sum(x.error is not None for x in r) == 1


def test_chat(spark):
    rows = [(1, 1, "assistant", "b <x> \\l # </turn>\n### user: "), (1, 0, "user", None), (1, 2, "user", "tail"), (2, 0, None, ""), (None, 0, "assistant", "q"), (1, 1, "assistant", "b <x> \\l # </turn>\n### user: "), (3, None, "a:b", "t")]
    t = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn int, role string, text string, example int")
    r = {x.conv_id: x for x in chat.read_back(chat.format_examples(t)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = rows[0][3]
    assert r[1].n_turns == 4 and r[1].turns_sha256 == sha("user\n\n" + f"assistant\n{said}\n" * 2 + "user\ntail\n")
    assert r[1].loss_sha256 == sha(said * 2) and r[1].loss_chars == 2 * len(said)
    assert r[2].turns_sha256 == sha("\n\n") and r[2].loss_chars == 0
    assert r[3].turns_sha256 == sha("a:b\nt\n") and r[None].loss_sha256 == sha("q")
    assert chat.format_examples(t.limit(0)).count() == 0


def test_lines(docs, empty):
    r = lines.dedup_lines(docs).collect()
    assert len(r) == len(ROWS)
    by = {x.doc_id: x for x in r}
    assert by[8].n_removed == 0 and by[9].kept_text == "five" and by[9].n_removed == 3
    assert by[1].kept_text is None and by[1].n_lines == 0 and by[4].n_removed == 0
    assert lines.dedup_lines(empty).count() == 0
    # of equal rows, one keeps its lines
    twice = docs.where("doc_id = 8")
    assert sorted(x.n_removed for x in lines.dedup_lines(twice.union(twice).union(twice)).collect()) == [0, 4, 4]
