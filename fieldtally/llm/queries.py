"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, counts, lexical, lines, manifest, media, mixing, near_dups, quality, rank_bpe, substrings, urls
from .common import bind, stored, words


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of every document, and whether the default policy keeps it."""
    done = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    base = quality.mask("base")
    return done.select(
        "doc_id", "ledger.n_words", "ledger.word_chars", "ledger.n_symbols", "ledger.n_dup_lines",
        "ledger.n_repeat_words", (F.col("ledger.failed_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        quality.kept_by().alias("kept"), "ledger.failed_bits",
    )


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op3_bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, keep_text=False))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Group of every document, by links of similar shingle sets."""
    return near_dups.group(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that each document loses to strings that also start elsewhere."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = substrings.dedup_substrings(docs).drop("text")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: (verdict, rule) of the query below.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


#: A page is bad if its visible text has fewer words than this, or more than a symbol in so many words.
PAGE_WORDS, PAGE_WORDS_A_SYMBOL = 60, 10
#: What is not visible text.
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def page_is_bad(html: Column) -> Column:
    """Label of a page by its content alone, so independent of its URL; null without content."""
    text = F.regexp_replace(html, MARKUP, " ")
    counted = F.transform(F.array(text), lambda t: F.struct(F.size(words(t)).alias("n"), (F.length(t) - F.length(F.translate(t, "#*$%|", ""))).alias("s")))[0]
    return F.when(html.isNotNull(), bind(counted, lambda c: (c["n"] < PAGE_WORDS) | (PAGE_WORDS_A_SYMBOL * c["s"] > c["n"])))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = stored(pages.select("page_id", "url", page_is_bad(F.col("html")).alias("bad")), "labelled-pages")
    done = urls.judge(pages, URL_RULES, "bad")
    return done.select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 6).alias("bad_share"), "support")


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document before and after two edits: seven code points cut out at a third, a word put in at two."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, length, text: F.struct(at.alias("start"), F.lit(length).alias("length"), F.lit(text).alias("text"))
    edits = F.array(edit(F.floor(n / 3), 7, ""), edit(F.floor(2 * n / 3), 0, " [edit] "))
    done = counts.revise(counts.plant(docs).withColumn("edits", edits), "edits", keep_text=False)
    return done.select("doc_id", "n_tokens", "n_tokens_after", "n_chars", "n_chars_after", "n_chars_reencoded")


def op8_media(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's stored image and of the samples read back from it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = media.store_and_read(docs)
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return done.select(
        F.col("key").cast("long").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each conversation, read back from its formatted examples."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.sql("select * from values (-7, 0, 'user', :said), (-7, 1, 'assistant', :said) as t(conv_id, turn, role, text)", {"said": said})
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    return chat.read_back(chat.format_examples(turns.unionByName(more)))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that each document loses, and a digest of what it keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = lines.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 highest-scoring documents of each benchmark item."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    return lexical.search(lexical.index(docs, items))


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, proof and verification of every document, after line feeds were deleted from about half of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*manifest.COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf, now = manifest.leaf(), manifest.leaf(text=changed)
    done = manifest.manifest(docs.select("doc_id", "source", leaf.alias("leaf"), F.when(now != leaf, now).alias("now")))
    done = done.withColumn("folded_root", manifest.folded(F.coalesce("now", "leaf"), F.col("path")))
    return done.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_rank_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each document's ids by rank and of the bytes decoded from them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    done = rank_bpe.decode(rank_bpe.encode(docs))
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    """Name to query."""
    found = (
        op1_quality_rules, op2_mix_sources, op3_bpe_roundtrip, op4_near_dups, op5_substring_dedup, op6_url_filter, op7_token_counts,
        op8_media, op9_chat_format, op10_line_dedup, op11_lexical_search, op12_manifest, op13_rank_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    from .oracle import SQL

    return SQL
