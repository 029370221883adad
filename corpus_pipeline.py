"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back for the next stage, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import bpe, lines, mixing, near_dups, quality
from fieldtally.llm.common import SPACE_CHARS, packed, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps.

    A null or empty text fails and goes. Rows are judged one by one, so repeated rows stay or go together. All columns
    pass through, one named ledger as well; an empty table gives an empty one, and whole texts of any length are read.
    """
    return quality.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that is left without a word by that goes.

    The first of equal windows stays: by doc_id (nulls last), then by hashes of the text; of rows that repeat, one is
    first and the others go if all their lines are in windows. A null or empty text has nothing to remove and stays.
    n_chars, where there is such a column, follows the text; all others pass through, whatever their names.
    """
    done = lines.dedup_lines(packed(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    done = done.where((F.col("n_removed") == 0) | (F.translate("kept_text", SPACE_CHARS, "") != ""))
    gone = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    field = lambda c: F.col("row")[c]
    return done.select(*[F.when(gone, new[c.lower()]).otherwise(field(c)).alias(c) if c.lower() in new else field(c).alias(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts without a word (null or empty ones) are in no group and stay. Rows that share the doc_id which stays all
    stay. All columns pass through; an empty table gives an empty one.
    """
    return near_dups.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    A null source is a source. A text without words weighs nothing and is drawn at its source's rate, like any other;
    where all of a source has no words, nothing of it is drawn. Draws are the same in each run. All columns pass through.
    """
    return mixing.emit(mixing.mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), with a digest of the text decoded from them.

    ``text`` is replaced by n_tokens, ids and decoded_sha256; columns of these names are replaced, all others pass
    through. A null text has no ids; repeated rows get equal ones; a very long text is read in chunks.
    """
    sent = packed(docs, ("text", "n_tokens", "ids", "decoded_sha256"), text=F.col("text"))
    done = bpe.round_trip(sent, keep_text=False)
    done = done.withColumn("decoded_sha256", F.sha2("decoded", 256))
    return done.select("row.*", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_dups", near_dup_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the near-dedup nor the encoding; tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
