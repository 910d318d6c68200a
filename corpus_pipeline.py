"""Documents to training tokens in stages; each stage reads what the one before it wrote.

All stages but the last return the columns of ``documents``, extra ones too, whatever their names.  The near-duplicate stage takes
shingles of five words and a similarity of 0.8; mixing repeats a document as often as the schedule takes its words, so one ``doc_id`` may
come several times after it.

Null, empty and blank texts have no words, so the first stage drops them.  Rows without an id, a language or a source are rows like any
other, but that they are never near duplicates.  Rows that repeat an id count as one document: all of them go or stay.  Texts of any length are
taken whole.  An empty table, or one of which nothing is kept, gives an empty result with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamis.llm import bpe, mixing, near_dup, quality, secret_scan
from tamis.shared import discard, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps; null and empty texts go, ties and repeats are judged alike."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each near-duplicate group; rows without an id stay, as do all rows of an id that stays."""
    return near_dup.keep_firsts(docs, width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of their secrets masked and ``n_chars`` to match; a null text stays null."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them; a null source is one, texts without words are not taken."""
    return mixing.keep_mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests of the ids and of what they decode to; a null text has none."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, ids=True, digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Near-duplicate groups, hashed streams and tokenizer merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = materialise(made, f"stage-{k}-{name}")
        discard(before)
        before = docs
    return docs
