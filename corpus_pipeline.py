"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, minhash, packing, quality
from tidemark.llm.common import cut, forget, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that the classifiers know, without doubt. Texts that are NULL, empty or
    without a letter go; very long ones are read whole; at a tie of languages the document goes; repeated
    rows go or stay together; an empty table stays empty. As in all stages but the last, other columns ride
    along untouched, whatever their names."""
    return langid.filter_language(docs, langid.fit(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that break no quality rule. NULL, empty and blank texts break one; very long ones are
    measured whole; repeated rows are judged alike; an empty table stays empty."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of near duplicates. Rows with a NULL id or
    without words stay; rows that repeat a kept id are one document and all stay; an empty table stays empty."""
    return minhash.filter_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without passages of the benchmark. NULL texts stay; repeated rows go or stay together;
    an empty benchmark drops nothing; an empty table stays empty."""
    return decontam.filter_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; ids as their crc32. NULL and empty texts are one end id, repeated rows are
    packed each for itself, very long ones are cut over many sequences; an empty table gives no pieces."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL has neither classifiers nor the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again, and goes when the next
    is written."""
    docs, written = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if written is not None:
            forget(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
