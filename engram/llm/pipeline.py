"""Stages of the corpus pipeline: thin adapters from operators to tables with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, hyperminhash, line_dedup, quality, spiece
from engram.llm.common import fold, labelled_sample, read
from engram.llm.queries import tokenizer_path

REJECT_BELOW = 0.5


def free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least REJECT_BELOW. The classifier learns from labelled rows outside the held-out fold."""
    model = quality.fit(labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", fold("doc_id", 4) == 2, quality.SAMPLE))
    return quality.kept(docs, "text", model, REJECT_BELOW)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus. A document that holds nothing new goes, short and blank lines included
    (see line_dedup.dedup_documents); others keep their row, also those that had no text before. n_chars is counted anew where lines went."""
    out = line_dedup.dedup_documents(docs, "doc_id", "text")
    return (out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
            .drop("__lines", "__dropped"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the one of the smallest id); shingles of five words, similarity 0.8 or more.

    Rows without an id, and rows that share one, are judged by their own texts; of rows equal in id and text one stays, if they have words."""
    found = hyperminhash.near_duplicates(docs, "doc_id", "text", width=5, percent=80).filter("first AND n_shingles > 0")
    at, th, n = (free(docs, c) for c in ("at", "th", "n"))
    lead = found.groupBy(F.col("doc_id").alias(at), F.col("th").alias(th)).agg(F.count("*").alias(n))
    words = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = docs.filter(words).join(lead, docs["doc_id"].eqNullSafe(lead[at]) & (F.xxhash64(docs["text"]) == lead[th]))
    once = single.filter(F.col(n) == 1).unionByName(single.filter(F.col(n) > 1).dropDuplicates(["doc_id", th]))
    return once.select(*docs.columns).unionByName(docs.filter(~words))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    hits = decontam.matches(docs, "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text", width=10)
    at, th = free(docs, "at"), free(docs, "th")
    hits = hits.select(F.col("doc").alias(at), F.col("th").alias(th)).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits[at]) & (F.xxhash64(docs["text"]) == hits[th]), "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the tokens of every document and the text they decode to."""
    return spiece.tokenized(docs, "doc_id", "text", tokenizer_path())
