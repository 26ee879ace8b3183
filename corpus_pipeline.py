"""The corpus pipeline: quality, repeated lines, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``, and further columns of their input as they are, whatever their names.

Null and empty texts pass every stage but the classifier, which scores them like any text.
Rows without an id, and rows repeated under one, are judged by their texts; near-dedup keeps
rows repeated under one id together, and drops one without an id if a document with an id stands
for it. An empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwise.llm import bpe, decontam, line_dedup, near_dedup, quality
from claimwise.llm.common import bounded_batches, free_name, materialize, table
from claimwise.llm.queries import RANKS


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; learned from labelled rows outside the held-out ones."""
    bounded_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=lambda i: ~quality.held_out(i))
    return quality.drop_poor(docs, model)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text. A document that loses
    every line it had goes: others hold all of it."""
    bounded_batches(spark)
    n = free_name(docs, "n_removed")
    out = line_dedup.dedup_lines(docs, count_col=n)
    changed = F.col(n) > 0
    emptied = changed & ~F.col("text").rlike(r"\S")
    return out.filter(~emptied).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    bounded_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates."""
    bounded_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the SHA-256 of the decoded bytes, which are the text's."""
    bounded_batches(spark)
    ranks = bpe.load_ranks(RANKS)
    done = bpe.encode_with_digests(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)
    return done.select("doc_id", "ids", "n_tokens", "decoded_sha256")


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("byte-level BPE", encoding_stage)]

#: Trees, edit distances and byte pairs are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
