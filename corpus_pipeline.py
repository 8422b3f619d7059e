"""The corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; every stage but the last returns the columns
of documents. run() writes each stage's result to the shared folder and reads it again for the next.

Null and empty texts fail the base limits of the first stage and go. Called alone, a later stage takes a null text for an empty one. Null
doc_ids stay. Rows that share doc_id and text go through the first two stages alike, and near_dedup keeps one of them; of copies it keeps
that of the least doc_id. An empty table gives no rows.
Columns that documents does not have go along up to the last stage, whatever their names.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, pu_classifier, quality_rules, simhash, substring
from quarry.llm.shared import Scratch, table

_SPENT = threading.local()


def _stage(work):
    """A stage that owns a scratch space. The space lasts until this thread calls a stage on documents that no longer read it, so
    a result has to be written, or handed on to the next stage, before a stage is called on anything else."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spaces = getattr(_SPENT, "spaces", [])
        files = docs.inputFiles() if spaces else []
        held = [s for s in spaces if any(s.name in f for f in files)]
        for space in spaces:
            if space not in held:
                space.clear()
        scratch = Scratch(spark, work.__name__)
        _SPENT.spaces = [*held, scratch]
        return work(spark, docs, sf_dir, scratch)

    return stage


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents that the weighted rules keep."""
    return quality_rules.keep_good(docs, scratch=scratch)


@_stage
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts good."""
    return pu_classifier.keep_good(docs, table(spark, sf_dir, "labels"), scratch=scratch)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, scratch=scratch)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """All documents, without the words of windows that occur earlier; n_chars follows the text. Untouched texts stay as they are."""
    left = substring.remove_repeats(docs, carry=docs.columns, scratch=scratch)
    names = docs.columns
    left = left.toDF(*[f"d{i}" for i in range(len(names))], "n_words", "n_removed", "kept_sha256", "kept_text")
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[(F.when(cut, changed[n]).otherwise(F.col(f"d{i}")) if n in changed else F.col(f"d{i}")).alias(n) for i, n in enumerate(names)])


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Every piece of every document left, with its place in a training sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_dedup), ("substring_dedup", passages), ("best_fit_packing", pack)]

#: Expectation-maximisation, training and packing are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir))
        if scratch.holds(docs):
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
