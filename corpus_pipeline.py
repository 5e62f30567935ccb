"""From raw documents to packed training sequences, in four stages that each work on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it to the shared folder and rereads it as the next one's
``docs``. All but the last return the columns of ``documents``, with whole rows kept or dropped:

- ``quality_classifier`` drops documents scored below 0.3 by a model fitted on ``labels`` (never on held-out ids).
- ``quality_rules`` drops documents that fail the base rules or a risk-controlled cutoff of their language.
- ``jaccard_join`` keeps the smallest id of each class of near duplicates (five-word shingles, similarity 0.75 or more).
- ``packing`` gives the pieces of 1024-token sequences.

Odd rows: an empty table stays empty in every stage. A null text counts as an empty one, which the classifier scores low and the rules reject. Rows
without an id pass the classifier and the rules as any other text, are not compared with others and stay. Rows that share an id are judged by
their own text in the first two stages and stay or go together in the third. A null language is a stratum of its own. All columns of
``docs`` are kept, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import classifier, jaccard, packing, quality_rules
from chunkloom.llm.common import table
from chunkloom.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.kept_documents(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = written(quality_rules.measured(docs), "quality-counts")
    return quality_rules.kept_documents(docs, quality_rules.choose_cutoffs(counts, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, jaccard.joined(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("jaccard_join", jaccard_join),
    ("packing", pack_documents),
]
#: None of the stages can be put in SQL (a fitted model, 64-bit hashes, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
