"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, decontamination, near_duplicates, personal_data, toxicity
from kindred.llm.registry import TOXIC_SCORE, VOCABULARY, held_out, table
from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import drop, scratched, stored

#: Documents that score as much or more are rejected: those that op1 calls toxic.
REJECT_SCORE = TOXIC_SCORE
#: Ids to remove that are broadcast, at most; more are joined by shuffle.
BROADCAST_IDS = 500_000

#: No SQL: the scores of a fitted classifier decide about the first stage's rows.
ORACLE_SQL = None


#: Columns that stages add while they work.
GONE, SPANS = "id to remove", "spans to redact"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (column GONE); rows without id stay."""
    return docs.join(broadcast_if_small(ids, BROADCAST_IDS), F.col("doc_id") == F.col(f"`{GONE}`"), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT_SCORE."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.drop_toxic(docs, model, REJECT_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (5 words, similarity 0.8)."""
    found = near_duplicates.near_duplicate_components(docs, near_duplicates.NearDuplicates(shingle=5, percent=80))
    out = _without(docs, found.where("not kept").select(F.col("doc_id").alias(GONE)).distinct())
    twice = stored(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(GONE)), "repeated")
    if not twice.isEmpty():  # rows that are repeated as a whole
        out = _without(out, twice).unionByName(out.join(twice, F.col("doc_id") == F.col(f"`{GONE}`"), "left_semi").dropDuplicates())
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select(F.col("doc_id").alias(GONE)).distinct())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows."""
    found = stored(personal_data.candidate_spans(docs), "candidates")
    labelled = personal_data.label_spans(found, personal_data.fit_spans(found), out=SPANS)
    out = labelled.withColumn("text", F.when(F.col("text").isNotNull(), personal_data.redacted(spans=SPANS)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to."""
    found = bpe.bpe_round_trip(docs, VOCABULARY)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, beginning with the table documents; of each stage only the result stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = scratched(lambda stage=stage, docs=docs, name=name: stored(stage(spark, docs, sf_dir), name))()
        drop(docs)
        docs = after
    return docs
