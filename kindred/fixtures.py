"""The test tables in the shapes of the audit: scans from documents, vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import exact, pairs, vectors
from kindred.plans.stored import stored

MODALITY = "T1w"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(docs: DataFrame) -> DataFrame:
    named = docs.select(
        "doc_id", "text", F.concat(F.lit("ds"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")).alias("dataset"), F.concat(F.lit("sub-"), "lang", (F.col("doc_id") % 2).cast("string")).alias("subject_id"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("ses-"), (F.expr("doc_id div 2") % 2).cast("string"))).alias("session_id"),
    )
    folder = F.concat_ws("/", F.lit("/data"), "dataset", "subject_id", F.when(F.col("session_id") != "", F.col("session_id")), F.lit("anat"))
    return named.withColumn("candidate", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("_T1w.nii.gz")))


_kept: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that a session computes and stores once per folder, as the stages do."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = stored(build(), name)
    return _kept[key]


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per document with raw and canonical hash and size."""
    return _once(spark, sf_dir, "scans", lambda: _scans(spark, sf_dir))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "dataset", "subject_id", "session_id", "candidate", F.col("candidate").alias("resolved_path"), exact.content_hash("text").alias("raw_hash"),
        exact.content_hash(exact.canonical_text("text")).alias("can_hash"), F.octet_length("text").cast("long").alias("n_bytes"),
    )


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates some of which lie in an excluded folder or aren't images."""
    rows = _keys(table(spark, sf_dir, "documents").withColumn("text", F.lit(None)))
    path = F.when(F.col("doc_id") % 17 == 0, F.replace("candidate", F.lit("/anat/"), F.lit("/Derivatives/anat/"))).otherwise(F.col("candidate"))
    return rows.select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.replace(path, F.lit(".nii.gz"), F.lit(".txt"))).otherwise(path).alias("candidate"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans(spark, sf_dir)
    return _once(spark, sf_dir, "duplicates", lambda: exact.duplicate_groups(s.select("resolved_path", "can_hash"), s, MODALITY))


def vector_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("/v/"), F.col("vec_id").cast("string"))
    return v.select(
        "vec_id", F.concat(F.lit("ds"), (F.col("label") % 3).cast("string")).alias("dataset"), F.concat(F.lit("sub-"), F.lpad(F.expr("vec_id div 2").cast("string"), 4, "0")).alias("subject_id"), F.lit("").alias("session_id"),
        path.alias("candidate"), path.alias("resolved_path"), F.sha2(F.col("vec_id").cast("string"), 256).alias("scan_uid"), "embedding",
    )


def vectors_of(scans_: DataFrame) -> DataFrame:
    return scans_.select(F.col("scan_uid").alias("uid"), F.concat_ws("|", "dataset", "subject_id").alias("owner"), "embedding")


def neighbours(spark: SparkSession, sf_dir: str, topk: int = 10) -> DataFrame:
    """Neighbour rows with the keys of both sides; similarities rounded to 6 digits."""

    def build() -> DataFrame:
        v = vector_scans(spark, sf_dir)
        found = vectors.nearest(vectors_of(v), topk, "pre")
        side = lambda s: v.select(*[F.col(c).alias(f"{s}_{c}") for c in pairs.META])
        both = found.join(side("query"), F.col("query") == F.col("query_scan_uid")).join(side("cand"), F.col("cand") == F.col("cand_scan_uid"))
        return both.drop("query", "cand").withColumn("similarity", F.round("similarity", 6))

    return _once(spark, sf_dir, f"neighbours-{topk}", build)


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all pairs by similarity; some are made again later."""
    found = pairs.scan_pairs(neighbours(spark, sf_dir), -2.0)
    first = found.withColumn("qa_status", F.when(F.col("similarity") >= 0.40, "yes").when(F.col("similarity") >= 0.38, "maybe").otherwise("no")).withColumn("seq", F.lit(1).cast("long"))
    number = lambda s: F.expr(f"cast(substr(resolved_path_{s}, 4) as bigint)")
    again = first.where((number("a") + number("b")) % 7 == 0).withColumn("qa_status", F.when(F.col("qa_status") == "maybe", "yes").otherwise("no")).withColumn("seq", F.lit(2).cast("long"))
    sides = [F.col(f"{'resolved_path' if c == 'path' else c}_{s}").alias(f"{c}_{i}") for i, s in ((1, "a"), (2, "b")) for c in ("dataset", "subject_id", "session_id", "path")]
    return first.unionByName(again).select(*sides, "qa_status", F.lit("").alias("reason"), F.lit("2024-01-01T00:00:00").alias("date"), "seq", "similarity")
