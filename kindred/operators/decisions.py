"""Review decisions as an append-only log: last write wins, pruning, lookups, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.text import clean, path_key, subject_key
from kindred.schema import require_columns

STATES = ("yes", "no", "maybe")
SIDES = ("dataset", "subject_id", "session_id")


def keyed(log: DataFrame) -> DataFrame:
    """Decisions with their two sides in the order of their path keys.

    log: *_1 and *_2 of SIDES and path, qa_status, reason, date, seq. Without seq (an exported
    file has none) the date orders the decisions on a pair. Rows without a path on both sides,
    with equal paths or with an unknown status are invalid; `invalid` lists them.
    """
    require_columns(log, [f"{c}_{s}" for s in (1, 2) for c in (*SIDES, "path")] + ["qa_status"])
    if "seq" not in log.columns:
        require_columns(log, ["date"])
        log = log.withColumn("seq", F.col("date"))
    p1, p2 = path_key("path_1"), path_key("path_2")
    keep = p1 <= p2
    sides = [F.when(keep, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{3 - s}")).alias(f"{c}_{s}") for s in (1, 2) for c in SIDES]
    rest = [c for c in log.columns if c not in {f"{x}_{s}" for s in (1, 2) for x in (*SIDES, "path")} | {"qa_status"}]
    return log.select(*sides, F.least(p1, p2).alias("path_1"), F.greatest(p1, p2).alias("path_2"), F.lower(clean("qa_status")).alias("qa_status"), *rest)


def _valid() -> F.Column:
    return (F.col("path_1") != "") & (F.col("path_1") != F.col("path_2")) & F.col("qa_status").isin(*STATES)


def invalid(log: DataFrame) -> DataFrame:
    """Rows that `latest` leaves out."""
    return keyed(log).where(~_valid())


def latest(log: DataFrame) -> DataFrame:
    """The last valid decision on each pair (largest seq), sorted keys path_1 < path_2."""
    order = Window.partitionBy("path_1", "path_2").orderBy(F.desc("seq"), "qa_status")
    return keyed(log).where(_valid()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def with_defaults(current: DataFrame, pairs: DataFrame, status: str = "no") -> DataFrame:
    """Adds a default decision for every pair (same columns) that has none."""
    new = pairs.dropDuplicates(["path_1", "path_2"]).join(current.select("path_1", "path_2"), ["path_1", "path_2"], "left_anti").withColumn("qa_status", F.lit(status))
    return current.unionByName(new, allowMissingColumns=True)


def pruned(current: DataFrame, paths: DataFrame) -> DataFrame:
    """Decisions whose two paths both still exist. paths: path."""
    known = paths.select(path_key("path").alias("p")).distinct()
    return current.join(known.withColumnRenamed("p", "path_1"), "path_1", "left_semi").join(known.withColumnRenamed("p", "path_2"), "path_2", "left_semi")


def looked_up(pairs: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs (path_1 <= path_2) with qa_status (undecided shows "no") and is_decided."""
    found = current.select("path_1", "path_2", F.col("qa_status").alias("_q"))
    return pairs.join(found, ["path_1", "path_2"], "left").select(*pairs.columns, F.coalesce("_q", F.lit("no")).alias("qa_status"), F.col("_q").isNotNull().alias("is_decided"))


def subject_progress(items: DataFrame) -> DataFrame:
    """Per dataset and subject: decided and all pairs, and whether all are decided.

    items: dataset, subject_id of the query side and is_decided.
    """
    return items.groupBy("dataset", "subject_id").agg(F.count_if("is_decided").alias("n_done"), F.count("*").alias("n_total")).withColumn("done", F.col("n_done") == F.col("n_total"))


def dataset_progress(subjects: DataFrame) -> DataFrame:
    """Per dataset: finished and all subjects."""
    return subjects.groupBy("dataset").agg(F.count_if("done").alias("n_subjects_done"), F.count("*").alias("n_subjects"))


def subject_navigation(subjects: DataFrame) -> DataFrame:
    """Previous and next subject within each dataset."""
    w = Window.partitionBy("dataset").orderBy("subject_id")
    return subjects.select("dataset", "subject_id").distinct().select("dataset", "subject_id", F.lag("subject_id").over(w).alias("prev_subject"), F.lead("subject_id").over(w).alias("next_subject"))


def exported(current: DataFrame) -> DataFrame:
    """Current decisions in the columns of an exported file; sort it by path_1 and path_2.

    ValueError if a decision lacks a path.
    """
    if not current.where("coalesce(path_1, '') = '' or coalesce(path_2, '') = ''").isEmpty():
        raise ValueError("a decision without a path can't be exported")
    blanks = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("reason", "date")]
    return current.select(*[f"{c}_{s}" for s in (1, 2) for c in (*SIDES, "path")], F.col("qa_status").alias("QA_status"), *blanks)


def dataset_payload(items: DataFrame) -> DataFrame:
    """Per dataset its finished and all subjects and the JSON of each with counts and neighbours.

    items: dataset, subject_id, query_scan_uid and is_decided of every candidate. A dataset's
    subjects are gathered in one row: that is what a page shows.
    """
    rows = items.groupBy("dataset", "subject_id").agg(F.count_if("is_decided").alias("done_pairs"), F.count("*").alias("total_pairs"), F.count_distinct("query_scan_uid").alias("query_count"))
    rows = rows.withColumn("is_done", F.col("done_pairs") == F.col("total_pairs")).join(subject_navigation(rows), ["dataset", "subject_id"])
    subject = F.struct("subject_id", "done_pairs", "total_pairs", "query_count", "is_done", "prev_subject", "next_subject")
    out = rows.groupBy("dataset").agg(F.count_if("is_done").alias("done_subjects"), F.count("*").alias("total_subjects"), F.sort_array(F.collect_list(subject)).alias("s"))
    return out.select("dataset", "done_subjects", "total_subjects", F.to_json("s").alias("subjects"))


def subject_payload(items: DataFrame) -> DataFrame:
    """Per dataset, subject and query the JSON of its candidates with their decisions."""
    entry = F.struct("slot", "cand_scan_uid", "cand_src_path", "cand_similarity", "qa_status", "is_decided")
    return items.groupBy("dataset", "subject_id", "query_scan_uid").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("candidates"))


def subject_edges(current: DataFrame) -> DataFrame:
    """Edges between different subjects with the number of their confirmed pairs.

    Only "yes" makes an edge; both sides need a dataset and a subject.
    """
    yes = current.where(F.lower(F.trim("qa_status")) == "yes").where(" and ".join(f"trim({c}_{s}) <> ''" for s in (1, 2) for c in ("dataset", "subject_id")))
    side = lambda s: F.struct(subject_key(f"dataset_{s}", f"subject_id_{s}").alias("subject_key"), F.trim(f"dataset_{s}").alias("dataset"), F.trim(f"subject_id_{s}").alias("subject_id"))
    rows = yes.select(F.least(side(1), side(2)).alias("a"), F.greatest(side(1), side(2)).alias("b")).where("a.subject_key <> b.subject_key")
    out = rows.groupBy("a", "b").agg(F.count("*").alias("n_yes_scan_pairs"))
    return out.select(*[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("dataset", "subject_id", "subject_key")], "n_yes_scan_pairs")


def subject_groups(edges: DataFrame) -> DataFrame:
    """Connected subjects: group_id (numbered by size, then smallest key), group_size and members."""
    from kindred.operators.graph import connected_components
    from kindred.plans.numbering import row_numbers
    from kindred.plans.stored import stored

    members = stored(connected_components(edges, "subject_key_a", "subject_key_b"), "components")
    sizes = members.groupBy("component").agg(F.count("*").alias("group_size")).where("group_size > 1")
    numbered = row_numbers(sizes, ["group_size", "component"], "n").withColumn("group_id", F.concat(F.lit("group_"), F.lpad(F.col("n").cast("string"), 6, "0")))
    parts = F.split("node", r"\|", 2)
    return members.join(numbered, "component").select("group_id", "group_size", F.get(parts, F.lit(0)).alias("dataset"), F.get(parts, F.lit(1)).alias("subject_id"), F.col("node").alias("subject_key"))
