"""Neighbours folded to undirected pairs, review lists and their wide export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.text import path_key, subject_key
from kindred.schema import KEYS

META = (*KEYS, "scan_uid")
SLOT_FIELDS = ("dataset", "subject_id", "session_id", "scan_uid", "src_path", "similarity")
_QUERY = [f"query_{c}" for c in (*KEYS[:3], "scan_uid", "src_path")]


def scan_pairs(neighbours: DataFrame, min_similarity: float) -> DataFrame:
    """Undirected pairs of different subjects at or above a similarity.

    neighbours: query_* and cand_* of META, rank, similarity. The smaller uid is side a. A pair
    has the largest similarity, the best rank and the number of its rows (2: found both ways).
    """
    rows = neighbours.where((F.col("similarity") >= min_similarity) & (F.col("query_scan_uid") != F.col("cand_scan_uid")))
    rows = rows.where(subject_key("query_dataset", "query_subject_id") != subject_key("cand_dataset", "cand_subject_id"))
    q = F.struct(*[F.col(f"query_{c}").alias(c) for c in META])
    c = F.struct(*[F.col(f"cand_{c}").alias(c) for c in META])
    swap = F.col("query_scan_uid") > F.col("cand_scan_uid")
    sides = rows.select(F.when(swap, c).otherwise(q).alias("a"), F.when(swap, q).otherwise(c).alias("b"), "rank", "similarity")
    best = sides.groupBy(F.col("a.scan_uid").alias("ua"), F.col("b.scan_uid").alias("ub")).agg(
        F.max("similarity").alias("similarity"), F.min("rank").alias("best_rank"), F.count("*").alias("n_directions"),
        F.max_by(F.struct("a", "b"), F.struct("similarity", (-F.col("rank")).alias("r"))).alias("m"),
    )
    return best.select(*[F.col(f"m.a.{x}").alias(f"{x}_a") for x in META], *[F.col(f"m.b.{x}").alias(f"{x}_b") for x in META], "similarity", "best_rank", "n_directions")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair: query_* and cand_* of META with similarity."""
    one = lambda s, t: pairs.select(*[F.col(f"{c}_{s}").alias(f"query_{c}") for c in META], *[F.col(f"{c}_{t}").alias(f"cand_{c}") for c in META], "similarity")
    return one("a", "b").unionByName(one("b", "a"))


def review_list(pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """Candidates of each query with their slot, most similar first; cap: at most so many."""
    order = Window.partitionBy("query_scan_uid").orderBy(F.desc("similarity"), "cand_dataset", "cand_subject_id", "cand_session_id", "cand_scan_uid")
    out = mirrored(pairs).withColumn("slot", F.row_number().over(order).cast("long"))
    return out if cap is None else out.where(F.col("slot") <= cap)


def _packed(listed: DataFrame) -> DataFrame:
    """One row per query with its candidates as an array s, in the order of their slots."""
    fields = F.struct("slot", *[F.col(f"cand_{c}").alias(c) for c in KEYS[:3]], F.col("cand_scan_uid").alias("scan_uid"), F.col("cand_resolved_path").alias("src_path"), F.col("similarity").cast("string").alias("similarity"))
    return listed.groupBy(*[f"query_{c}" for c in (*KEYS[:3], "scan_uid")], F.col("query_resolved_path").alias("query_src_path")).agg(F.sort_array(F.collect_list(fields)).alias("s"))


def review_wide(listed: DataFrame, slots: int | None = None) -> DataFrame:
    """One row per query with candidate_<i>_* columns; slots: their number, else the largest found."""
    n = slots if slots is not None else (listed.agg(F.max("slot")).first()[0] or 0)
    packed = _packed(listed)
    at = lambda i, c: F.coalesce(F.get("s", F.lit(i))[c], F.lit("")).alias(f"candidate_{i + 1}_{c}")
    return packed.select(*_QUERY, F.size("s").cast("long").alias("n_candidates"), *[at(i, c) for i in range(n) for c in SLOT_FIELDS])


def candidate_slots(columns: list[str]) -> list[int]:
    """Numbers of the candidate_<i>_* columns of a wide table."""
    import re

    return sorted({int(m[1]) for c in columns if (m := re.match(r"candidate_(\d+)_", c))})


def review_long(wide: DataFrame) -> DataFrame:
    """A wide review table as one row per filled slot."""
    items = [
        F.struct(F.lit(i).cast("long").alias("slot"), *[(F.col(f"candidate_{i}_{f}") if f"candidate_{i}_{f}" in wide.columns else F.lit("")).cast("string").alias(f) for f in SLOT_FIELDS])
        for i in candidate_slots(wide.columns)
    ]
    if not items:
        items = [F.struct(F.lit(0).cast("long").alias("slot"), *[F.lit("").alias(f) for f in SLOT_FIELDS])]
    return _shown(wide.select(*_QUERY, F.explode(F.array(*items)).alias("s")))


def review_rows(listed: DataFrame) -> DataFrame:
    """What review_long makes of review_wide(listed), without a column for each slot: in a wide
    table one scan with many candidates widens every row."""
    rows = _packed(listed).select(*_QUERY, F.posexplode("s").alias("at", "c"))
    filled = [F.coalesce(F.col("c")[f], F.lit("")).alias(f) for f in SLOT_FIELDS]
    return _shown(rows.select(*_QUERY, F.struct((F.col("at") + 1).cast("long").alias("slot"), *filled).alias("s")))


def _shown(rows: DataFrame) -> DataFrame:
    """Rows of a query and a slot s that can be shown: neither side lacks a dataset, subject, uid or path."""
    out = rows.select(*_QUERY, *[F.col(f"s.{f}").alias(f if f == "slot" else f"cand_{f}") for f in ("slot", *SLOT_FIELDS)])
    return out.where(" and ".join(f"{s}_{c} <> ''" for s in ("query", "cand") for c in ("dataset", "subject_id", "scan_uid", "src_path"))).withColumn("cand_similarity", F.col("cand_similarity").try_cast("double"))


def undirected(long: DataFrame) -> DataFrame:
    """Of each pair of paths in a review list one row: the most similar, then the one whose query
    comes first by path, then the earliest query and slot."""
    q, c = path_key("query_src_path"), path_key("cand_src_path")
    order = Window.partitionBy("p1", "p2").orderBy(F.desc_nulls_last("cand_similarity"), F.desc("canonical"), "query_scan_uid", "slot")
    rows = long.withColumn("p1", F.least(q, c)).withColumn("p2", F.greatest(q, c)).withColumn("canonical", q <= c)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1 and p1 <> p2").drop("_r", "canonical")


def scan_requests(long: DataFrame) -> DataFrame:
    """Distinct scans of a review list; ValueError if one uid has two paths or keys."""
    side = lambda s: long.select(*[F.col(f"{s}_{c}").alias(c) for c in ("scan_uid", "dataset", "subject_id", "session_id", "src_path")])
    out = side("query").unionByName(side("cand")).distinct()
    twice = out.groupBy("scan_uid").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"scan {twice[0].scan_uid} has differing data")
    return out


def request_mismatches(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested scans that the manifest lacks or knows with other data: scan_uid and problem.

    requests: scan_uid, dataset, subject_id, session_id, src_path; manifest: KEYS and scan_uid.
    A request without path agrees with any.
    """
    known = manifest.select("scan_uid", *[F.col(c).alias(f"known_{c}") for c in ("dataset", "subject_id", "session_id", "resolved_path")])
    both = requests.join(known, "scan_uid", "left")
    other = lambda c, k: ~F.col(c).eqNullSafe(F.col(f"known_{k}"))
    problem = F.when(F.col("known_resolved_path").isNull(), "not in manifest")
    for c in ("dataset", "subject_id", "session_id"):
        problem = problem.when(other(c, c), f"{c} differs")
    problem = problem.when((F.coalesce("src_path", F.lit("")) != "") & other("src_path", "resolved_path"), "src_path differs")
    return both.select("scan_uid", problem.alias("problem")).where("problem is not null")


def checked_requests(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """requests with the manifest's resolved_path; ValueError naming some scans that don't agree."""
    odd = request_mismatches(requests, manifest).orderBy("scan_uid").limit(10).collect()
    if odd:
        raise ValueError("requests and manifest differ: " + ", ".join(f"{r.scan_uid} {r.problem}" for r in odd))
    return requests.join(manifest.select("scan_uid", "resolved_path").dropDuplicates(["scan_uid"]), "scan_uid")


def pair_requests(long: DataFrame) -> DataFrame:
    """Distinct pairs of scans of a review list: scan_uid_a < scan_uid_b and pair_key.

    ValueError if a candidate has no uid.
    """
    if not long.where("query_scan_uid <> '' and coalesce(cand_scan_uid, '') = ''").isEmpty():
        raise ValueError("a candidate has no scan_uid")
    rows = long.where("query_scan_uid <> ''").select(F.least("query_scan_uid", "cand_scan_uid").alias("scan_uid_a"), F.greatest("query_scan_uid", "cand_scan_uid").alias("scan_uid_b")).distinct()
    return rows.withColumn("pair_key", F.concat_ws("__", "scan_uid_a", "scan_uid_b"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: total, pending and skipped (existing) assets of an asset_plan."""
    return plan.agg(F.count("*").alias("total"), F.count_if("pending").alias("pending"), F.count_if(~F.col("pending")).alias("skipped"))


def asset_plan(requests: DataFrame, existing: DataFrame, key: str = "scan_uid") -> DataFrame:
    """Requests with pending = true where no asset exists yet."""
    return requests.join(existing.select(key).distinct().withColumn("_e", F.lit(True)), key, "left").withColumn("pending", F.col("_e").isNull()).drop("_e")
