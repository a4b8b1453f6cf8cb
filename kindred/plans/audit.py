"""Drivers: the exact stage, the near stage, review finalisation and the whole run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.operators import catalogs, decisions, embedding, exact, files, pairs, reports, vectors, verify
from kindred.plans import sinks
from kindred.plans.cache import cached
from kindred.plans.profile import Profiler
from kindred.plans.stored import drop, stored
from kindred.schema import KEYS
from kindred.sources import tables
from kindred.sources.config import AuditConfig, read_config


def run_exact(spark: SparkSession, cfg: AuditConfig, inspect: Callable[[bytes], dict] | None = None, profiler: Profiler | None = None) -> dict[str, DataFrame]:
    """Catalog, hashes (resumed), duplicate groups, reports and, if configured, verification under out_dir/exact.

    inspect: decodes a file's bytes (see operators.files), for instance nifti.inspect; without
    one the canonical hash is that of the bytes. Without valid candidates all tables are
    empty; nothing exits.
    """
    p, out = profiler or Profiler(), f"{cfg.out_dir}/exact"
    with p.stage("exact_load_verify") as stage:
        if cfg.valid_csv:
            catalog = tables.read_csv(spark, cfg.valid_csv, schema.VALID)
        else:
            found = tables.discover(spark, cfg.root, cfg.modality) if cfg.root else tables.read_candidates(spark, cfg.candidates_csv).select("candidate")
            status = catalogs.classified(catalogs.probe_paths(found))
            sinks.write_by_status(status, f"{out}/candidates")
            stage.n_input = spark.read.parquet(f"{out}/candidates").count()
            catalog = catalogs.valid_catalog(spark.read.parquet(f"{out}/candidates"))
        sinks.write_table(catalog, f"{out}/valid")
        catalog = spark.read.schema(schema.VALID).parquet(f"{out}/valid")
        stage.n_output = catalog.count()
    with p.stage("exact_hash_group", n_input=stage.n_output) as stage:
        hashes = f"{out}/hashes"
        done = spark.read.parquet(hashes) if tables.exists(spark, hashes) else None
        todo = catalog.select("resolved_path").distinct()
        if done is not None:
            todo = exact.not_yet_hashed(todo, done.where("error is null"))
        now = files.file_facts(todo, inspect).withColumn("read_at", F.lit(datetime.now(timezone.utc)))
        sinks.append_table(now, hashes)
        facts = current_facts(spark, out, catalog)
        ok, errors = facts.where("error is null and can_hash is not null"), facts.where("error is not null or can_hash is null").select("resolved_path", F.coalesce("error", F.lit("no hash")).alias("error"))
        sinks.write_table(exact.duplicate_groups(ok.select("resolved_path", "can_hash"), catalog, cfg.modality), f"{out}/duplicates")
        sinks.write_table(errors, f"{out}/hash_errors")
        duplicates = spark.read.schema(schema.DUPLICATES).parquet(f"{out}/duplicates")
        stage.n_output = duplicates.count()
    with p.stage("exact_categorize", n_input=stage.n_output):
        report_exact(duplicates, f"{out}/reports", cfg.modality)
        if cfg.verify:
            verify_categories(spark, out, current_facts(spark, out, catalog))
    return {"catalog": catalog, "duplicates": duplicates, "errors": spark.read.schema(schema.HASH_ERRORS).parquet(f"{out}/hash_errors")}


def current_facts(spark: SparkSession, out: str, catalog: DataFrame) -> DataFrame:
    """Of each path in the catalog the facts of its last read: one that failed once and was read later counts as read."""
    every = spark.read.option("mergeSchema", True).parquet(f"{out}/hashes")
    if "read_at" not in every.columns:  # written before reads had a time
        every = every.withColumn("read_at", F.lit(None).cast("timestamp"))
    every = every.join(catalog.select("resolved_path").distinct(), "resolved_path", "left_semi")
    columns = [c for c in every.columns if c != "resolved_path"]
    best = every.groupBy("resolved_path").agg(F.max_by(F.struct(*columns), F.struct(F.col("error").isNull().alias("read"), "read_at", F.col("mtime"), F.coalesce("raw_hash", F.lit("")))).alias("f"))
    return best.select("resolved_path", "f.*")


def verify_categories(spark: SparkSession, out: str, facts: DataFrame, exclude: tuple[str, ...] = ("SAME_BYTES",)) -> None:
    """For each category: members with checks, pairs that differ, and members of sets that aren't canonically equal."""
    for name in verify.SETS:
        checks, issues = verify.verified(spark.read.parquet(f"{out}/reports/{name}"), facts, name, exclude)
        sinks.write_table(checks, f"{out}/verified/{name}_with_checks")
        sinks.write_table(issues, f"{out}/verified/{name}_pairwise_issues")
        sinks.write_table(spark.read.parquet(f"{out}/verified/{name}_with_checks").where("canonical_identical_all = 'FALSE'"), f"{out}/verified/{name}_canonical_false")


def report_exact(duplicates: DataFrame, out: str, modality: str | None = None) -> None:
    """All category tables with their statistics, the axis with its blocks, and pair counts."""
    rows = reports.base_rows(duplicates, modality)
    for name, f in reports.CATEGORY.items():
        sinks.write_table(f(rows), f"{out}/{name}")
        sinks.write_table(reports.dataset_stats(duplicates.sparkSession.read.parquet(f"{out}/{name}")), f"{out}/{name}_stats")
    sinks.write_table(reports.across_set_stats(rows), f"{out}/across_datasets_set_stats")
    sinks.write_by_dataset(reports.by_dataset(rows), f"{out}/by_dataset")
    sinks.write_table(reports.exact_axis(rows), f"{out}/axis")
    axis = duplicates.sparkSession.read.parquet(f"{out}/axis")
    for by in ("dataset", "subject_id", "session_id"):
        sinks.write_table(reports.axis_blocks(axis, by), f"{out}/axis_blocks_{by}")
    sinks.write_table(reports.pair_category_counts(rows), f"{out}/pair_counts")


def run_near(spark: SparkSession, cfg: AuditConfig, embed: Callable[[DataFrame], DataFrame], profiler: Profiler | None = None) -> dict[str, DataFrame]:
    """Removal of exact copies, embeddings, neighbours, pairs and the review list under out_dir/near.

    embed: turns rows of NEAR_INPUT into scan_uid, embedding.
    """
    p, out, before = profiler or Profiler(), f"{cfg.out_dir}/near", f"{cfg.out_dir}/exact"
    with p.stage("near_remove_exact"):
        catalog = spark.read.schema(schema.VALID).parquet(f"{before}/valid")
        duplicates = spark.read.schema(schema.DUPLICATES).parquet(f"{before}/duplicates")
        errors = spark.read.schema(schema.HASH_ERRORS).parquet(f"{before}/hash_errors")
        sinks.write_table(exact.removed_all(duplicates, errors, catalog), f"{out}/removed")
        sinks.write_table(exact.near_input(catalog, spark.read.parquet(f"{out}/removed"), spark.read.parquet(f"{before}/hashes")), f"{out}/input")
    kept = spark.read.schema(schema.NEAR_INPUT).parquet(f"{out}/input")
    with p.stage("near_embedding"):
        sinks.write_table(kept.join(embed(kept), "scan_uid"), f"{out}/embeddings")
    with p.stage("near_neighbours"):
        held = spark.read.parquet(f"{out}/embeddings")
        v = held.select(F.col("scan_uid").alias("uid"), F.concat_ws("|", "dataset", "subject_id").alias("owner"), "embedding")
        search = lambda: vectors.nearest_by_lists(v, cfg.topk, cfg.nlist, cfg.nprobe, cfg.train_size, cfg.filter_mode) if cfg.use_ivf else vectors.nearest(v, cfg.topk, cfg.filter_mode)
        params = {k: getattr(cfg, k) for k in ("topk", "use_ivf", "nlist", "nprobe", "train_size", "filter_mode")}
        found = cached(search, f"{out}/neighbour_cache", v, params=params)
        side = lambda s: held.select(*[F.col(c).alias(f"{s}_{c}") for c in (*KEYS, "scan_uid")])
        sinks.write_table(found.join(side("query"), F.col("query") == F.col("query_scan_uid")).join(side("cand"), F.col("cand") == F.col("cand_scan_uid")).drop("query", "cand"), f"{out}/neighbours")
    with p.stage("near_pairs"):
        sinks.write_table(pairs.scan_pairs(spark.read.parquet(f"{out}/neighbours"), cfg.min_similarity), f"{out}/pairs")
        sinks.write_table(pairs.review_list(spark.read.parquet(f"{out}/pairs"), cfg.max_candidates), f"{out}/review")
        wide = pairs.review_wide(spark.read.parquet(f"{out}/review"))
        sinks.write_csv(wide, f"{out}/review_candidates.csv", ("query_dataset", "query_subject_id", "query_session_id", "query_scan_uid"))
        listed = pairs.review_rows(spark.read.parquet(f"{out}/review"))
        sinks.write_table(pairs.checked_requests(pairs.scan_requests(listed), kept), f"{out}/scan_requests")
        sinks.write_table(pairs.pair_requests(listed), f"{out}/pair_requests")
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("removed", "input", "neighbours", "pairs", "review")}


def run_embedding(spark: SparkSession, items: DataFrame, out: str, preprocess: Callable, encoder: Callable, profiler: Profiler | None = None, **options) -> DataFrame:
    """Embeds what has no embedding under `out` yet; returns the manifest with embeddings.

    Tables: `parts` (appended by each run; files that can't be read and rows that are of no
    use are ignored), `failures` (the newest failure of each scan that has not succeeded) and
    `manifest` (emb_row 0..n-1 by scan_uid). ValueError if a scan is neither embedded nor failed.
    options: those of embedding.encode.
    """
    length = options.get("length")
    store = lambda: spark.read.schema("scan_uid string, embedding array<float>, stage string, error string").option("ignoreCorruptFiles", True).parquet(f"{out}/parts")
    todo = embedding.pending(items, embedding.sound(store(), length)) if tables.exists(spark, f"{out}/parts") else items
    count = stored(todo.select("scan_uid", "resolved_path"), "pending")
    n = count.count()
    sinks.append_table(embedding.encode(count, preprocess, encoder, **options), f"{out}/parts")
    done = stored(embedding.sound(store(), length), "embedded")
    old = spark.read.parquet(f"{out}/failures") if tables.exists(spark, f"{out}/failures") else schema.empty(spark, schema.strings("scan_uid", "stage", "error"))
    new = store().where("stage is not null").select("scan_uid", "stage", "error").distinct()
    failures = stored(embedding.merge_failures(old, new, done), "failures")
    sinks.write_table(failures, f"{out}/failures")
    missing = items.join(done, "scan_uid", "left_anti").join(failures, "scan_uid", "left_anti").select("scan_uid").limit(5).collect()
    if missing:
        raise ValueError(f"neither embedded nor failed: {[r.scan_uid for r in missing]}")
    sinks.write_table(embedding.manifest(items, done), f"{out}/manifest")
    found = spark.read.parquet(f"{out}/manifest")
    if profiler:
        profiler.embedding_detail.append({"n_items": items.count(), "n_pending": n, "n_embedded": found.count(), "n_failed": failures.count()})
    drop(count, done, failures)
    return found


def finalise(spark: SparkSession, log: DataFrame, out: str) -> dict[str, DataFrame]:
    """Confirmed decisions to subject edges, groups and near reports under `out`.

    log: a decision log, or what tables.read_decisions reads of an exported file.
    """
    sinks.write_table(decisions.subject_edges(decisions.latest(log)), f"{out}/edges")
    sinks.write_table(decisions.subject_groups(spark.read.parquet(f"{out}/edges")), f"{out}/groups")
    groups = spark.read.parquet(f"{out}/groups")
    for name, f in {"by_dataset": reports.near_by_dataset, "within_datasets": reports.near_within_datasets, "across_datasets": reports.near_across_datasets, "set_stats": reports.near_set_stats, "axis": reports.near_axis}.items():
        sinks.write_table(f(groups), f"{out}/{name}")
    for name in ("by_dataset", "within_datasets", "across_datasets"):
        sinks.write_table(reports.near_dataset_stats(spark.read.parquet(f"{out}/{name}")), f"{out}/{name}_stats")
    sinks.write_table(reports.near_pair_points(groups, spark.read.parquet(f"{out}/axis")), f"{out}/pair_points")
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("edges", "groups")}


def run_pipeline(spark: SparkSession, config_path: str, embed: Callable[[DataFrame], DataFrame] | None = None, inspect: Callable[[bytes], dict] | None = None) -> Profiler:
    """The stages of a configuration; timings are saved in any case."""
    cfg, profiler = read_config(config_path), Profiler(spark=spark)
    sinks.copy_config(config_path, cfg.out_dir)
    try:
        with profiler.stage("total_pipeline"):
            if "exact" in cfg.stages:
                run_exact(spark, cfg, inspect, profiler)
            if "near" in cfg.stages:
                if embed is None:
                    raise ValueError("the near stage needs an encoder")
                run_near(spark, cfg, embed, profiler)
    finally:
        profiler.save(spark, cfg.out_dir)
    return profiler
