"""Duplicate groups by category, pair categories and the axes of the pair matrix.

All in long form: one row per member with its slot; `wide` spreads slots to columns for export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.functions.text import blank, natural_number
from kindred.plans.numbering import group_numbers, row_numbers
from kindred.plans.sizes import broadcast_if_small
from kindred.schema import KEYS, require_unique

#: Datasets with their weight that are broadcast; more are joined by shuffle.
BROADCAST_DATASETS = 100_000
#: Members that a tile of a group's pairs has on each side, at most about, and partitions of tiles for each core.
TILE, TILES = 1024, 8
EXACT_CATEGORIES = ("within_sessions", "within_subjects", "within_datasets", "across_datasets")


def base_rows(duplicates: DataFrame, modality: str | None = None) -> DataFrame:
    """Group members with null keys as "", without repeated rows; modality: only that one."""
    rows = duplicates if modality is None else duplicates.where(F.col("modality") == modality)
    return rows.select("group_id", *[blank(c).alias(c) for c in KEYS]).distinct()


def _slots(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return group_numbers(rows, group, order, "slot")


def within_sessions(rows: DataFrame) -> DataFrame:
    """Groups of two or more rows in exactly one (dataset, subject, session) with a subject."""
    good = rows.groupBy("group_id").agg(
        F.count("*").alias("n"), F.min(F.struct("dataset", "subject_id", "session_id")).alias("lo"), F.max(F.struct("dataset", "subject_id", "session_id")).alias("hi")
    ).where("n >= 2 and lo = hi and lo.subject_id <> '' and lo.dataset <> ''").select("group_id")
    return _slots(rows.join(good, "group_id", "left_semi"), ["group_id"], ["resolved_path", "candidate"])


def within_subjects(rows: DataFrame) -> DataFrame:
    """Per group, dataset and subject with two or more sessions: the first row of each session."""
    named = rows.where("dataset <> '' and subject_id <> '' and session_id <> ''")
    one = named.groupBy("group_id", "dataset", "subject_id", "session_id").agg(F.min(F.struct("resolved_path", "candidate")).alias("r"))
    good = one.groupBy("group_id", "dataset", "subject_id").agg(F.count("*").alias("n")).where("n >= 2")
    out = one.join(good, ["group_id", "dataset", "subject_id"], "left_semi").select("group_id", "dataset", "subject_id", "session_id", "r.candidate", "r.resolved_path")
    return _slots(out, ["group_id", "dataset", "subject_id"], ["session_id"])


def within_datasets(rows: DataFrame) -> DataFrame:
    """Per group and dataset with two or more subjects: all rows."""
    good = rows.where("dataset <> ''").groupBy("group_id", "dataset").agg(F.min(F.when(F.col("subject_id") != "", F.col("subject_id"))).alias("lo"), F.max("subject_id").alias("hi")).where("lo <> hi")
    out = rows.join(good, ["group_id", "dataset"], "left_semi")
    return _slots(out, ["group_id", "dataset"], ["subject_id", "session_id", "candidate", "resolved_path"])


def across_datasets(rows: DataFrame) -> DataFrame:
    """Groups in two or more datasets: all rows that have a dataset."""
    named = rows.where("dataset <> ''")
    good = named.groupBy("group_id").agg(F.min("dataset").alias("lo"), F.max("dataset").alias("hi")).where("lo <> hi")
    return _slots(named.join(good, "group_id", "left_semi"), ["group_id"], ["dataset", "subject_id", "session_id", "candidate", "resolved_path"])


CATEGORY = {"within_sessions": within_sessions, "within_subjects": within_subjects, "within_datasets": within_datasets, "across_datasets": across_datasets}


def by_dataset(rows: DataFrame) -> DataFrame:
    """Rows of groups with two or more rows in their dataset."""
    good = rows.where("dataset <> ''").groupBy("group_id", "dataset").count().where("count >= 2")
    return rows.join(good, ["group_id", "dataset"], "left_semi")


def dataset_stats(detail: DataFrame) -> DataFrame:
    """Distinct images of each dataset in a category report."""
    return detail.where("dataset <> ''").groupBy("dataset").agg(F.count_distinct("resolved_path").alias("n_images"))


def dataset_sets(rows: DataFrame) -> DataFrame:
    """group_id and set_key, the sorted names of its datasets; only sets of two or more."""
    sets = rows.where("dataset <> ''").select("group_id", "dataset").distinct().groupBy("group_id").agg(F.sort_array(F.collect_list("dataset")).alias("s"))
    return sets.where("size(s) >= 2").select("group_id", F.concat_ws("|", "s").alias("set_key"))


def across_set_stats(rows: DataFrame) -> DataFrame:
    """Distinct images of each set of datasets."""
    return rows.where("dataset <> ''").join(dataset_sets(rows), "group_id").groupBy("set_key").agg(F.count_distinct("resolved_path").alias("n_images"))


# -- near groups: group_id, dataset, subject_id, subject_key ---------------------------------


def near_by_dataset(groups: DataFrame) -> DataFrame:
    """Members of groups with two or more subjects in their dataset."""
    good = groups.where("dataset <> '' and subject_id <> ''").groupBy("group_id", "dataset").agg(F.min("subject_id").alias("lo"), F.max("subject_id").alias("hi")).where("lo <> hi")
    return groups.join(good, ["group_id", "dataset"], "left_semi").select("group_id", "dataset", "subject_id").distinct()


def near_within_datasets(groups: DataFrame) -> DataFrame:
    return _slots(near_by_dataset(groups), ["group_id", "dataset"], ["subject_id"])


def near_across_datasets(groups: DataFrame) -> DataFrame:
    """Members of groups in two or more datasets."""
    rows = groups.where("dataset <> '' and subject_id <> ''").select("group_id", "dataset", "subject_id").distinct()
    good = rows.groupBy("group_id").agg(F.min("dataset").alias("lo"), F.max("dataset").alias("hi")).where("lo <> hi")
    return _slots(rows.join(good, "group_id", "left_semi"), ["group_id"], ["dataset", "subject_id"])


def near_dataset_stats(detail: DataFrame) -> DataFrame:
    return detail.where("dataset <> '' and subject_id <> ''").groupBy("dataset").agg(F.count_distinct("subject_id").alias("n_subjects"))


def near_set_stats(groups: DataFrame) -> DataFrame:
    """Rows (not subjects) of each set of datasets, after dropping repeated rows."""
    rows = groups.where("dataset <> '' and subject_id <> ''").select("group_id", "dataset", "subject_id").distinct()
    return rows.join(dataset_sets(rows), "group_id").groupBy("set_key").agg(F.count("*").alias("n_rows"))


# -- pair matrix ------------------------------------------------------------------------------


def exact_axis(rows: DataFrame) -> DataFrame:
    """Files of duplicate groups with their axis position 0..n-1.

    Datasets come by their number of duplicate files (summed over groups) and name, subjects
    and sessions by the number in their name, then by name; then candidate and path.
    """
    weight = rows.groupBy("dataset", "group_id").agg(F.count_distinct("candidate").alias("c")).groupBy("dataset").agg(F.sum("c").alias("weight"))
    files = rows.select(*KEYS).distinct().join(broadcast_if_small(weight, BROADCAST_DATASETS), "dataset")
    order = ["weight", F.lower("dataset"), "dataset", natural_number("subject_id"), "subject_id", natural_number("session_id"), "session_id", "candidate", "resolved_path"]
    return row_numbers(files, order, "idx").withColumn("idx", F.col("idx") - 1).select("idx", *KEYS)


def near_axis(groups: DataFrame) -> DataFrame:
    """Subjects of near groups with their axis position 0..n-1."""
    weight = groups.groupBy("dataset").agg(F.count_distinct("subject_key").alias("weight"))
    subjects = groups.select("dataset", "subject_id", "subject_key").distinct().join(broadcast_if_small(weight, BROADCAST_DATASETS), "dataset")
    order = ["weight", F.lower("dataset"), "dataset", natural_number("subject_id"), "subject_id"]
    return row_numbers(subjects, order, "idx").withColumn("idx", F.col("idx") - 1).select("idx", "dataset", "subject_id", "subject_key")


def axis_blocks(axis: DataFrame, by: str) -> DataFrame:
    """Runs of one value along the axis: start, end (inclusive) and value.

    The axis is sorted by dataset, subject and session, so a run is everything of one value
    within the columns that come before it: one group-by, no window over the whole axis.
    """
    outer = {"dataset": [], "subject_id": ["dataset"], "session_id": ["dataset", "subject_id"]}[by]
    return axis.groupBy(*outer, by).agg(F.min("idx").alias("start"), F.max("idx").alias("end")).select("start", "end", F.col(by).alias("value"))


def exact_pair_category(a: str = "a", b: str = "b") -> F.Column:
    """Category of two members; a missing session counts as the same session."""
    c = lambda s, n: F.col(f"{s}.{n}")
    missing = (c(a, "session_id") == "") | (c(b, "session_id") == "")
    return (
        F.when(c(a, "dataset") != c(b, "dataset"), "across_datasets").when(c(a, "subject_id") != c(b, "subject_id"), "across_subjects")
        .when(missing | (c(a, "session_id") == c(b, "session_id")), "within_session").otherwise("across_sessions")
    )


def _places() -> tuple[F.Column, F.Column]:
    return F.least("a.idx", "b.idx").alias("x"), F.greatest("a.idx", "b.idx").alias("y")


def _paired(placed: DataFrame, *columns: str) -> DataFrame:
    """Every unordered pair of members of a group once, as group_id and structs a and b of idx and columns.

    Members of a large group are dealt to runs of about TILE; two runs, or one with itself, are a
    tile, and tiles are dealt to all tasks: neither a group nor its pairs come to one task.
    """
    large = placed.groupBy("group_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("runs")).where("runs > 1").withColumnRenamed("group_id", "of")
    run = F.coalesce(F.pmod(F.xxhash64("idx"), F.col("runs")).cast("int"), F.lit(0))
    dealt = placed.join(broadcast_if_small(large, BROADCAST_DATASETS), F.col("group_id") == F.col("of"), "left").select("group_id", run.alias("run"), F.struct("idx", *columns).alias("m"))
    runs = dealt.groupBy("group_id", "run").agg(F.collect_list("m").alias("m"))
    side = lambda s: runs.select("group_id", F.col("run").alias(f"r{s}"), F.col("m").alias(f"m{s}"))
    tiles = side("a").join(side("b"), "group_id").where("ra <= rb")
    tiles = tiles.repartition(TILES * placed.sparkSession.sparkContext.defaultParallelism, "group_id", "ra", "rb")
    one = tiles.select("group_id", "ra", "rb", "mb", F.explode("ma").alias("a"))
    return one.select("group_id", "ra", "rb", "a", F.explode("mb").alias("b")).where("ra < rb or a.idx < b.idx").select("group_id", "a", "b")


def pair_points(rows: DataFrame, axis: DataFrame) -> DataFrame:
    """Every unordered pair of members of a group: group_id, category, x and y (smaller first).

    This is the matrix itself, so its rows grow with the square of a group; counts alone come
    from pair_category_counts, which makes no pairs.
    """
    placed = rows.join(require_unique(axis.select("idx", "resolved_path"), "resolved_path"), "resolved_path")
    return _paired(placed, *KEYS[:3]).select("group_id", exact_pair_category().alias("category"), *_places())


def near_pair_points(groups: DataFrame, axis: DataFrame) -> DataFrame:
    """Every unordered pair of subjects of a group: within_dataset or across_datasets."""
    placed = groups.select("group_id", "subject_key").distinct().join(require_unique(axis.select("idx", "subject_key", "dataset"), "subject_key"), "subject_key")
    category = F.when(F.col("a.dataset") == F.col("b.dataset"), "within_dataset").otherwise("across_datasets")
    return _paired(placed, "dataset").select("group_id", category.alias("category"), *_places())


def pair_category_counts(rows: DataFrame) -> DataFrame:
    """Pairs of each category, from the counts of a group's members at each level."""
    half = lambda n: F.col(n) * (F.col(n) - 1) / 2
    session = rows.groupBy("group_id", "dataset", "subject_id", "session_id").agg(F.count("*").alias("n"))
    subject = session.groupBy("group_id", "dataset", "subject_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("session_id") == "", F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(F.col("session_id") != "", half("n")).otherwise(0.0)).alias("same")
    )
    within = F.col("same") + F.col("m") * (F.col("n") - F.col("m")) + F.col("m") * (F.col("m") - 1) / 2
    subject = subject.withColumn("within_session", within).withColumn("across_sessions", half("n") - within)
    dataset = subject.groupBy("group_id", "dataset").agg(F.sum("n").alias("n"), F.sum("within_session").alias("within_session"), F.sum("across_sessions").alias("across_sessions"), F.sum(half("n")).alias("inner"))
    dataset = dataset.withColumn("across_subjects", half("n") - F.col("inner"))
    group = dataset.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum(half("n")).alias("inner"), *[F.sum(c).alias(c) for c in ("within_session", "across_sessions", "across_subjects")])
    group = group.withColumn("across_datasets", half("n") - F.col("inner"))
    names = ("within_session", "across_sessions", "across_subjects", "across_datasets")
    totals = group.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return totals.unpivot([], list(names), "category", "n_pairs")


def pair_tiles(rows: DataFrame, axis: DataFrame, tiles: int = 64, levels: int = 4) -> DataFrame:
    """level, x, y, category and n_pairs: the pair matrix as counts of tiles, x <= y, at several resolutions.

    Level 0 has at most `tiles` tiles a side, each further level half as many. Counts come from
    a group's members in each tile at each depth (group, dataset, subject, session), never from
    pairs: a group takes at most tiles * tiles rows, however large it is. Each level sums to
    pair_category_counts.
    """
    placed = rows.join(require_unique(axis.select("idx", "resolved_path"), "resolved_path"), "resolved_path")
    n = axis.agg(F.max("idx")).first()[0]
    size = max(1, -(-(0 if n is None else n + 1) // tiles))
    named = F.col("session_id") != ""
    depth = lambda kind, *key: F.struct(F.lit(kind).alias("kind"), F.to_json(F.array(*key)).alias("key"))
    keys = F.array(
        depth("group", "group_id"), depth("dataset", "group_id", "dataset"), depth("subject", "group_id", "dataset", "subject_id"),
        F.when(named, depth("named", "group_id", "dataset", "subject_id")), F.when(named, depth("session", "group_id", "dataset", "subject_id", "session_id")),
    )
    tile = F.expr(f"idx div {size}").cast("long")
    members = placed.select(tile.alias("tile"), F.explode(keys).alias("k")).where("k is not null").groupBy("k.kind", "k.key", "tile").agg(F.count("*").alias("c"))
    one, two = members.select("kind", "key", F.col("tile").alias("x"), F.col("c").alias("cx")), members.select("kind", "key", F.col("tile").alias("y"), F.col("c").alias("cy"))
    n_pairs = F.when(F.col("x") == F.col("y"), F.expr("cx * (cx - 1) div 2")).otherwise(F.col("cx") * F.col("cy"))
    base = one.join(two, ["kind", "key"]).where("x <= y").groupBy("x", "y", "kind").agg(F.sum(n_pairs).alias("n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    flat = base.select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "x", "y", "kind", "n")
    up = lambda c: F.expr(f"{c} div cast(pow(2, level) as bigint)").alias(c)
    told = flat.select("level", up("x"), up("y"), "kind", "n").groupBy("level", "x", "y").agg(
        (of("group") - of("dataset")).alias("across_datasets"), (of("dataset") - of("subject")).alias("across_subjects"), (of("named") - of("session")).alias("across_sessions"), (of("subject") - of("named") + of("session")).alias("within_session")
    )
    return told.unpivot(["level", "x", "y"], ["within_session", "across_sessions", "across_subjects", "across_datasets"], "category", "n_pairs").where("n_pairs > 0")


def wide(detail: DataFrame, group: list[str], columns: list[str], prefix: str = "duplicate", slots: int | None = None) -> DataFrame:
    """Slots as columns <prefix>_<i>_<column>; missing ones are "".

    slots: their number; by default the largest found, which takes one aggregate.
    """
    n = slots if slots is not None else (detail.agg(F.max("slot")).first()[0] or 0)
    packed = detail.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("slot", *columns))).alias("s"))
    at = lambda i, c: F.coalesce(F.get("s", F.lit(i))[c].cast("string"), F.lit("")).alias(f"{prefix}_{i + 1}_{c}")
    return packed.select(*group, *[at(i, c) for i in range(n) for c in columns])
