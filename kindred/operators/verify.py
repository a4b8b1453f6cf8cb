"""Second opinion on duplicate groups: raw and canonical equality, pairwise categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.schema import KEYS

FLAGS = ("flag_orient_diff", "flag_scaling_or_dtype_diff", "flag_shape_or_space_zooms_diff", "flag_time_zooms_diff", "flag_affine_meta_diff", "flag_header_other_diff")
#: Largest difference of two entries of equal affines.
AFFINE_TOLERANCE = 1e-5
#: What makes a set of each category, whose members are compared.
SETS = {
    "within_sessions": ("group_id", "dataset", "subject_id", "session_id"), "within_subjects": ("group_id", "dataset", "subject_id"),
    "within_datasets": ("group_id", "dataset"), "across_datasets": ("group_id",),
}


def raw_reason(size_a: Column, hash_a: Column, size_b: Column, hash_b: Column, error_a: Column | None = None, error_b: Column | None = None) -> Column:
    """OK, DIFF_SIZE, DIFF_CONTENT, or what kept a file from being read: MISSING, PERMISSION, ERROR:Type."""
    known = [e for e in (error_a, error_b) if e is not None]
    failed = F.coalesce(*known, F.lit("MISSING")) if known else F.lit("MISSING")
    return F.when(hash_a.isNull() | hash_b.isNull(), failed).when(size_a != size_b, "DIFF_SIZE").when(hash_a != hash_b, "DIFF_CONTENT").otherwise("OK")


def header_reason(hash_a: Column, extensions_a: Column, hash_b: Column, extensions_b: Column) -> Column:
    """HDR_EQUAL, HDR_BINARY_DIFF, or HDR_EXTENSIONS_DIFF for equal blocks with other (code, size) of extensions."""
    return F.when(~hash_a.eqNullSafe(hash_b), "HDR_BINARY_DIFF").when(~extensions_a.eqNullSafe(extensions_b), "HDR_EXTENSIONS_DIFF").otherwise("HDR_EQUAL")


def pair_category(raw: Column, canonical: Column, header: Column, zipped: Column) -> Column:
    """Category of a pair from its raw reason and what is equal (null: could not be loaded).

    zipped: any of the two is gzipped.
    """
    return (
        F.when(raw == "OK", "SAME_BYTES").when(canonical.isNull(), "ERROR_LOADING")
        .when(canonical & ~header, "CAN_EQUAL_HEADER").when(canonical & zipped, "CAN_EQUAL_COMPRESSION_GZ").when(canonical, "CAN_EQUAL_OTHER")
        .when(raw == "DIFF_SIZE", "DIFF_SIZE_AND_CAN_MISMATCH").when(raw == "DIFF_CONTENT", "DIFF_BYTES_AND_CAN_MISMATCH").otherwise(F.concat(F.lit("RAW_"), raw, F.lit("_AND_CAN_MISMATCH")))
    )


def affine_differs(a: Column, b: Column) -> Column:
    """True if two affines (flat arrays) differ by more than the tolerance or in length."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= AFFINE_TOLERANCE + AFFINE_TOLERANCE * F.abs(y)), lambda v: F.coalesce(v, F.lit(False)))
    return F.coalesce((F.size(a) != F.size(b)) | ~near, a.isNull() != b.isNull())


def anchor_pairs(members: DataFrame, order: str = "resolved_path", group: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """Each group's first member with each of the others.

    members: the group's columns, resolved_path, n_bytes, raw_hash, can_hash and, as far as
    known, other facts of files. The columns of the anchor end in _i, the others' in _j. The
    anchor comes from one aggregate, so a large group costs one row per member.
    """
    columns = [c for c in members.columns if c not in group]
    anchors = members.groupBy(*group).agg(F.min_by(F.struct(*[F.col(c).alias(f"{c}_i") for c in columns]), order).alias("a")).select(*group, "a.*")
    others = members.select(*group, *[F.col(c).alias(f"{c}_j") for c in columns])
    return others.join(anchors, list(group)).where(F.col(f"{order}_j") != F.col(f"{order}_i"))


def compared(pairs: DataFrame) -> DataFrame:
    """Adds raw_equal, raw_reason, canonical_equal, canonical_reason, category and the six flags to anchor pairs.

    Canonical equality is that of value_hash where it is known (values and shape, one volume
    of a 4-D image like a 3-D one), else of can_hash. Flags are raised only for pairs of equal
    values; a column that is not there raises none.
    """
    have = set(pairs.columns)

    def both(c: str) -> tuple[Column, Column]:
        return tuple(F.col(f"{c}_{s}") if f"{c}_{s}" in have else F.lit(None) for s in ("i", "j"))

    def differs(c: str, part: str = "{}") -> Column:
        a, b = (F.expr(part.format(f"{c}_{s}")) if f"{c}_{s}" in have else F.lit(None) for s in ("i", "j"))
        return ~a.eqNullSafe(b)

    errors = both("raw_error") if "raw_error_i" in have else (None, None)
    reason = raw_reason(both("n_bytes")[0], both("raw_hash")[0], both("n_bytes")[1], both("raw_hash")[1], *errors)
    hashes = both("value_hash") if "value_hash_i" in have else both("can_hash")
    same = F.when(F.col("raw_reason") == "OK", True).otherwise(hashes[0] == hashes[1])
    header = header_reason(both("header_hash")[0], both("extensions")[0], both("header_hash")[1], both("extensions")[1])
    out = pairs.withColumn("raw_reason", reason).withColumn("raw_equal", F.col("raw_reason") == "OK").withColumn("canonical_equal", same).withColumn("header_reason", header)
    failed = F.coalesce(*both("error"), F.lit("not loaded")) if "error_i" in have else F.lit("not loaded")
    out = out.withColumn("canonical_reason", F.when(F.col("canonical_equal"), "OK").when(F.col("canonical_equal").isNull(), failed).otherwise("DATA_DIFFER"))
    zipped = F.col("resolved_path_i").endswith(".gz") | F.col("resolved_path_j").endswith(".gz")
    out = out.withColumn("category", pair_category(F.col("raw_reason"), F.col("canonical_equal"), F.col("header_reason") == "HDR_EQUAL", zipped))
    (qa, qb), (sa, sb) = both("qform"), both("sform")
    forms = (affine_differs(qa, qb) & qa.isNotNull() & qb.isNotNull()) | (affine_differs(sa, sb) & qa.isNull() & qb.isNull() & sa.isNotNull() & sb.isNotNull()) if {"qform_i", "sform_i"} <= have else F.lit(False)
    raised = {
        "flag_orient_diff": differs("axcodes_original") | differs("axcodes_canonical"), "flag_scaling_or_dtype_diff": differs("dtype") | differs("slope") | differs("inter"),
        "flag_shape_or_space_zooms_diff": differs("shape", "slice({}, 1, 3)") | differs("zooms", "slice({}, 1, 3)"), "flag_time_zooms_diff": differs("zooms", "slice({}, 4, 9)"),
        "flag_affine_meta_diff": differs("qform_code") | differs("sform_code") | F.coalesce(forms, F.lit(False)),
    }
    applies = F.coalesce(F.col("canonical_equal"), F.lit(False)) & ~F.col("raw_equal")
    for flag, found in raised.items():
        out = out.withColumn(flag, applies & found)
    other = (F.col("header_reason") != "HDR_EQUAL") & ~F.greatest(*raised)
    return out.withColumn(FLAGS[-1], applies & other)


def group_checks(members: DataFrame) -> DataFrame:
    """Per group: whether all files are equal byte by byte and in canonical form.

    null (unknown) for groups of one and where a hash is missing; otherwise a witness (the
    smallest path whose hash is not that of the first path) goes with false.
    """
    def same(h: str) -> Column:
        unknown = (F.count("*") < 2) | (F.count(h) < F.count("*"))
        return F.when(~unknown, F.min(h) == F.max(h))

    first = members.groupBy("group_id").agg(F.count("*").alias("n"), same("raw_hash").alias("byte_identical_all"), same("can_hash").alias("canonical_identical_all"), F.min_by("raw_hash", "resolved_path").alias("h"))
    odd = members.join(first.where("not byte_identical_all").select("group_id", "h"), "group_id").where("raw_hash <> h").groupBy("group_id").agg(F.min("resolved_path").alias("witness"))
    return first.drop("h").join(odd, "group_id", "left")


def row_flags(issues: DataFrame, group: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """Per group: each flag raised by any of its pairs, and the number of pairs that differ."""
    return issues.groupBy(*group).agg(F.count_if(~F.col("raw_equal")).alias("n_issues"), *[F.bool_or(f).alias(f) for f in FLAGS])


def verified(rows: DataFrame, facts: DataFrame, category: str, exclude: tuple[str, ...] = ("SAME_BYTES",)) -> tuple[DataFrame, DataFrame]:
    """The members of a category's sets with checks, and the pairs in which they differ.

    rows: the category's columns, slot and KEYS. facts: of operators.files, by resolved_path.
    Checks: mtime, ctime, byte_identical_all and canonical_identical_all (TRUE, FALSE or
    UNKNOWN where fewer than two files can be found) and the flags raised by any pair of the
    set. A pair is the first file found of a set, by slot, with each other one that has other
    bytes; pairs of an excluded category are left out. Files that can't be found are in no pair.
    """
    group = SETS[category]
    known = facts.drop(*[c for c in KEYS if c != "resolved_path"]).dropDuplicates(["resolved_path"])
    members = rows.select(*dict.fromkeys((*group, "slot", *KEYS))).join(known, "resolved_path", "left")
    keys = [c for c in KEYS if c not in group]
    there = members.where("n_bytes is not null")
    pairs = compared(anchor_pairs(there.select(*group, "slot", *keys, *[c for c in known.columns if c != "resolved_path"]), "slot", group))
    pairs = pairs.select(*group, *[c for c in pairs.columns if c not in group])
    sets = there.groupBy(*group).agg(F.count("*").alias("found"))
    checks = pairs.groupBy(*group).agg(F.bool_and("raw_equal").alias("raw"), F.bool_and(F.coalesce("canonical_equal", F.lit(False))).alias("can"), *[F.bool_or(f).alias(f) for f in FLAGS])
    state = lambda c: F.when(F.coalesce("found", F.lit(0)) < 2, "UNKNOWN").when(F.col(c), "TRUE").otherwise("FALSE")
    sets = sets.join(checks, list(group), "left").select(*group, state("raw").alias("byte_identical_all"), state("can").alias("canonical_identical_all"), *FLAGS)
    named = members.select(*dict.fromkeys((*group, "slot", *KEYS)), "mtime", "ctime").join(sets, list(group), "left")
    unknown = [F.coalesce(c, F.lit("UNKNOWN")).alias(c) for c in ("byte_identical_all", "canonical_identical_all")]
    with_checks = named.select(*[c for c in named.columns if c not in ("byte_identical_all", "canonical_identical_all", *FLAGS)], *unknown, *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])
    side = [(F.col(c) if c in group else F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s in ("i", "j") for c in KEYS]
    issues = pairs.where(~F.col("raw_equal") & ~F.col("category").isin(*exclude))
    return with_checks, issues.select("group_id", F.lit(category).alias("pair_kind"), *side, "category", "raw_equal", "raw_reason", "canonical_equal", "canonical_reason", *FLAGS)
