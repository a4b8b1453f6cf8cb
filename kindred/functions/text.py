"""Column functions on names, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value.
NULL_TOKENS = ("nan", "none", "null", "na", "n/a")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """Null as an empty string; nothing else changes."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def clean(c) -> Column:
    """Trimmed; null and the spellings of a missing value as an empty string."""
    t = F.trim(blank(c))
    return F.when(F.lower(t).isin(*NULL_TOKENS), "").otherwise(t)


def first_present(*columns) -> Column:
    """The first of several columns that is neither null nor empty, else ""."""
    return F.coalesce(*[F.when(clean(c) != "", clean(c)) for c in columns], F.lit(""))


def subject_key(dataset, subject) -> Column:
    return F.concat(F.trim(blank(dataset)), F.lit("|"), F.trim(blank(subject)))


def natural_number(c) -> Column:
    """The first run of digits as a number; 10^9 without one or where it doesn't fit a long."""
    return F.coalesce(F.regexp_extract(blank(c), "([0-9]+)", 1).try_cast("bigint"), F.lit(1_000_000_000).cast("bigint"))


def path_key(c) -> Column:
    """A path as item key: trimmed, with forward slashes."""
    return F.replace(F.trim(blank(c)), F.lit("\\"), F.lit("/"))


def path_parts(path) -> Column:
    """struct(dataset, subject_id, session_id) of a path.

    The first part that starts with sub- is the subject, the one before it the dataset, the
    next the session if it starts with ses-. Without a subject that has a parent all are "".
    """
    parts = F.filter(F.split(F.replace(blank(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    marks = F.transform(parts, lambda x: F.startswith(x, F.lit("sub-")))
    at = F.array_position(marks, True).cast("int")  # 1-based, 0 if there is none
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    ok = at > 1
    return F.struct(
        F.when(ok, part(at - 2)).otherwise("").alias("dataset"), F.when(ok, part(at - 1)).otherwise("").alias("subject_id"), F.when(ok & part(at).startswith("ses-"), part(at)).otherwise("").alias("session_id")
    )


# The entities that a file name can have.
ENTITIES = ("sub", "ses", "task", "acq", "ce", "rec", "run", "echo", "part", "chunk")


def path_entities(path) -> Column:
    """map of the entities (sub-01_ses-2_run-1 ...) of a file name; the last of a key counts."""
    name = F.element_at(F.split(blank(path), "/"), -1)
    pairs = F.filter(F.split(F.regexp_replace(name, r"(?i)[.]nii([.]gz)?$", ""), "_"), lambda x: x.rlike(f"^(?:{'|'.join(ENTITIES)})-.+$"))
    keyed = F.reverse(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "-", 1).alias("k"), F.regexp_extract(x, "^[a-z]+-(.+)$", 1).alias("v"))))
    keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(keyed, lambda x: x["k"] == k), F.lit(0))["v"]))
