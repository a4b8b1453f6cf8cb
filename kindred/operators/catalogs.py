"""Classification of scan candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import path_entities, path_parts
from kindred.operators.exact import excluded_dir
from kindred.schema import KEYS

STATUSES = ("excluded_dir", "missing", "denied", "not_nifti", "unreadable", "ok")


def probe_paths(candidates: DataFrame, verify: Callable[[str], None] | None = None) -> DataFrame:
    """Adds target (the path with links resolved), found, allowed and readable.

    Looks at the file system of the executors, so it must be one they all mount. verify
    raises for unreadable files; without it every file that may be opened is readable.
    """

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            out = []
            for path in b.column(b.schema.get_field_index("candidate")).to_pylist():
                target = os.path.realpath(path or "")
                found, allowed, readable = os.path.exists(target), os.access(target, os.R_OK), True
                if verify and found and allowed:
                    try:
                        verify(target)
                    except Exception:  # noqa: BLE001 - the row is marked
                        readable = False
                out.append((target, found, allowed, readable))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*b.schema.names, "target", "found", "allowed", "readable"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.mapInArrow(run, f"{names}, target string, found boolean, allowed boolean, readable boolean")


def classified(candidates: DataFrame, exclude: tuple[str, ...] = ("derivatives",)) -> DataFrame:
    """Adds status, the first that holds of STATUSES, and resolved_path (null where missing).

    candidates: candidate and, if probed, target, found, allowed and readable; unprobed
    candidates count as readable files at their own path.
    """
    have = set(candidates.columns)
    target = F.col("target") if "target" in have else F.col("candidate")
    flag = lambda name: F.col(name) if name in have else F.lit(True)
    status = (
        F.when(excluded_dir("candidate", exclude), "excluded_dir").when(~flag("found"), "missing").when(~flag("allowed"), "denied")
        .when(~target.rlike(r"\.nii(\.gz)?$"), "not_nifti").when(~flag("readable"), "unreadable").otherwise("ok")
    )
    out = candidates.withColumn("status", status)
    return out.withColumn("resolved_path", F.when(F.col("status") != "missing", target))


def valid_catalog(classified_rows: DataFrame) -> DataFrame:
    """Keys of the rows with status ok; links to one file collapse to the smallest candidate."""
    ok = classified_rows.where("status = 'ok'").groupBy("resolved_path").agg(F.min("candidate").alias("candidate"))
    return ok.withColumn("p", path_parts("candidate")).select("p.*", "candidate", "resolved_path").select(*KEYS)


def _level(subject: str, root: str) -> F.Column:
    """Folder root/sub-x or root/sub-x/ses-y of a name with these entities; null without a subject."""
    e = path_entities(subject)
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.concat(F.lit("sub-"), F.try_element_at(e, F.lit("sub"))), F.concat(F.lit("ses-"), F.try_element_at(e, F.lit("ses"))))


def locate_images(subjects: DataFrame, files: DataFrame, root: str, modality: str = "T1w") -> DataFrame:
    """subject, path and status of each subject's image among files (column candidate).

    The image is <subject>_<modality>.nii.gz in the folder anat of its level, else the only
    *_<modality>.nii.gz there. status: ok, no_subject (no sub- entity), missing or several.
    """
    folder, name = F.regexp_replace("candidate", "/[^/]*$", ""), F.substring_index("candidate", "/", -1)
    found = files.select(folder.alias("folder"), name.alias("name"), "candidate").where(F.col("name").endswith(f"_{modality}.nii.gz")).distinct()
    asked = subjects.select("subject").distinct().withColumn("level", F.when(F.try_element_at(path_entities("subject"), F.lit("sub")).isNotNull(), _level("subject", root)))
    asked = asked.withColumn("folder", F.concat("level", F.lit("/anat")))
    sizes = found.groupBy("folder").agg(F.count("*").alias("n"), F.min("candidate").alias("only"))
    exact = found.select(F.col("folder").alias("f"), "name", F.col("candidate").alias("own"))
    both = asked.join(sizes, "folder", "left").join(exact, (F.col("folder") == F.col("f")) & (F.concat("subject", F.lit(f"_{modality}.nii.gz")) == F.col("name")), "left")
    path = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("n") == 1, F.col("only"))
    status = F.when(F.col("level").isNull(), "no_subject").when(path.isNotNull(), "ok").when(F.col("n") > 1, "several").otherwise("missing")
    return both.select("subject", path.alias("path"), status.alias("status"))


def locate_segmentations(subjects: DataFrame, files: DataFrame, root: str, tool: str, modality: str = "T1w") -> DataFrame:
    """subject, path and status of <subject>_<modality>_seg.nii.gz below a folder that begins with the tool's name.

    It lies in <level>/<tool...>/post/FinalResult; of several such folders the first counts.
    """
    asked = subjects.select("subject").distinct().withColumn("level", F.when(F.try_element_at(path_entities("subject"), F.lit("sub")).isNotNull(), _level("subject", root)))
    inner = F.regexp_extract("candidate", r"^(.*)/([^/]+)/post/FinalResult/([^/]+)$", 1)
    found = files.select(inner.alias("l"), F.regexp_extract("candidate", r"/([^/]+)/post/FinalResult/[^/]+$", 1).alias("folder"), F.substring_index("candidate", "/", -1).alias("name"), "candidate")
    found = found.where(F.col("folder").startswith(tool)).groupBy("l", "name").agg(F.min("candidate").alias("path"))
    both = asked.join(found, (F.col("level") == F.col("l")) & (F.concat("subject", F.lit(f"_{modality}_seg.nii.gz")) == F.col("name")), "left")
    return both.select("subject", "path", F.when(F.col("level").isNull(), "no_subject").when(F.col("path").isNull(), "missing").otherwise("ok").alias("status"))
