"""Readers of files and tables, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred import schema
from kindred.functions.text import blank, clean
from kindred.operators.exact import excluded_dir
from kindred.schema import KEYS
from kindred.sources.npy import read_header, read_npy


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path exists in its file system and isn't an empty file."""
    p, fs = _path(spark, path)
    return bool(fs.exists(p)) and (fs.getFileStatus(p).isDirectory() or fs.getFileStatus(p).getLen() > 0)


def discover(spark: SparkSession, root: str, modality: str, exclude: tuple[str, ...] = ("derivatives", ".git", "code", "sourcedata")) -> DataFrame:
    """candidate: paths below root of NIfTI files of a modality in a sub- folder.

    Lists files only; their content is never read. Excluded folders count below root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{modality}.nii*").load(root).select("path", "length")
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    inner = F.expr("substring(candidate, instr(candidate, base) + length(base))")
    found = files.select(path.alias("candidate"), F.lit(base).alias("base")).withColumn("inner", F.when(F.instr("candidate", base) > 0, inner).otherwise(F.col("candidate")))
    keep = F.col("inner").rlike(rf"(^|/)sub-[^/]*/(.*/)?[^/]*_{modality}\.nii(\.gz)?$") & ~excluded_dir("inner", exclude)
    return found.where(keep).select("candidate").distinct()


def read_csv(spark: SparkSession, path: str, columns: T.StructType, aliases: dict[str, tuple[str, ...]] | None = None, fill: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV with header in the columns of a schema; other columns go.

    Header names are trimmed. aliases: other names under which a column may come. Values are
    read as text and cast (a bad number is an error). fill: missing text is "". multi_line:
    values may hold line ends; a file is then one task.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    for name, others in (aliases or {}).items():
        if name not in raw.columns:
            for other in others:
                if other in raw.columns:
                    raw = raw.withColumnRenamed(other, name)
                    break
    schema.require_columns(raw, columns.fieldNames())
    out = [blank(f.name).alias(f.name) if fill and isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]
    return raw.select(*out)


def read_csv_or_empty(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """read_csv, or no rows if the file is missing or empty."""
    return read_csv(spark, path, columns) if exists(spark, path) else schema.empty(spark, columns)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.CANDIDATES).where("candidate <> ''").distinct()


def read_valid_paths(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty resolved paths of a catalog."""
    return read_csv(spark, path, schema.strings("resolved_path")).select(F.trim("resolved_path").alias("resolved_path")).where("resolved_path <> ''").distinct()


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """candidate: lines of a text file, without blank ones and those that start with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("candidate"))
    return lines.where("candidate <> '' and not startswith(candidate, '#')")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Embedding manifest: unique scan_uid, emb_row exactly 0..n-1."""
    return schema.require_dense(schema.require_unique(read_csv(spark, path, schema.MANIFEST), "scan_uid"))


def read_embeddings(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """scan_uid and embedding (arrays of one length) from Parquet; with a manifest, exactly its scans.

    Of a matrix (.npy) the manifest is needed: its emb_row says which row is whose, and each row is someone's.
    """
    if path.endswith(".npy"):
        if manifest is None:
            raise ValueError(f"{path}: the rows of a matrix have no names without a manifest")
        rows = read_header(path).rows
        if (n := manifest.count()) != rows:
            raise ValueError(f"{path} has {rows} rows, the manifest {n}")
        return read_npy(spark, path).join(manifest.select("scan_uid", "emb_row"), "emb_row").select("scan_uid", "embedding")
    out = schema.require_length(spark.read.parquet(path).select("scan_uid", F.col("embedding").cast("array<float>").alias("embedding")))
    if manifest is not None:
        odd = out.select("scan_uid").join(manifest.select("scan_uid").withColumn("m", F.lit(1)), "scan_uid", "full").where("m is null").count() + manifest.join(out, "scan_uid", "left_anti").count()
        if odd:
            raise ValueError(f"embeddings and manifest differ in {odd} scans")
    return out


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.NEIGHBOURS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.PAIRS, aliases={f"resolved_path_{s}": (f"src_path_{s}", f"path_{s}") for s in ("a", "b")})


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    out = read_csv(spark, path, schema.DECISIONS, aliases={"qa_status": ("QA_status",)}, multi_line=True)
    return out.select(*[F.trim(c).alias(c) for c in out.columns])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.EDGES)


def read_embedding_input(spark: SparkSession, path: str) -> DataFrame:
    """Input of the embedding step: null tokens as "", rows without path or uid gone, unique scan_uid."""
    rows = read_csv(spark, path, schema.NEAR_INPUT)
    rows = rows.select(*[clean(c).alias(c) for c in rows.columns]).where("resolved_path <> '' and scan_uid <> ''")
    return schema.require_unique(rows, "scan_uid").orderBy("dataset", "subject_id", "session_id", "candidate", "scan_uid")


def read_duplicates(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    rows = read_csv(spark, path, schema.DUPLICATES).distinct()
    return rows if modality is None else rows.where(F.col("modality") == modality)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failures of an earlier embedding run: scan_uid, stage and error; none if there is no file."""
    return read_csv_or_empty(spark, path, schema.FAILURES).select("scan_uid", "stage", "error").where("scan_uid <> ''").distinct()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, schema.GROUPS)
    return rows.select("group_id", "group_size", *[F.trim(c).alias(c) for c in ("dataset", "subject_id", "subject_key")]).distinct()


def left_with_meta(mapping: DataFrame, meta: DataFrame, on: str = "candidate") -> DataFrame:
    """A mapping with the columns of its catalog rows: key columns first, then the rest, no repeated rows."""
    joined = mapping.join(meta, on, "left")
    first = [c for c in KEYS if c in joined.columns]
    return joined.select(*first, *[c for c in joined.columns if c not in first]).distinct()
