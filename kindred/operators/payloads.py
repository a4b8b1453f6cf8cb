"""Bodies with review decisions as a reviewer's program sends them: validation, and their decisions.

A body is a JSON object with a list `updates`; each update is an object with two objects a and b
(dataset, subject_id, session_id, scan_uid, src_path), qa_status and reason. A body with any
fault gives its first one and no decision, as if it had not come.

Defined results: null bodies are faulty; null tokens and blanks are missing values; numbers count
as their text; further fields are ignored; an empty list is sound and gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean
from kindred.operators.decisions import STATES

FIELDS = ("dataset", "subject_id", "session_id", "scan_uid", "src_path")
NEEDED = ("dataset", "subject_id", "scan_uid", "src_path")


def inside(path: str | Column, root: str) -> Column:
    """Whether a path, with . and .. resolved, is root or lies below it; relative paths begin at root.

    Names alone decide: links are not followed. Null and empty paths are not inside.
    """
    p = F.col(path) if isinstance(path, str) else path
    base = "/" + root.strip("/")
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{base}/"), p))
    # a step up takes the last name away, and stays at the top
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/"))
    return F.coalesce((p != "") & ((resolved == base) | resolved.startswith(base.rstrip("/") + "/")), F.lit(False))


def _is(value: Column | str, kind: str) -> Column:
    """Whether a variant is of a kind; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _judged(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Every body once for each of its updates, or once: id, idx, error, a, b, qa_status and reason."""
    read = bodies.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(body_col)).alias("v"))
    read = read.withColumn("list", F.when(_is("v", "OBJECT"), F.try_variant_get("v", "$.updates", "variant")))
    whole = F.when(~_is("v", "OBJECT"), "Bad payload").when(~_is("list", "ARRAY"), "Payload must contain list field 'updates'")
    read = read.select("id", whole.alias("whole"), F.when(_is("list", "ARRAY"), F.try_variant_get("list", "$", "array<variant>")).alias("updates"))
    each = read.select("id", "whole", F.posexplode_outer("updates").alias("idx", "u"))
    side = lambda s: F.when(_is("u", "OBJECT"), F.try_variant_get("u", f"$.{s}", "variant"))
    each = each.withColumn("va", side("a")).withColumn("vb", side("b"))
    fields = lambda v: F.struct(*[clean(F.try_variant_get(v, f"$.{f}", "string")).alias(f) for f in FIELDS])
    text = lambda f: F.when(_is("u", "OBJECT"), clean(F.try_variant_get("u", f"$.{f}", "string")))
    each = each.select("id", "whole", "idx", _is("u", "OBJECT").alias("object"), (_is("va", "OBJECT") & _is("vb", "OBJECT")).alias("pair"), F.when(_is("va", "OBJECT"), fields("va")).alias("a"), F.when(_is("vb", "OBJECT"), fields("vb")).alias("b"), F.lower(text("qa_status")).alias("qa_status"), F.coalesce(text("reason"), F.lit("")).alias("reason"))
    at = lambda before, after="": F.concat(F.lit(f"{before} updates["), F.col("idx").cast("string"), F.lit(f"]{after}"))
    lacking = F.lit(False)
    for s in ("a", "b"):
        for f in NEEDED:
            lacking = lacking | (F.col(s)[f] == "")
    item = F.when(~F.col("object"), at("Bad update at")).when(~F.col("pair"), at("Bad pair payload at")).when(lacking, at("Missing required fields in", " (dataset/subject_id/scan_uid/src_path)")).when(~F.coalesce(F.col("qa_status").isin(*STATES), F.lit(False)), at("Bad status in"))
    return each.select("id", "idx", F.coalesce("whole", F.when(F.col("idx").isNotNull(), item)).alias("error"), "a", "b", "qa_status", "reason")


def payload_errors(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id_col and error: the first fault of each body that has one. Ids name bodies."""
    return _judged(bodies, id_col, body_col).where("error is not null").groupBy(F.col("id").alias(id_col)).agg(F.min_by("error", F.coalesce("idx", F.lit(-1))).alias("error"))


def updates(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id_col, idx and the decisions of sound bodies, in the columns of a decision log with scan_uid."""
    rows = _judged(bodies, id_col, body_col)
    bad = rows.where("error is not null").select(F.col("id").alias("bad")).distinct()
    sound = rows.where("idx is not null").join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti")
    name = lambda f: "path" if f == "src_path" else f
    sides = [F.col(f"{s}.{f}").alias(f"{name(f)}_{i}") for i, s in ((1, "a"), (2, "b")) for f in FIELDS]
    return sound.select(F.col("id").alias(id_col), "idx", *sides, "qa_status", "reason")
