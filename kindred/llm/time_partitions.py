"""Time partitions that follow the rows, and their incremental maintenance.

Years, months, days and hours are the nodes of a tree; one with more than `limit` rows splits into
all of the next kind. Of the children of a split node (and of the years), those within the limit
join the run before them in time order as long as that stays within the limit. Leaves are runs
that have rows, hours above the limit, and the rows without a moment. A leaf's rows, in order,
fill parts of `limit` rows, each one Parquet file.

 1. Only counts of hours decide, so a histogram is all that planning reads. It is stored.
 2. New rows add their own histogram to the stored counts. The runs of every parent that has new
    rows are planned again; those of all others are taken over.
 3. Leaves that are still there and have no new rows keep their files unread. Of a leaf in parts,
    those before the first new row stay too. All other old files are read, joined by the new
    rows and cut into parts; a part whose leaf, number and rows are those of an old file leaves
    that file in place, the others are written, each by one task that streams sorted rows.
 4. The new state (counts, runs, files, then the row that makes it valid) is written beside the
    folder; what only the old state refers to is deleted after that. A driver that is lost in
    between leaves the old state and all of its files; the round is run again.

Nothing that grows with the rows goes through one task: leaves with more than `limit` rows are
numbered over ranges. Counts by hour are bounded by the calendar. At most rows / limit nodes of a
kind split, so runs, files and the members of runs (which are broadcast) are bounded by that ratio.

Defined results: nulls come first in every order; equal rows are all kept; of an empty table
nothing is left but the folder. Other columns are stored as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kindred.llm.arrow_rows import bounded_batches
from kindred.plans.numbering import group_numbers
from kindred.plans.stored import drop, scratched, stored

#: A node's key: the digits of its year, month, day and hour, as far as its kind has them; m is a row's moment.
HOUR = "((year(m) * 100L + month(m)) * 100 + day(m)) * 100 + hour(m)"
#: Leaf of the rows without a moment.
NO_MOMENT = "null"


@dataclass(frozen=True)
class Layout:
    """A folder of data files, and the tables that describe it."""

    folder: str
    limit: int
    moment: str  # SQL over the columns
    order: tuple[str, str]  # columns that follow the moment in a leaf's order; the second names the rows
    schema: StructType
    turn: int
    counts: DataFrame  # hour, n
    runs: DataFrame  # kind (0 years to 3 hours), parent, lo, hi, n, leaf
    files: DataFrame  # leaf, part, path, n_rows, n_new, ids_sha256, print, last, rewritten


def _nodes(counts: DataFrame) -> DataFrame:
    """kind, key and n of all nodes that have rows."""
    keys = "array(" + ", ".join(f"named_struct('kind', {k}, 'key', hour div {100 ** (3 - k)}L)" for k in range(4)) + ")"
    return counts.selectExpr("n", f"inline({keys})").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _siblings(nodes: DataFrame, limit: int, changed: DataFrame | None) -> DataFrame:
    """kind, parent, member and n of all years and of all children of nodes that split, those without rows too.

    changed: kind and parent of the families wanted; None: all. nodes is stored.
    """
    ends = nodes.where("kind = 0").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo is not null").selectExpr("0 as kind", "0L as parent", "lo", "hi")
    days = "day(last_day(make_date(int(key div 100), int(key % 100), 1)))"
    split = nodes.where((F.col("n") > limit) & (F.col("kind") < 3)).selectExpr("kind + 1 as kind", "key as parent", "if(kind = 2, 0L, 1L) as lo", f"cast(case kind when 0 then 12 when 1 then {days} else 23 end as long) as hi")
    families = ends.union(split)
    if changed is not None:
        families = families.join(changed, ["kind", "parent"], "left_semi")
    every = families.selectExpr("kind", "parent", "explode(sequence(lo, hi)) as member").selectExpr("*", "if(kind = 0, member, parent * 100 + member) as key")
    return every.join(nodes, ["kind", "key"], "left").selectExpr("kind", "parent", "cast(member as int) as member", "coalesce(n, 0L) as n")


def _runs(siblings: DataFrame, limit: int) -> DataFrame:
    """The runs that have rows, of each family (31 members at most, or the years)."""
    last = "x.runs[size(x.runs) - 1]"
    alone = "concat(x.runs, array(named_struct('lo', s.member, 'hi', s.member, 'n', s.n)))"
    longer = f"concat(slice(x.runs, 1, size(x.runs) - 1), array(named_struct('lo', {last}.lo, 'hi', s.member, 'n', {last}.n + s.n)))"
    state = lambda runs, open_: f"named_struct('runs', {runs}, 'open', {open_})"
    step = f"case when s.n > {limit}L then {state(f'if(kind = 3, {alone}, x.runs)', 'false')} when x.open and {last}.n + s.n <= {limit}L then {state(longer, 'true')} else {state(alone, 'true')} end"
    none = state("cast(array() as array<struct<lo:int,hi:int,n:bigint>>)", "false")
    families = siblings.groupBy("kind", "parent").agg(F.sort_array(F.collect_list(F.struct("member", "n"))).alias("each"))
    found = families.selectExpr("kind", "parent", f"inline(aggregate(each, {none}, (x, s) -> {step}).runs)").where("n > 0")
    digits = lambda of, n=2: f"lpad(cast({of} as string), {n}, '0')"
    above = f"case kind when 0 then '' when 1 then {digits('parent', 4)} || '/' when 2 then {digits('parent div 100', 4)} || '/' || {digits('parent % 100')} || '/' else {digits('parent div 10000', 4)} || '/' || {digits('parent div 100 % 100')} || '/' || {digits('parent % 100')} || '/' end"
    ends = [f"lpad(cast({x} as string), if(kind = 0, 4, 2), '0')" for x in ("lo", "hi")]
    return found.selectExpr("kind", "parent", "lo", "hi", "n", f"{above} || {ends[0]} || '-' || {ends[1]} as leaf")


def _families(hours: DataFrame) -> DataFrame:
    """kind and parent of the families that some hours are below."""
    keys = "array(named_struct('kind', 0, 'parent', 0L), " + ", ".join(f"named_struct('kind', {k}, 'parent', hour div {100 ** (4 - k)}L)" for k in (1, 2, 3)) + ")"
    return hours.selectExpr(f"inline({keys})").distinct()


def planned(counts: DataFrame, limit: int, changed: DataFrame | None = None) -> DataFrame:
    """The runs of all families, or of those in `changed` (kind, parent)."""
    return _runs(_siblings(stored(_nodes(counts), "nodes"), limit, changed), limit)


def _with_leaves(rows: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """rows (m is their moment) with their leaf l and whether it has more rows than the limit.

    The members of runs are broadcast: 31 for each node that splits, at most, and years.
    """
    members = runs.select("kind", F.explode(F.sequence("lo", "hi")).alias("member"), "parent", "leaf", (F.col("n") > limit).alias("big"))
    keys = members.select("kind", F.expr("if(kind = 0, 0L, parent * 100) + member").alias("key"), "leaf", "big")
    out = rows
    for k in range(4):
        own = keys.where(F.col("kind") == k).select(F.col("key").alias(f"k{k}"), F.col("leaf").alias(f"l{k}"), F.col("big").alias(f"b{k}"))
        out = out.join(F.broadcast(own), F.expr(f"({HOUR}) div {100 ** (3 - k)}L") == F.col(f"k{k}"), "left")
    return out.select(*rows.columns, F.coalesce("l0", "l1", "l2", "l3", F.lit(NO_MOMENT)).alias("l"), F.coalesce("b0", "b1", "b2", "b3", F.lit(True)).alias("big"))


def _packed(rows: DataFrame, moment: str, order: tuple[str, str], new: bool) -> DataFrame:
    """m, a and i (rows are ordered by them), d (a digest of the whole row), new, and r: the row as it is."""
    stamps = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    digest = F.unhex(F.sha2(F.to_json(row, stamps).cast("binary"), 256))
    return rows.select(F.expr(moment).cast("timestamp_ntz").alias("m"), F.col(f"`{order[0]}`").alias("a"), F.col(f"`{order[1]}`").alias("i"), digest.alias("d"), F.lit(new).alias("new"), row.alias("r"))


def _hours(rows: DataFrame) -> DataFrame:
    return rows.where("m is not null").groupBy(F.expr(HOUR).alias("hour")).agg(F.count("*").alias("n"))


def _in_parts(rows: DataFrame, limit: int) -> DataFrame:
    """rows with the number p of their part, from `first` on. rows is stored."""
    small = rows.where("not big").withColumn("p", F.col("first"))
    # equal rows are told apart by a random number, so that they can be dealt to several ranges
    large = group_numbers(rows.where("big").withColumn("salt", F.rand(3)), ["l"], ["m", "a", "i", "d", "salt"], "at")
    large = large.withColumn("p", (F.col("first") + F.expr(f"(at - 1) div {limit}L")).cast("int"))
    return small.unionByName(large.select(*small.columns))


#: Sums of pieces of the rows' digests: equal for equal multisets of rows.
_PRINT = "concat_ws(':', " + ", ".join(f"cast(sum(cast(conv(substr(hex(d), {1 + 15 * k}, 15), 16, 10) as decimal(38,0))) as string)" for k in range(4)) + ")"


def _facts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(F.col("l").alias("leaf"), F.col("p").alias("part")).agg(F.count("*").alias("n_rows"), F.sum(F.col("new").cast("long")).alias("n_new"), F.expr(_PRINT).alias("print"), F.max(F.struct("m", "a", "i")).alias("last"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leaf, part, path and the digest of the ids of each file; a file's rows come one after the other."""
    now, digest, out = None, hashlib.sha256(), []
    for b in batches:
        ids = b.column(3).to_pylist()
        paths = b.column(2).to_pylist()
        lo = 0
        while lo < len(paths):
            hi = lo + 1
            while hi < len(paths) and paths[hi] == paths[lo]:
                hi += 1
            text = ",".join(ids[lo:hi]).encode()
            if now is not None and now[2] == paths[lo]:
                digest.update(b"," + text)
            else:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (b.column(0)[lo].as_py(), b.column(1)[lo].as_py(), paths[lo]), hashlib.sha256(text)
            lo = hi
    if now is not None:
        out.append((*now, digest.hexdigest()))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["leaf", "part", "path", "ids_sha256"])


def _written(parts: DataFrame, folder: str, turn: int, schema: StructType, order: tuple[str, str]) -> DataFrame:
    """Writes each part as one file and reads the files back: leaf, part, path and digest of the ids in the files' order."""
    spark = parts.sparkSession
    place, low = f"{folder}/turn={turn}", {c.lower() for c in schema.names}
    leaf, part = (next(x for k in range(len(low) + 1) if (x := name + "_" * k) not in low) for name in ("in_leaf", "in_part"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # dots for slashes in folders' names; never null, or Spark would sort once more by the folder alone
    named = parts.select(F.coalesce(F.translate("l", "/", "."), F.lit("")).alias("l"), F.coalesce("p", F.lit(0)).alias("p"), "m", "a", "i", "d", "r")
    rows = named.repartition(n, "l", "p").sortWithinPartitions("l", "p", "m", "a", "i", "d")
    rows.select(F.col("l").alias(leaf), F.col("p").alias(part), *[F.col("r").getField(c).alias(c) for c in schema.names]).write.option("maxRecordsPerFile", 0).partitionBy(leaf, part).parquet(place)
    there = StructType([schema[order[1]], StructField(leaf, StringType()), StructField(part, IntegerType())])
    back = spark.read.schema(there).parquet(place)
    name = F.coalesce(F.col(f"`{order[1]}`").cast("string"), F.lit(""))
    told = back.select(F.translate(leaf, ".", "/").alias("leaf"), F.col(part).alias("part"), F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("_metadata.row_index").alias("at"))
    return bounded_batches(told.repartition(n, "path").sortWithinPartitions("path", "at")).select("leaf", "part", "path", "name").mapInArrow(_digests, "leaf string, part int, path string, ids_sha256 string")


def _state(folder: str, turn: int) -> str:
    return f"{folder}-state/turn={turn}"


def _kept(folder: str, turn: int, name: str, table: DataFrame) -> DataFrame:
    path = f"{_state(folder, turn)}/{name}"
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _committed(layout: Layout) -> Layout:
    """Writes the row that makes a layout's state valid."""
    row = (layout.limit, layout.moment, *layout.order, layout.schema.json())
    layout.counts.sparkSession.createDataFrame([row], "limit long, moment string, a string, i string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{_state(layout.folder, layout.turn)}/valid")
    return layout


def open_layout(spark: SparkSession, folder: str, turn: int) -> Layout:
    """The layout as its turn left it (0: as it was created)."""
    place = _state(folder, turn)
    valid = spark.read.parquet(f"{place}/valid").first()
    counts, runs, files = (spark.read.parquet(f"{place}/{x}") for x in ("counts", "runs", "files"))
    return Layout(folder, valid["limit"], valid["moment"], (valid["a"], valid["i"]), StructType.fromJson(json.loads(valid["schema"])), turn, counts, runs, files)


@scratched
def create_layout(rows: DataFrame, folder: str, limit: int, moment: str, order: tuple[str, str]) -> Layout:
    """Writes rows into a new folder. moment: SQL for a row's moment; order: two columns that follow it."""
    packed = stored(_packed(rows, moment, order, True), "clicks")
    counts = _kept(folder, 0, "counts", _hours(packed))
    runs = _kept(folder, 0, "runs", planned(counts, limit))
    held = stored(_with_leaves(packed, runs, limit).withColumn("first", F.lit(1)), "leaves")
    drop(packed)
    parts = _in_parts(held, limit)
    facts = stored(_facts(parts), "facts")
    new = _written(parts, folder, 0, rows.schema, order)
    files = _kept(folder, 0, "files", facts.join(new, ["leaf", "part"]).select("leaf", "part", "path", "n_rows", "n_new", "ids_sha256", "print", "last", F.lit(True).alias("rewritten")))
    return _committed(Layout(folder, limit, moment, order, rows.schema, 0, counts, runs, files))


@scratched
def add_rows(layout: Layout, rows: DataFrame) -> Layout:
    """Adds rows (of the layout's columns) and rewrites what they change."""
    spark, limit, turn = rows.sparkSession, layout.limit, layout.turn + 1
    late = stored(_packed(rows.select(*[f"`{c}`" for c in layout.schema.names]), layout.moment, layout.order, True), "late")
    hours = stored(_hours(late), "hours")
    counts = _kept(layout.folder, turn, "counts", layout.counts.union(hours).groupBy("hour").agg(F.sum("n").alias("n")))
    changed = stored(_families(hours), "changed")
    same = layout.runs.join(changed, ["kind", "parent"], "left_anti").select(*layout.runs.columns)
    runs = _kept(layout.folder, turn, "runs", same.union(planned(counts, limit, changed)))
    late = stored(_with_leaves(late, runs, limit), "late")
    least = late.groupBy(F.col("l").alias("leaf")).agg(F.min(F.struct("m", "a", "i")).alias("least"))
    # files of leaves that are still there stay if their leaf has no new rows, or if they are full and all new rows come after theirs
    names = runs.select("leaf").union(spark.range(1).select(F.lit(NO_MOMENT))).withColumn("there", F.lit(True))
    told = layout.files.join(names, "leaf", "left").join(least, "leaf", "left")
    told = stored(told.withColumn("stays", F.col("there").isNotNull() & (F.col("least").isNull() | ((F.col("n_rows") == limit) & (F.col("last") < F.col("least"))))), "old-files")
    paths = [r["path"] for r in told.where("not stays").select("path").collect()]  # at most the files there are: rows / limit decides, not the rows
    old = spark.read.schema(layout.schema).parquet(*paths) if paths else rows.limit(0)
    firsts = told.where("stays and least is not null").groupBy(F.col("leaf").alias("fl")).agg((F.max("part") + 1).alias("f"))
    both = _with_leaves(_packed(old.select(*[f"`{c}`" for c in layout.schema.names]), layout.moment, layout.order, False), runs, limit).unionByName(late)
    held = stored(both.join(F.broadcast(firsts), F.col("l") == F.col("fl"), "left").withColumn("first", F.coalesce("f", F.lit(1))).drop("fl", "f"), "leaves")
    parts = _in_parts(held, limit)
    facts = stored(_facts(parts), "facts")
    again = told.where("not stays").select("leaf", "part", "n_rows", "print", "path", "ids_sha256")
    recurring = stored(facts.join(again, ["leaf", "part", "n_rows", "print"], "left_semi").select("leaf", "part"), "recurring")
    gone = F.broadcast(recurring.select(F.col("leaf").alias("rl"), F.col("part").alias("rp")))
    new = _written(parts.join(gone, (F.col("l") == F.col("rl")) & (F.col("p") == F.col("rp")), "left_anti"), layout.folder, turn, layout.schema, layout.order)
    columns = ["leaf", "part", "path", "n_rows", "n_new", "ids_sha256", "print", "last"]
    kept = told.where("stays").unionByName(told.where("not stays").join(recurring, ["leaf", "part"], "left_semi"))
    kept = kept.withColumn("n_new", F.lit(0).cast("long")).select(*columns, F.lit(False).alias("rewritten"))
    files = _kept(layout.folder, turn, "files", kept.union(facts.join(new, ["leaf", "part"]).select(*columns, F.lit(True))))
    out = _committed(Layout(layout.folder, limit, layout.moment, layout.order, layout.schema, turn, counts, runs, files))
    stale = layout.files.join(files, "path", "left_anti").select("path").collect()  # bounded like paths
    jvm = spark._jvm
    for r in stale:  # each file is alone in its folder
        p = jvm.org.apache.hadoop.fs.Path(r["path"]).getParent()
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    return out
