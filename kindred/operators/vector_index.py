"""A stored index of vectors: inverted lists of 8-bit codes, extended by new vectors, with exact re-ranking.

 * `build_index` learns centroids on a bounded sample and writes every vector twice: as 8-bit
   numbers with a scale and how far they are off in the list of its nearest centroid, and as it is, by uid. `extend_index`
   adds vectors to both; centroids stay. Each step is a Spark job whose files appear as a whole.
 * `search` sends each query to its nearest lists. A list's codes are read once, in blocks, and meet the
   queries that came to it: an eighth of the bytes of doubles, and no vector is sent to queries that
   don't look at its list. Each query keeps every candidate that can be among its best, given how far
   codes are off; only these are joined with their vectors, and exact similarities decide. So codes
   lose nothing; where many vectors are closer to each other than codes tell, more are joined.

What `probes` lists out of all hold depends on the vectors: where they lie in clusters, few lists are
enough; where they have no structure, the share of neighbours found is little more than the share
of lists looked at. With all lists the result is that of `vectors.nearest`.

Defined results: null vectors are left out; an uid that the index has is not added again; of equal
uids in one batch the smallest row counts. Zero vectors have similarity 0 with everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.operators.vectors import BLOCK, DIGITS, _ranked, _unit, centroids
from kindred.plans.stored import stored
from kindred.sources.tables import exists

_CODES = "cell int, uid string, owner string, code binary, scale float, off float"
_VECTORS = "uid string, owner string, embedding array<float>"
_ASKED = "cell int, query string, query_owner string, embedding array<float>"


@dataclass(frozen=True)
class VectorIndex:
    path: str
    centres: np.ndarray  # lists by length: what is broadcast

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_CODES).parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors")


def _clean(vectors: DataFrame) -> DataFrame:
    return vectors.where("uid is not null and embedding is not null").select(F.col("uid").cast("string"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.col("embedding").cast("array<float>").alias("embedding"))


def _coded(index: VectorIndex, vectors: DataFrame) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches):
        for b in batches:
            x = _unit(b.column(2))
            if x.shape[1] != held.value.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} numbers in an index of {held.value.shape[1]}")
            scale = np.maximum(np.abs(x).max(1, initial=0), 1e-12) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            off = np.linalg.norm(x - scale.astype(np.float32).astype(np.float64)[:, None] * codes, axis=1) * (1 + 1e-6)
            cell = (x @ held.value.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale, pa.float32()), pa.array(off, pa.float32())], names=["cell", "uid", "owner", "code", "scale", "off"])

    return vectors.mapInArrow(run, _CODES)


def _added(index: VectorIndex, new: DataFrame) -> None:
    """Vectors first: what has a code has a vector, though a job fails in between."""
    new.repartitionByRange("uid").sortWithinPartitions("uid").write.mode("append").parquet(f"{index.path}/vectors")
    _coded(index, new).repartitionByRange("cell", "uid").sortWithinPartitions("cell").write.mode("append").parquet(f"{index.path}/codes")


def build_index(vectors: DataFrame, path: str, lists: int, train_rows: int = 200_000) -> VectorIndex:
    """A new index at path with at most so many lists. ValueError if there is one, or no vector."""
    spark = vectors.sparkSession
    if exists(spark, f"{path}/centres"):
        raise ValueError(f"{path} has an index")
    new = stored(_clean(vectors).groupBy("uid").agg(F.min(F.struct("owner", "embedding")).alias("r")).select("uid", "r.*"), "vectors")
    if new.isEmpty():
        raise ValueError("no vectors to learn lists from")
    centres = centroids(new, lists, train_rows)
    index = VectorIndex(path, centres)
    _added(index, new)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one row per list
    return VectorIndex(path, np.array([r["centre"] for r in rows]))


def extend_index(index: VectorIndex, vectors: DataFrame) -> int:
    """Adds the vectors whose uid the index doesn't have; their number. After a failure it may be called again."""
    spark = vectors.sparkSession
    new = _clean(vectors).groupBy("uid").agg(F.min(F.struct("owner", "embedding")).alias("r")).select("uid", "r.*")
    new = stored(new.join(index.codes(spark).select("uid"), "uid", "left_anti"), "new-vectors")
    n = new.count()
    if n:
        _added(index, new)
    return n


def _scanned(batches, least: int, pre: bool):
    """What can be among the `least` best candidates of a block of queries within a block of a list,
    with the bounds of its similarity."""
    for b in batches:
        for asked, held in zip(b.column(0), b.column(1), strict=True):
            asked, held = asked.values, held.values
            q = _unit(asked.field(2)).astype(np.float32)
            codes = np.frombuffer(b"".join(held.field(2).to_pylist()), np.int8).reshape(len(held), -1).astype(np.float32)
            scale = held.field(3).to_numpy()
            # an index of before `off`: each number is off by half a step at most; then what 32 bits may lose
            off = held.field(4).to_numpy(zero_copy_only=False).astype(np.float64)
            off = np.where(np.isnan(off), scale / 2 * np.sqrt(codes.shape[1]), off) + (codes.shape[1] + 8) / 2.0**23
            sims = ((q @ codes.T) * scale).astype(np.float64)
            owners, names = (np.array(held.field(i).to_pylist(), object) for i in (1, 0))
            queries, query_owners = (np.array(asked.field(i).to_pylist(), object) for i in (0, 1))
            sims[np.isnan(sims)] = -np.inf
            if pre:
                sims[query_owners[:, None] == owners] = -np.inf
            low, high = sims - off, sims + off
            bound = np.partition(low, -least, axis=1)[:, -least] if low.shape[1] >= least else np.full(len(low), -np.inf)
            rows, found = np.nonzero(np.isfinite(sims) & (high >= bound[:, None]))
            columns = [queries[rows], query_owners[rows], names[found], owners[found]]
            bounds = [pa.array(x[rows, found]) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.tolist(), pa.string()) for c in columns), *bounds], names=["query", "query_owner", "cand", "cand_owner", "low", "high"])


def search(index: VectorIndex, queries: DataFrame, topk: int, probes: int, filter_mode: str = "post") -> DataFrame:
    """query, cand, rank and cosine similarity, as vectors.nearest gives them, from `probes` lists of each query.

    queries: uid, owner and embedding; they need not be in the index.
    """
    spark = queries.sparkSession
    held, pre, least = spark.sparkContext.broadcast(index.centres), filter_mode == "pre", topk + 1

    def sent(batches):
        for b in batches:
            cells = np.argsort(-(_unit(b.column(2)) @ held.value.T), axis=1, kind="stable")[:, :probes]
            n = cells.shape[1]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), *(c.take(at) for c in b.columns)], names=["cell", "query", "query_owner", "embedding"])

    asked = stored(_clean(queries), "queries")
    to = asked.mapInArrow(sent, _ASKED).withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-asked.count() // BLOCK)))))
    left = to.groupBy("cell", "qb").agg(F.collect_list(F.struct("query", "query_owner", "embedding")).alias("asked"))
    codes = index.codes(spark)
    sizes = codes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # one row per list
    blocks = codes.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("uid", "owner", "code", "scale", "off")).alias("held"))
    found = left.join(blocks, "cell").select("asked", "held").mapInArrow(lambda it: _scanned(it, least, pre), "query string, query_owner string, cand string, cand_owner string, low double, high double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low"))))
    bound = F.max(F.when(F.col("r") == least, F.col("low"))).over(Window.partitionBy("query"))
    few = best.withColumn("bound", bound).where("bound is null or high >= bound").select("query", "query_owner", "cand", "cand_owner")
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x)
    length = lambda c: F.greatest(F.sqrt(F.aggregate(unit(c), F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    dot = F.aggregate(F.zip_with(unit("qe"), unit("embedding"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = few.join(index.vectors(spark).select(F.col("uid").alias("cand"), "embedding"), "cand").join(asked.select(F.col("uid").alias("query"), F.col("embedding").alias("qe")), "query")
    return _ranked(exact.select("query", "query_owner", "cand", "cand_owner", F.round(dot / length("qe") / length("embedding"), DIGITS).alias("similarity")), topk, pre)
