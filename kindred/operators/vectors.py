"""Nearest neighbours by cosine similarity: exact in blocks, and by inverted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import stored

#: Candidates of a block, and queries of one at least and at most: a task holds a block of queries
#: while blocks of candidates pass by.
BLOCK, LEAST_QUERIES, MOST_QUERIES = 1024, 128, 32_768
#: Candidates that travel as one row and are merged at once: fewer rows to shuffle and fewer merges.
PACK = 4096
#: Blocks of queries for each core.
WAVES = 2
#: Queries whose similarities to a block are computed at once (they stay in a core's cache), and pairs
#: that are computed in full.
ROWS, PAIRS = 512, 65_536
#: Names of candidates that a task holds beside those of its best.
NAMES = 131_072
#: Rows to show for repeated vectors that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Digits that decide; beyond them the order of summation does.
DIGITS = 12
#: Inverted lists are used from max(LEAST_INDEXED, 10 * lists) vectors on.
LEAST_INDEXED = 10_000
EPSILON = 1e-12


def normalised(c, keep_zero: bool = False) -> Column:
    """A vector divided by its length (at least 1e-12); keep_zero leaves shorter ones unchanged."""
    v = F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.transform(v, lambda x: x / F.greatest(norm, F.lit(EPSILON)))
    return F.when(norm <= EPSILON, v).otherwise(scaled) if keep_zero else scaled


class _Block:
    """Vectors at unit length, in 64 and in 32 bits, with their names.

    A candidate may stand for all rows of an equal vector: `equal` names them, `sure` is how many
    of them any query that meets it can have at least, `own` says that it is for its owner's
    queries, not for all others. `place` is where it stands in the order of all uids, if candidates
    don't come in that order.
    """

    def __init__(self, uid: pa.Array, owner: pa.Array, matrix: np.ndarray, equal: pa.Array | None = None, sure: np.ndarray | None = None, own: np.ndarray | None = None, place: np.ndarray | None = None):
        self.uid, self.owner, self.matrix, self.low = uid, owner, matrix, matrix.astype(np.float32)
        self.equal = pa.nulls(len(uid), pa.string()) if equal is None else equal
        self.sure = np.ones(len(uid), np.int64) if sure is None else sure
        self.own = np.zeros(len(uid), bool) if own is None else own
        self.place = place


def _unit(embeddings: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix of unit vectors; ValueError if lengths differ."""
    flat = embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(embeddings))
    if embeddings.null_count or (np.diff(embeddings.offsets.to_numpy()) != width).any():
        raise ValueError("vectors are null or of different lengths")
    return _scaled(flat.reshape(len(embeddings), width))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPSILON)


class _Top:
    """The k + 1 best candidates of each query of a block; ties go to the first place, or to the candidate that came first.

    Similarities in 32 bits only rule out what, with all their error, can't be among the best;
    the rest, a few hundred candidates a query at any size, is computed in 64 bits, which decide.
    """

    def __init__(self, queries: _Block, k: int, pre: bool):
        self.queries, self.k, self.pre = queries, k + 1, pre
        n, width = queries.matrix.shape
        self.sims = np.full((n, self.k), -np.inf)
        self.at = np.zeros((n, self.k), np.int64)
        self.place = np.zeros((n, self.k), np.int64)
        # unit vectors: a sum of products is off by less than (width + 3) / 2 ** 24
        self.slack = (width + 8) / 2.0**23
        self.bound = np.full(n, -np.inf, np.float32)
        self.codes: dict = {}
        self.code = np.array([self.codes.setdefault(o, len(self.codes)) for o in queries.owner.to_pylist()], np.int64)
        self.uid: list[pa.Array] = []
        self.owner: list[pa.Array] = []
        self.equal: list[pa.Array] = []
        self.sure: list[pa.Array] = []
        self.seen = self.kept = self.passed = 0
        self.room = np.empty(0, np.float32)

    def add(self, cands: _Block, rows: np.ndarray | None = None) -> None:
        """Compares a block of candidates with all queries, or those at rows; pre: an owner's own rows don't count."""
        code = np.array([self.codes.get(o, -1) for o in cands.owner.to_pylist()], np.int64)
        rows = np.arange(len(self.sims)) if rows is None else rows
        self.coming = self.passed + np.arange(len(cands.uid)) if cands.place is None else cands.place
        for lo in range(0, len(rows), ROWS):
            self._compare(rows[lo : lo + ROWS], cands, code)
        for names, more in zip(self._names(), (cands.uid, cands.owner, cands.equal, pa.array(cands.sure)), strict=True):
            names.append(more)
        self.seen, self.passed = self.seen + len(cands.uid), self.passed + len(cands.uid)
        if self.seen > 2 * self.kept + NAMES:
            used, at = np.unique(self.at, return_inverse=True)
            for names in self._names():
                names[:] = [pa.concat_arrays(names).take(pa.array(used))]
            self.at, self.seen, self.kept = at.reshape(self.at.shape), len(used), len(used)

    def _names(self) -> tuple[list[pa.Array], ...]:
        return self.uid, self.owner, self.equal, self.sure

    def _compare(self, rows: np.ndarray, cands: _Block, code: np.ndarray) -> None:
        low, bound, found = self.queries.low[rows], self.bound[rows], []
        for at in range(0, len(cands.low), BLOCK):
            part = slice(at, min(len(cands.low), at + BLOCK))
            bound, row, col = self._able(rows, low, cands, code, part, bound)
            found.append((row, col + at))
        row, col = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        if 16 * len(row) > len(rows) * len(cands.low):
            sims = (self.queries.matrix[rows] @ cands.matrix.T)[row, col]
        else:
            sims = np.empty(len(row))
            for i in range(0, len(row), PAIRS):
                sims[i : i + PAIRS] = np.einsum("ij,ij->i", self.queries.matrix[rows[row[i : i + PAIRS]]], cands.matrix[col[i : i + PAIRS]])
        sims, row = np.round(sims, DIGITS), rows[row]
        last = self.sims[row, -1]
        better = (sims > last) | ((sims == last) & (self.coming[col] < self.place[row, -1]))
        if better.any():
            self._merge(row[better], self.seen + col[better], sims[better])

    def _able(self, rows: np.ndarray, asked: np.ndarray, cands: _Block, code: np.ndarray, part: slice, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that 32 bits don't rule out, as places in rows and in part, and the bounds of the queries after it. asked: the queries at rows, in 32 bits."""
        low, own, code = cands.low[part], cands.own[part], code[part]
        shape = (len(rows), len(low))
        if self.room.size < shape[0] * shape[1]:
            self.room = np.empty(shape[0] * shape[1], np.float32)
        near = np.matmul(asked, low.T, out=self.room[: shape[0] * shape[1]].reshape(shape))
        fresh = np.flatnonzero(np.isneginf(bound))
        if len(fresh) and near.shape[1] > self.k:  # no k candidates yet: those of this part set the bound
            some = near[fresh]
            if self.pre:
                some[(self.code[rows[fresh]][:, None] == code) != own] = -np.inf
            some[np.isnan(some)] = -np.inf
            bound = bound.copy()
            bound[fresh] = np.partition(some, -self.k, axis=1)[:, -self.k] - 2 * self.slack
        # the best of most queries is below their bound; numbers that are none hide a best one
        some = np.flatnonzero(~(near.max(axis=1, initial=-np.inf) < bound))
        row, col = np.divmod(np.flatnonzero((near[some] >= bound[some, None]).ravel()), near.shape[1])
        row = some[row]
        if self.pre:
            other = (self.code[rows[row]] != code[col]) != own[col]
            row, col = row[other], col[other]
        return bound, row, col

    def _merge(self, row: np.ndarray, at: np.ndarray, sims: np.ndarray) -> None:
        """Takes new candidates among the best of their rows."""
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        place = np.concatenate([self.place[rows].ravel(), self.coming[at - self.seen]])
        sims, at = np.concatenate([self.sims[rows].ravel(), sims]), np.concatenate([self.at[rows].ravel(), at])
        order = np.lexsort((place, -sims, row))
        row, sims, at, place = row[order], sims[order], at[order], place[order]
        n = np.arange(len(row)) - np.searchsorted(row, row)
        first = n < self.k
        to = row[first], n[first]
        self.sims[to], self.at[to], self.place[to] = sims[first], at[first], place[first]
        self.bound[rows] = self.sims[rows, -1] - self.slack

    def rows(self) -> pa.RecordBatch:
        """The best of each query; none that stands behind enough rows of a greater similarity."""
        names = [pa.concat_arrays(x) if x else pa.array([], kind) for x, kind in zip(self._names(), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]
        able = np.isfinite(self.sims)
        if len(names[3]):
            sure = np.where(able, names[3].to_numpy()[self.at], 0)
            before = np.cumsum(sure, axis=1) - sure
            run = np.ones(self.sims.shape, bool)  # where another similarity begins
            run[:, 1:] = self.sims[:, 1:] != self.sims[:, :-1]
            begin = np.maximum.accumulate(np.where(run, np.arange(self.k), 0), axis=1)
            able &= np.take_along_axis(before, begin, axis=1) < self.k
        rows, cols = np.nonzero(able)
        to, by = pa.array(self.at[rows, cols]), pa.array(rows)
        columns = [self.queries.uid.take(by), self.queries.owner.take(by), *(x.take(to) for x in names[:2])]
        return pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), pa.array(self.sims[rows, cols], pa.float64()), names[2].take(to).cast(pa.string())], names=["query", "query_owner", "cand", "cand_owner", "similarity", "equal"])


def _coded(batches, kind: str):
    """uid, owner and the numbers of a vector as bytes."""
    for b in batches:
        x = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["uid", "owner", "vector"])


def _packs(batches):
    """Rows qb, uid, owner, … as few large ones: at most PACK of one qb, in their order, with the first uid and owner."""
    for b in batches:
        qb = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(qb, kind="stable")
        qb, rows = qb[order], b.select(b.schema.names[1:]).take(pa.array(order))
        cuts = [0, *(np.flatnonzero(np.diff(qb)) + 1).tolist(), len(qb)]
        out = [(int(qb[at]), rows.slice(at, min(PACK, hi - at))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for at in range(lo, hi, PACK)]
        for block, pack in out:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pack.schema) as writer:
                writer.write_batch(pack)
            first = [pa.array([block], pa.int32()), *(pack.column(i).slice(0, 1).cast(pa.string()) for i in (0, 1)), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(first, names=["qb", "uid", "owner", "pack"])


_PACKED = "qb int, uid string, owner string, pack binary"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, as bytes, as a matrix of unit vectors; ValueError if lengths differ."""
    packed = column.to_pylist()
    if len({len(x) for x in packed}) > 1:
        raise ValueError("vectors are null or of different lengths")
    flat = np.frombuffer(b"".join(packed), kind).astype(np.float64)
    return _scaled(flat.reshape(len(packed), len(flat) // max(1, len(packed))))


def _decoded(rows: pa.RecordBatch, kind: str) -> _Block:
    """A block of rows uid, owner, vector and, of candidates, equal, sure, own and place if they have one."""
    names = set(rows.schema.names)
    more = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("sure", "own", "place") if c in names}
    return _Block(rows.column(0), rows.column(1), _matrix(rows.column(2), kind), rows.column("equal") if "equal" in names else None, **more)


def _asking(rows: pa.RecordBatch):
    """For each list the places of the queries that look at it; without lists, None: all."""
    if "cells" not in rows.schema.names:
        return lambda cell: None
    cells = rows.column("cells")
    flat = cells.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], order // (len(flat) // len(cells))
    return lambda cell: row[slice(*np.searchsorted(flat, [cell, cell + 1]))]


def _streamed(batches, k: int, pre: bool, kind: str):
    """Top k of each block of queries over the candidates that follow it.

    Rows: block of queries, side (0: its queries, 1: candidates), pack and the list it is of, in the
    order of block, side, list and uid. A block without queries has no result.
    """
    top, of, asked, asking = None, None, [], None
    for b in batches:
        for qb, side, pack, cell in zip(*(b.column(i) for i in range(4)), strict=True):
            rows = pa.ipc.open_stream(pack.as_buffer()).read_next_batch()
            if qb.as_py() != of:
                if top is not None:
                    yield top.rows()
                top, of, asked = None, qb.as_py(), []
            if side.as_py() == 0:
                asked.append(rows)
                continue
            if top is None and asked:
                queries = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
                top, asking, asked = _Top(_decoded(queries, kind), k, pre), _asking(queries), []
            if top is not None:
                at = asking(cell.as_py())
                if at is None or len(at):
                    top.add(_decoded(rows, kind), at)
    if top is not None:
        yield top.rows()


_FOUND = "query string, query_owner string, cand string, cand_owner string, similarity double, equal string"


def _ranked(found: DataFrame, k: int, pre: bool) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "cand")
    if pre:
        top = found.where("query <> cand and query_owner <> cand_owner").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    else:
        cut = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        top = cut.where("query <> cand and query_owner <> cand_owner").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query", "cand", F.col("rank").cast("long").alias("rank"), "similarity")


def _classes(v: DataFrame, k: int, pre: bool) -> tuple[DataFrame, DataFrame | None]:
    """Candidates, one for each vector that occurs, and the rows to show for those that occur repeatedly.

    v: uid, owner, vector. A candidate's uid is the least that a query it is for can have of it, so
    ties go the same way as with single rows. Before other owners' rows (pre) a vector of several
    owners is two candidates: one of its first owner's rows and all others for everybody else, and
    one of the others for that owner. Equal vectors are told by a digest of 256 bits.
    """
    named = v.withColumn("equal", F.sha2("vector", 256))
    held = stored(named.groupBy("equal").agg(F.count("*").alias("n"), F.min(F.struct("uid", "owner")).alias("first"), F.any_value("vector").alias("vector")), "classes")
    many = held.where("n > 1").select("equal")
    if many.isEmpty():
        return v.select("*", F.lit(None).cast("string").alias("equal"), F.lit(1).cast("long").alias("sure"), F.lit(False).alias("own")), None
    mark, sure = F.when(F.col("n") > 1, F.col("equal")).alias("equal"), lambda c: F.least(F.lit(k + 1), c).cast("long").alias("sure")
    rows = named.select("equal", "uid", "owner")
    if not pre:
        out = held.select("first.uid", "first.owner", "vector", mark, sure(F.col("n")), F.lit(False).alias("own"))
    else:
        owners = stored(rows.groupBy("equal", "owner").agg(F.min("uid").alias("uid"), F.count("*").alias("c")), "owners")
        place = F.row_number().over(Window.partitionBy("equal").orderBy("uid", "owner"))
        second = owners.withColumn("r", place).where("r <= 2").groupBy("equal").agg(F.max(F.when(F.col("r") == 1, F.col("c"))).alias("c"), F.max(F.when(F.col("r") == 2, F.col("uid"))).alias("second"))
        most = owners.groupBy("equal").agg(F.max("c").alias("most"))
        known = stored(held.join(second, "equal").join(most, "equal"), "known")
        others = F.when(F.col("second").isNull(), F.col("n")).otherwise(F.col("n") - F.col("most"))
        out = known.select("first.uid", "first.owner", "vector", mark, sure(others), F.lit(False).alias("own")).unionByName(
            known.where("second is not null").select(F.col("second").alias("uid"), "first.owner", "vector", mark, sure(F.col("n") - F.col("c")), F.lit(True).alias("own"))
        )
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("equal", "owner").orderBy("uid"))).where(F.col("r") <= k + 1).drop("r")
    # k + 1 of one owner at most, so twice as many leave k + 1 to any owner
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("equal").orderBy("uid"))).where(F.col("r") <= (2 if pre else 1) * (k + 1))
    shown = rows.join(many, "equal", "left_semi").select("equal", F.col("uid").alias("shown"), F.col("owner").alias("shown_owner"))
    return out, stored(shown, "shown")


def _dealt(q: DataFrame, cands: DataFrame, blocks: int) -> DataFrame:
    """For each block of queries a partition: qb, side, pack and its list (cell); its queries before all candidates, those by list, if they have one, and in the order of their uids."""
    left = q.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("qb"), *q.columns).mapInArrow(_packs, _PACKED)
    lists = [c for c in cands.columns if c == "cell"]
    order = [*lists, "uid", "owner"]
    right = cands.repartitionByRange(*order).sortWithinPartitions(*order).select((F.col("cell") if lists else F.lit(0)).alias("qb"), *[c for c in cands.columns if c != "cell"]).mapInArrow(_packs, _PACKED)
    right = right.withColumnRenamed("qb", "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = left.withColumns({"cell": F.lit(0), "side": F.lit(0)}).unionByName(right.withColumn("side", F.lit(1)))
    return both.repartitionById(blocks, F.col("qb")).sortWithinPartitions("qb", "side", "cell", "uid", "owner").select("qb", "side", "pack", "cell")


def _sent(rows: DataFrame, centres: np.ndarray, probes: int, kind: str) -> DataFrame:
    """rows uid, owner, vector, … with `cells`: the lists whose centres are nearest to the vector."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                near = np.argsort(-(_matrix(part.column(2), kind) @ held.value.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def nearest(vectors: DataFrame, topk: int, filter_mode: str = "post", queries: DataFrame | None = None) -> DataFrame:
    """query, cand, rank and cosine similarity of the topk nearest vectors of each query.

    vectors: uid, owner (rows of one owner never match each other), embedding. filter_mode
    "post" takes the topk + 1 nearest and then drops the query itself and its owner's rows;
    "pre" drops them first. Similarities are rounded to DIGITS, ties go by uid. A task holds
    one block of queries and the names and best of what passed by; every vector is shuffled,
    packed with its neighbours in order, once per block of queries: WAVES blocks for each core, more beyond
    MOST_QUERIES each, and each block is a task of its own. All pairs
    are compared, so the work is that of n * n products of 32-bit vectors, whatever else grows less;
    rows of one vector are one candidate, so copies cost no more than their number.
    Vectors of another length than the rest are an error; null ones and those of null are left out.
    """
    return _searched(vectors, topk, filter_mode, queries)


def _searched(vectors: DataFrame, topk: int, filter_mode: str, queries: DataFrame | None, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The search of nearest, and, with centres, that of nearest_by_lists."""
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    coded = lambda df: df.where("embedding is not null").select("uid", "owner", F.col("embedding").cast("array<double>" if kind == "float64" else "array<float>")).mapInArrow(lambda it: _coded(it, kind), "uid string, owner string, vector binary")
    v = stored(coded(vectors), "vectors")
    q = v if queries is None else stored(coded(queries), "queries")
    asked, cores = q.count(), v.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // min(MOST_QUERIES, max(LEAST_QUERIES, -(-asked // (WAVES * cores))))))
    if blocks > cores:
        blocks = -(-blocks // cores) * cores  # as many for each core
    pre = filter_mode == "pre"
    cands, shown = _classes(v, topk, pre)
    if centres is not None:
        # lists pass one after the other; ties still go by uid
        placed = cands.repartitionByRange("uid", "owner").sortWithinPartitions("uid", "owner").withColumn("place", F.monotonically_increasing_id())
        cands = _sent(placed, centres, 1, kind).withColumn("cell", F.element_at("cells", 1)).drop("cells")
        q = _sent(q, centres, probes, kind)
    dealt = _dealt(q, cands, blocks)
    found = dealt.mapInArrow(lambda it: _streamed(it, topk, pre, kind), _FOUND)
    if shown is not None:
        found = found.join(broadcast_if_small(shown, BROADCAST_ROWS), "equal", "left")
        found = found.withColumn("cand", F.coalesce("shown", "cand")).withColumn("cand_owner", F.when(F.col("shown").isNotNull(), F.col("shown_owner")).otherwise(F.col("cand_owner")))
    return _ranked(found, topk, pre)


def centroids(vectors: DataFrame, lists: int, train_rows: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """Unit centroids of spherical k-means on a hash sample of at most train_rows vectors."""
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64("uid", F.lit(seed)), "uid").limit(train_rows).select(F.col("embedding").cast("array<double>")).toArrow().column(0).combine_chunks()
    x = _unit(sample)
    c = x[np.random.RandomState(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > EPSILON, sums / np.maximum(size, EPSILON), c)
    return c


def nearest_by_lists(vectors: DataFrame, topk: int, lists: int, probes: int, train_rows: int = 200_000, filter_mode: str = "post", least: int = LEAST_INDEXED, queries: DataFrame | None = None) -> DataFrame:
    """Like nearest, but each query only meets the vectors of its `probes` nearest lists.

    Falls back to nearest below max(least, 10 * lists) vectors. Every vector is indexed; the
    centroids (lists times the vector length, a stated size) come from a bounded sample. Queries are
    dealt in blocks as by nearest, not by list, and a task keeps the best of each of its queries over all
    lists that pass by: so a query has k + 1 rows at most, however many lists it looks at and however long
    they are, and a large list is no larger task.
    """
    known = vectors.where("embedding is not null")
    if known.count() < max(least, 10 * lists):
        return nearest(vectors, topk, filter_mode, queries)
    return _searched(vectors, topk, filter_mode, queries, centroids(known, lists, train_rows), probes)
