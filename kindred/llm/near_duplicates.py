"""Near-duplicate detection on word shingles: fast similarity sketches, banding, exact links.

A sketch has BANDS * ROWS bins. In round r every shingle is hashed to a bin and leaves the
value (r, hash) there if that is the smallest yet; rounds go on until every bin is filled,
and rounds from the number of bins on put all shingles in one given bin each, so that every
coordinate fills. Equal coordinates estimate the Jaccard similarity with concentration.
Bands of ROWS coordinates are buckets; what meets in a bucket is verified on full sets.

Copies of one shingle set form a class first (one group-by); only the row with the smallest
id goes on. In each bucket everyone is compared with the bucket's smallest member (stars), and
the links that hold are merged to components. Buckets that still hold several components go
through rounds: some members outside the bucket's largest component are centres, these are
compared with all members of other components and leave the bucket, components are merged
again. Their number grows from round to round, so every pair of different components of a
bucket is compared in the end, and no pair of one component ever is: a bucket of n joined
members and k strangers costs k * n comparisons. Where k is large (CROWDED), the members are
dealt to buckets of their rarest shingles first, which lose no link. Of the pairs an odd sketch rules out those
that can't be similar: it has the parity of the shingles hashed to each of ODD_BITS bits, so
two sketches differ in at most as many bits as the sets differ in shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import map_batches
from kindred.operators.graph import connected_components
from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import drop, scratched, stored


@dataclass(frozen=True)
class NearDuplicates:
    """shingle: words of a shingle; percent: links need 100 * intersection >= percent * union.

    With 24 bands of 4 rows a pair of similarity 0.85 shares no band with a probability of
    2e-8, one of 0.8 with 3e-6.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4


#: Bits of the odd sketch; a multiple of 64.
ODD_BITS = 1024
#: Centres of a bucket in the first round, about, and how many times more there are in the next one.
CENTRES, GROWTH = 8, 8
#: Members outside a bucket's largest component beyond which they are dealt by their rarest shingles.
CROWDED = 512
#: Rows of classes, components or centres (at most 250 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000

_MULTIPLIERS = (np.random.RandomState(11).randint(0, 2**62, 64, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    Words: runs of anything but ASCII white space, A-Z in lower case. Fewer than k words are
    one shingle; no words are none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ w[j : n - size + 1 + j]) * _MULTIPLIERS[j % len(_MULTIPLIERS)]
        h ^= h >> np.uint64(31)
    return np.unique(h)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches of several sets: len(sets) by bins; empty sets stay at the maximum."""
    n = len(sets)
    out = np.full(n * bins, _FULL, np.uint64)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for r in range(2 * bins):
        if not len(values):
            break
        x = _mixed(values ^ _mixed(np.uint64(r + 1) * np.ones(1, np.uint64)))
        at = ((x >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, owner * bins + at, (np.uint64(r) << np.uint64(48)) | (x & np.uint64(0xFFFFFFFFFFFF)))
        open_ = (out.reshape(n, bins) == _FULL).any(1)
        keep = open_[owner]
        values, owner = values[keep], owner[keep]
    return out.reshape(n, bins)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of several sets, as len(sets) rows of 64-bit words."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (_mixed(np.concatenate(sets) ^ np.uint64(0x5DEECE66D)) % np.uint64(ODD_BITS)).astype(np.int64)
    parity = np.bincount(owner * ODD_BITS + bit, minlength=len(sets) * ODD_BITS).reshape(len(sets), ODD_BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)


def _describe(b: pa.RecordBatch, p: NearDuplicates) -> pa.RecordBatch:
    sets = [shingle_set(t, p.shingle) for t in b.column(1).to_pylist()]
    sketch = sketches(sets, p.bands * p.rows).reshape(len(sets), p.bands, p.rows)
    band = np.arange(1, p.bands + 1, dtype=np.uint64) * np.ones((len(sets), 1), np.uint64)
    for j in range(p.rows):
        band = _mixed((band ^ sketch[:, :, j]) * _MULTIPLIERS[j])
    counts = np.array([len(s) for s in sets], np.int64)
    has = counts > 0
    ends = np.concatenate([[0], np.cumsum(has * p.bands)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[has].ravel().view(np.int64)))
    keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    odd = odd_sketches(sets)
    words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * odd.shape[1]), pa.array(odd.ravel()))
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(keys, pa.binary()), lists, words], names=["id", "n", "set_key", "bands", "odd"])


def _sets(b: pa.RecordBatch, p: NearDuplicates) -> pa.RecordBatch:
    sets = [shingle_set(t, p.shingle) for t in b.column(1).to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "members"])


def _possible(x: str, y: str, p: NearDuplicates):
    """Sizes so different that no overlap suffices are ruled out."""
    return F.lit(100) * F.least(x, y) >= F.lit(p.percent) * F.greatest(x, y)


def _near(x: str, y: str, nx: str, ny: str, p: NearDuplicates):
    """Odd sketches don't differ in more bits than two sets that are similar enough may differ
    in shingles: (100 + percent) * difference <= (100 - percent) * (size + size)."""
    bits = F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(ODD_BITS // 64)))
    return F.lit(100 + p.percent) * bits <= F.lit(100 - p.percent) * (F.col(nx) + F.col(ny))


def _links(pairs: DataFrame, sets: DataFrame, p: NearDuplicates, *more: str) -> DataFrame:
    """Of pairs (x, y, and more columns) those whose full sets are similar enough. The side with few,
    much-used sets comes last: its join is on y, where adaptive execution may split the other side."""
    left = sets.select(F.col("id").alias("x"), F.col("members").alias("mx"))
    right = sets.select(F.col("id").alias("y"), F.col("members").alias("my"))
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("mx", "my"))
    return both.where(F.lit(100) * common >= F.lit(p.percent) * (F.size("mx") + F.size("my") - common)).select("x", "y", *more)


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """Members (band, component, ...) of the buckets with several components, with the bucket's
    largest component as `main` and the number of members outside it."""
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("m"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("m", "component")).alias("top"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
    bands = stored(bands.select("band", F.col("top.component").alias("main"), "outside"), "mixed")
    return placed.join(broadcast_if_small(bands, BROADCAST_ROWS), "band")


def centres_of(rest: DataFrame, round_: int) -> DataFrame:
    """The members of mixed buckets that are compared with all others in this round.

    They are drawn by a hash from the members outside the largest component, about
    CENTRES * GROWTH ** round_ in each bucket, or all if there are no more.
    """
    return rest.where(_drawn(round_))


def _drawn(round_: int):
    """Whether a member of a mixed bucket is a centre of this round; its own columns tell."""
    luck = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(1 << 30)) / float(1 << 30)
    return (F.col("component") != F.col("main")) & (luck * F.col("outside") < float(CENTRES * GROWTH**round_))


def pairs_of(rest: DataFrame, centres: DataFrame, p: NearDuplicates) -> DataFrame:
    """Pairs (x, y) of a centre y and a member x of another component in one of its buckets, with
    their components cx and cy, that sizes and odd sketches don't rule out."""
    one = rest.select("band", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("odd").alias("ox"))
    two = centres.select("band", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("odd").alias("oy"))
    apart = (F.col("cx") != F.col("cy")) & _possible("nx", "ny", p) & _near("ox", "oy", "nx", "ny", p)
    return one.join(broadcast_if_small(two, BROADCAST_ROWS), "band").where(apart).select("x", "y", "cx", "cy").distinct()


def by_rare_shingles(members: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """Members of crowded buckets (id, n, component, odd) in buckets of their rarest shingles instead.

    Of two sets similar enough, each shares percent / 100 of its shingles with the other; so with
    all shingles in one order, the first n - ceil(n * percent / 100) + 1 of both have one in common.
    The order begins with what the fewest members have: sets that agree in common passages alone don't meet.
    """
    alone = members.dropDuplicates(["id"]).select("id", "n", "component", "odd")
    each = stored(sets.join(alone.select("id"), "id").select("id", F.explode("members").alias("g")), "shingles")
    counts = stored(each.groupBy("g").agg(F.count("*").alias("found")).where("found > 1"), "counts")
    known = each.join(counts, "g", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("found", F.lit(1)).alias("found"), "g"))).alias("order"))  # a document's own shingles
    first = F.expr(f"slice(order, 1, size(order) - cast(ceil(size(order) * {p.percent} / 100.0) as int) + 1)")
    buckets = known.select("id", F.explode(first).alias("s")).where("s.found > 1").select(F.col("s.g").alias("band"), "id")
    out = stored(buckets.join(alone, "id").select("band", "id", "n", "component", "odd"), "rare")
    drop(each, counts)
    return out


def _joined(merged: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component after components were linked by edges (cx, cy)."""
    found = connected_components(edges, "cx", "cy").select(F.col("node").alias("old"), F.col("component").alias("new"))
    found = stored(found, "contracted")
    moved = merged.join(broadcast_if_small(found, BROADCAST_ROWS), merged.component == found.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    single = found.join(merged, found.old == merged.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    out = stored(moved.union(single), "components")
    drop(found)
    return out


@scratched
def near_duplicate_components(documents: DataFrame, p: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles long, component_id (the smallest id reachable over links), kept boolean.

    Defined results: null, empty and blank texts have no shingles, link with nothing and are
    kept. Ids are meant to be unique: of an id with several texts every row follows the class
    of its own text, and repeated rows are all marked alike. A row without id links with
    nothing, has no component and is kept. Columns besides these two are not read.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    told = stored(map_batches(source, lambda b: _describe(b, p), f"id {kind}, n long, set_key binary, bands array<long>, odd array<long>"), "sketches")
    keyed = told.where("set_key is not null and id is not null")
    # classes of one row are not joined with anything
    classes = stored(keyed.groupBy("set_key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1").select("set_key", "class_id"), "classes")
    first = keyed.join(broadcast_if_small(classes, BROADCAST_ROWS), "set_key", "left").where("class_id is null or id = class_id").select("id", "n", "bands", "odd")
    banded = first.select("id", "n", F.explode("bands").alias("band")).dropDuplicates(["band", "id"])
    # stored, so that its join has a shuffle on both sides and large buckets can be split
    centres = stored(banded.groupBy("band").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1").select("band", "centre"), "centres")
    buckets = stored(banded.join(centres, "band"), "buckets")
    wanted = buckets.select("id").distinct()
    sets = stored(map_batches(source.join(wanted, "id", "left_semi"), lambda b: _sets(b, p), f"id {kind}, members array<long>"), "sets")

    centre_sizes = buckets.where("id = centre").select("band", F.col("n").alias("centre_n"))
    stars = buckets.where("id <> centre").join(centre_sizes, "band").where(_possible("n", "centre_n", p)).select(F.col("id").alias("x"), F.col("centre").alias("y")).distinct()
    stars = stored(stars, "stars")
    links = stored(_links(stars, sets, p), "links")
    merged = stored(connected_components(links, "x", "y"), "components")

    odd = first.select("id", "odd").dropDuplicates(["id"])
    placed = buckets.join(merged, buckets.id == merged.node, "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    rest = stored(mixed_buckets(placed).join(odd, "id"), "rest")
    crowded = rest.where(F.col("outside") > CROWDED)
    if not crowded.isEmpty():
        again = by_rare_shingles(crowded, sets, p)
        columns = again.columns
        step = stored(mixed_buckets(rest.where(F.col("outside") <= CROWDED).select(*columns).union(again)), "rest")
        drop(rest, again)
        rest = step
    round_ = 0
    while not rest.isEmpty():
        chosen = stored(centres_of(rest, round_), "chosen")
        pairs = pairs_of(rest, chosen, p).join(stars, ["x", "y"], "left_anti")
        more = stored(_links(pairs, sets, p, "cx", "cy").select("cx", "cy").distinct(), "links")
        left = rest.where(~_drawn(round_))
        if not more.isEmpty():
            after = _joined(merged, more)
            left = left.join(after.withColumnRenamed("component", "now"), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("now", "component"))
            drop(merged)
            merged = after
        step = stored(mixed_buckets(left.select("band", "id", "n", "component", "odd")), "rest")
        drop(rest, chosen, more)
        rest, round_ = step, round_ + 1
    of_class = stored(classes.join(merged, classes.class_id == merged.node, "left").select("set_key", F.coalesce("component", "class_id").alias("of_class")), "classes")
    out = told.select("id", "n", "set_key").join(broadcast_if_small(of_class, BROADCAST_ROWS), "set_key", "left")
    out = out.join(broadcast_if_small(merged, BROADCAST_ROWS), (out.id == merged.node) & out.of_class.isNull(), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("of_class", F.when(F.col("set_key").isNotNull(), F.col("component")), "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return stored(out, "near-duplicates")
