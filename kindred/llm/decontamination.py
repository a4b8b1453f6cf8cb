"""Benchmark decontamination: prefix-filtered containment join of item windows and documents.

A window is `window` consecutive words of an item (an item of fewer words, but not none, is
one window). It is taken as the set of its shingles: SHINGLE consecutive words, or all words
of a shorter window. A document contains a window only if it contains all of its shingles, so
the necessary prefix of a window, in the order of rarity in the documents, is one shingle: the
rarest. Windows with a shingle that no document has are dropped.

 1. Words of the documents are stored once, joined by single spaces.
 2. Shingles that occur in windows are counted over all documents.
 3. Each window's rarest shingle meets the documents' shingles. The window's offset and length
    bound the place: starts before the first word and ends after the last are ruled out.
 4. The words at that place are compared with whole windows.

Shingles meet as hashes, so counts and candidates may be too many, never too few; what decides
is the comparison of words. Both joins broadcast blocks of BLOCK_WINDOWS windows at most, one
block after the other if there are more. No text is shuffled.

All steps are DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import scratched, stored

#: Consecutive item words that make a window, and words of a shingle.
WINDOW, SHINGLE = 10, 3
#: Windows that are broadcast at once (about 500 bytes each, with their shingles).
BLOCK_WINDOWS = 100_000
#: Documents with hits, or owners of windows, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "cast(array() as array<bigint>)"


def words_of(text: str) -> Column:
    """Words of a text column: runs of digits, letters a-z (A-Z in lower case) and non-ASCII signs."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles_of(words: str, size: int) -> str:
    """SQL for the hashes of all shingles of so many words, in their order."""
    at = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(size))
    return f"if(size({words}) < {size}, {_NONE}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({at})))"


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item and words (array) of every window; repeated windows of an item count once."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(text_col).alias("words")).where("size(words) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(size(words) - {int(window)}, 0)), i -> slice(words, i + 1, {int(window)}))")
    return items.select("item", F.explode(cut).alias("words")).distinct()


def _shingles(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """pos and g of every shingle of the documents in rows, with columns of the document; nulls for none."""
    words = rows.where("n > 0").select("rid", F.split("words", " ", -1).alias("words"))
    # hashes are a column of their own, so that code is generated from the generator to the join:
    # it then takes the words by reference, and does not copy them for each position. The outer
    # form keeps the optimiser from inferring a filter that computes all hashes once more
    return words.withColumn("gs", F.expr(shingles_of("words", size))).select(*columns, F.posexplode_outer("gs").alias("pos", "g"))


def _prefixes(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """g, size, off and len of the prefixes of a block of windows that the documents may hold.

    windows: window, words, size (words of its shingles).
    """
    cases = " ".join(f"when {k} then {shingles_of('words', k)}" for k in sizes)
    parts = windows.select("window", "size", F.size("words").alias("len"), F.posexplode(F.expr(f"case size {cases} end")).alias("off", "g"))
    counts = None
    for k in sizes:
        wanted = F.broadcast(parts.where(F.col("size") == k).select("g").distinct())
        met = _shingles(rows, k, "rid").join(wanted, "g").groupBy("g").agg(F.count("*").alias("found")).select(F.lit(k).alias("size"), "g", "found")
        counts = met if counts is None else counts.unionByName(met)
    ranked = parts.join(counts, ["size", "g"], "left").groupBy("window", "size", "len")
    rarest = ranked.agg(F.min(F.coalesce("found", F.lit(0))).alias("least"), F.min(F.struct("found", "g", "off")).alias("top"))
    return rarest.where("least > 0").select("size", "top.g", "top.off", "len").distinct()


def _hits(rows: DataFrame, windows: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """rid, start, len and window (its number) of every occurrence of a block's windows."""
    out = None
    for k in sizes:
        met = _shingles(rows, k, "rid", "words").join(F.broadcast(prefixes.where(F.col("size") == k).drop("size")), "g")
        met = met.withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + len <= size(words)")
        met = met.select("rid", "start", "len", F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("len"))).alias("text"))
        out = met if out is None else out.unionByName(met)
    return out.join(broadcast_if_small(windows.select("window", "text"), BLOCK_WINDOWS), "text").select("rid", "start", "len", "window")


@scratched
def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, n_hit, items (sorted array of item ids as strings).

    n_hit: words inside an occurrence of any window. Null and empty texts have no words.
    Every row is judged by its own text, with repeated or null ids too; items without id
    count for n_hit and are not listed. An empty benchmark hits nothing. Texts are read
    whole; other columns are not read. What one document gathers is bounded by its own words
    (starts of windows) and by its result (items).
    """
    owned = stored(item_windows(benchmark, window, item_col, item_text_col).withColumn("text", F.concat_ws(" ", "words")), "owners")
    distinct = owned.select("text", "words").distinct().select(F.monotonically_increasing_id().alias("window"), "text", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("size"))
    windows = stored(distinct, "windows")
    n = windows.count()
    words = documents.select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    rows = stored(words.select(F.monotonically_increasing_id().alias("rid"), F.array_join("words", " ").alias("words"), "id", F.size("words").cast("long").alias("n")), "words")
    found, blocks = [], -(-n // BLOCK_WINDOWS)
    for b in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else windows
        sizes = [r[0] for r in block.select("size").distinct().orderBy("size").collect()]  # SHINGLE rows at most
        if sizes:
            prefixes = stored(_prefixes(rows, block, sizes), "prefixes")
            found.append(stored(_hits(rows, block, prefixes, sizes), "hits"))
    empty = documents.sparkSession.createDataFrame([], "rid long, start int, len int, window long")
    hits = empty
    for f in found:
        hits = hits.unionByName(f)
    # covered words: the sum of what each occurrence adds to those that start before it
    step = "(a, c) -> named_struct('sum', a.sum + greatest(0, c.end - greatest(c.start, a.at)), 'at', greatest(a.at, c.end))"
    spans = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    covered = spans.select("rid", F.expr(f"aggregate(spans, named_struct('sum', 0, 'at', 0), {step}, a -> cast(a.sum as bigint))").alias("n_hit"))
    owners = owned.where("item is not null").join(windows.select("text", "window"), "text").select("window", F.col("item").cast("string").alias("item"))
    owners = stored(owners, "owners")
    items = hits.select("rid", "window").distinct().join(broadcast_if_small(owners, BROADCAST_ROWS), "window").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = stored(covered.join(items, "rid", "left"), "told")
    out = rows.select("rid", "id", "n").join(broadcast_if_small(told, BROADCAST_ROWS), "rid", "left")
    none = F.expr("cast(array() as array<string>)")
    return stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")), "contamination")
