"""URL filter lists over time: validity intervals and an as-of join with captures.

List entries are dated: an entry is added, may be removed and added again. Each entry's
history becomes intervals [since, until) in which it is active. A capture is evaluated
against the entries active when it was fetched: its URL gives the keys an entry could have
(its host, every parent domain, every path prefix), these meet the intervals by equality of
key, and the interval must hold the time.

All steps are DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.plans.sizes import broadcast_if_small
from kindred.plans.stored import scratched, stored

#: Intervals that are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_INTERVALS = 200_000
KINDS = ("host", "domain", "prefix")


def host_of(url: str) -> Column:
    """Host of a URL in lower case, without user, port and final dot; "" if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("."))


def path_of(url: str) -> Column:
    """Path of a URL as written, without its first slash, query and fragment."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, kind, value, since, until (null: still active) of dated entries.

    entries: list, kind (host, domain or prefix), value, action (add or remove), at.
    Of several actions on one entry at one time a removal holds. A removal of what isn't
    active does nothing; a second addition changes nothing. Entries with nulls are ignored.
    """
    known = entries.select("list", "kind", F.col("value"), "action", "at").where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")).dropna()
    known = known.groupBy("list", "kind", "value", "at").agg(F.max("action").alias("action"))
    history = Window.partitionBy("list", "kind", "value").orderBy("at")
    changes = known.withColumn("before", F.lag("action").over(history)).where("action <> coalesce(before, 'remove')")
    spans = changes.withColumn("until", F.lead("at").over(history)).where("action = 'add'")
    return spans.select("list", "kind", "value", F.col("at").alias("since"), "until")


def capture_keys(url: str, labels: int, segments: int) -> Column:
    """Keys (kind:value) that an entry matching a URL can have.

    labels, segments: the longest domain and path that any entry has; longer ones can't match.
    """
    host, path = host_of(url), path_of(url)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    first = F.greatest(n - F.lit(labels), F.lit(0))
    domains = F.when(first < n, F.transform(F.sequence(first, n - 1), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(parts, i + 1, n), "."))))
    steps = F.split(path, "/")
    last = F.least(F.size(steps), F.lit(segments))
    prefixes = F.when((last > 0) & (path != ""), F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    empty = F.expr("cast(array() as array<string>)")
    keys = F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), F.coalesce(domains, empty), F.coalesce(prefixes, empty)))
    return F.when(host != "", keys).otherwise(empty)


@scratched
def evaluate_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id_col, host, n_entries (active entries that match) and lists (their sorted names).

    Every capture has one row, repeated and null ids too. A null or malformed URL and a null
    time match nothing. An empty list table matches nothing. Other columns are not read.
    """
    intervals = validity_intervals(entries).withColumn("key", F.concat_ws(":", "kind", "value"))
    spans = stored(intervals.select("kind", "value", "key", "list", "since", "until"), "intervals")
    depth = spans.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("segments")
    ).first()
    # numbers are stored before two branches meet by them: a stage that runs again can give others
    numbered = captures.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("t"))
    rows = stored(numbered, "captures")
    keys = rows.where("t is not null").select("rid", "t", F.explode(capture_keys("url", depth.labels or 0, depth.segments or 0)).alias("key"))
    active = keys.join(broadcast_if_small(spans.select("key", "list", "since", "until"), BROADCAST_INTERVALS), "key").where("since <= t and (until is null or t < until)")
    met = active.groupBy("rid").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("list")).alias("lists"))
    out = rows.select("rid", "id", host_of("url").alias("host")).join(met, "rid", "left")
    none = F.expr("cast(array() as array<string>)")
    return stored(out.select(F.col("id").alias(id_col), "host", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", none).alias("lists")), "evaluated")
