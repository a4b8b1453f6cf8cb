"""Review decisions as streaming state: what a reviewer's program keeps between two saves.

`autosaved` keeps the newest decision of each pair in state and lets it out after so many updates,
or when it has waited long enough. `flushes` folds the bursts of one reviewer on one pair to the
decision each ended with; `accepted` lets a decision pass only if the revision it was made on is
still the current one.

All three order by (revision, status, reason), never by arrival: late and repeated rows change
nothing that a newer revision has decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = ("path_1", "path_2")
SAVED = "path_1 string, path_2 string, revision long, qa_status string, reason string, n_updates long"
#: A pause that ends a burst of updates.
PAUSE = "300 milliseconds"


def _autosave(every: int, wait_ms: int):
    """State of a pair: its newest decision, and how many updates came since it was let out."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waiting = (tuple(state.get[:3]), state.get[3]) if state.exists else (None, 0)
        if not state.hasTimedOut:
            for part in parts:
                for new in zip(part["revision"].tolist(), part["qa_status"].tolist(), part["reason"].tolist(), strict=True):
                    if best is None or new > best:  # repeated and older rows are no updates
                        best, waiting = new, waiting + 1
        if waiting and (state.hasTimedOut or waiting >= every):
            yield pd.DataFrame([(*key, *best, waiting)], columns=[*PAIR, "revision", "qa_status", "reason", "n_updates"])
            waiting = 0
        state.update((*best, waiting))
        if waiting:  # each new row starts the wait again, as a pause does
            state.setTimeoutDuration(wait_ms)

    return run


def autosaved(updates: DataFrame, every: int, wait_ms: int) -> DataFrame:
    """SAVED: the newest decision of a pair, each time `every` updates have come, or wait_ms after the last of fewer.

    updates: a stream of path_1, path_2, revision, qa_status and reason; null reasons are "". Rows
    without a pair or a revision are left out. Times are those of the machine; a query with such
    timers never ends by itself, with the trigger availableNow neither.
    """
    rows = updates.where("path_1 is not null and path_2 is not null and revision is not null").select(*PAIR, F.col("revision").cast("long"), F.coalesce("qa_status", F.lit("")).alias("qa_status"), F.coalesce("reason", F.lit("")).alias("reason"))
    return rows.groupBy(*PAIR).applyInPandasWithState(_autosave(every, wait_ms), SAVED, "revision long, qa_status string, reason string, unsaved long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def saved(rows: DataFrame) -> DataFrame:
    """The newest of what `autosaved` let out, by pair: replayed batches change nothing."""
    return rows.groupBy(*PAIR).agg(F.max(F.struct("revision", "qa_status", "reason")).alias("d")).select(*PAIR, "d.*")


def flushes(updates: DataFrame, delay: str | None = None, pause: str = PAUSE) -> DataFrame:
    """path_1, path_2, reviewer, base, revision, qa_status, reason, n_updates and ended of each burst of updates.

    updates: path_1, path_2, reviewer, at (time of the update), base (the stored revision it was
    made on), revision (counts the reviewer's own updates of the pair), qa_status and reason. A
    burst ends with a pause in event time. delay: the watermark's, for streams; later rows are dropped.
    """
    rows = updates.withWatermark("at", delay) if delay else updates
    burst = rows.groupBy(F.session_window("at", pause).alias("w"), *PAIR, "reviewer")
    told = burst.agg(F.max(F.struct("revision", F.coalesce("qa_status", F.lit("")).alias("qa_status"), F.coalesce("reason", F.lit("")).alias("reason"))).alias("d"), F.min("base").alias("base"), F.count("*").alias("n_updates"))
    return told.select(*PAIR, "reviewer", "base", F.col("d.revision").alias("revision"), F.col("d.qa_status").alias("qa_status"), F.col("d.reason").alias("reason"), "n_updates", F.col("w.end").alias("ended"))


def accepted(bursts: DataFrame) -> DataFrame:
    """bursts with `stored` (the revision that a burst leads to, null if it is refused).

    Bursts of a pair are taken in the order of (ended, reviewer, revision); one is accepted if its
    base is the pair's current revision, which begins at 0 and grows by one with each accepted
    burst: compare and set. So the n-th accepted burst is the first one, behind the one before it,
    whose base is n. A pair's bursts are folded in one row: as many as reviewers made on it.
    """
    order = F.struct("ended", "reviewer", "revision", "base", "qa_status", "reason", "n_updates")
    rows = bursts.groupBy(*PAIR).agg(F.sort_array(F.collect_list(order)).alias("all"))
    step = (
        "aggregate(all, named_struct('now', 0L, 'out', cast(array() as array<bigint>)), "
        "(x, b) -> if(b.base = x.now, named_struct('now', x.now + 1L, 'out', concat(x.out, array(x.now + 1L))), named_struct('now', x.now, 'out', concat(x.out, array(cast(null as bigint)))))).out"
    )
    each = rows.select(*PAIR, F.explode(F.arrays_zip("all", F.expr(step).alias("stored"))).alias("e"))
    return each.select(*PAIR, "e.all.*", F.col("e.stored").alias("stored"))
