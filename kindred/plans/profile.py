"""Nested timers of pipeline stages, as tables: time and CPU of the driver, and what Spark's tasks took.

With a session, a stage's jobs carry a group of their own; at its end their numbers are read from
Spark's status store, which every application keeps. A stage's numbers include those of the stages
inside it. The store forgets the oldest stages beyond spark.ui.retainedStages.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "run_id string, stage_order int, stage_name string, parent_stage string, depth int, status string, error string, n_input long, n_output long, wall_time_s double, cpu_user_s double, cpu_sys_s double, cpu_total_s double, gpu_time_s double, notes_json string"
#: What tasks took and moved, by column and name in Spark's status store, with a factor.
TASKS = {
    "executor_cpu_s": ("executorCpuTime", 1e-9), "executor_run_s": ("executorRunTime", 1e-3), "rows_read": ("inputRecords", 1), "bytes_read": ("inputBytes", 1), "rows_written": ("outputRecords", 1),
    "bytes_written": ("outputBytes", 1), "shuffle_rows": ("shuffleWriteRecords", 1), "shuffle_bytes": ("shuffleWriteBytes", 1), "spilled_bytes": ("diskBytesSpilled", 1), "n_tasks": ("numCompleteTasks", 1),
}
TASK_COLUMNS = ", ".join(f"{c} {'double' if c.endswith('_s') else 'long'}" for c in TASKS)


@dataclass
class Record:
    run_id: str
    stage_order: int
    stage_name: str
    parent_stage: str
    depth: int
    status: str = "running"
    error: str = ""
    n_input: int | None = None
    n_output: int | None = None
    wall_time_s: float = 0.0
    cpu_user_s: float = 0.0
    cpu_sys_s: float = 0.0
    cpu_total_s: float = 0.0
    gpu_time_s: float = 0.0
    notes: dict = field(default_factory=dict)
    tasks: dict = field(default_factory=dict)


def task_numbers(spark: SparkSession, group: str) -> dict[str, float]:
    """TASKS summed over the stages that jobs of a group ran."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    store, seen, out = sc.statusStore(), set(), dict.fromkeys(TASKS, 0)
    jobs = store.jobsList(None)
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if job.jobGroup().isDefined() and job.jobGroup().get() == group:
            seen.update(job.stageIds().apply(k) for k in range(job.stageIds().size()))
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    for i in range(stages.size()):
        stage = stages.apply(i)  # every attempt
        if stage.stageId() in seen:
            for c, (name, factor) in TASKS.items():
                out[c] += getattr(stage, name)() * factor
    return out


class Profiler:
    """Times stages of the driver program; cpu_* is that of the driver and its children, the columns of TASKS are the executors'."""

    def __init__(self, run_id: str | None = None, spark: SparkSession | None = None):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex[:12]
        self.started = datetime.now(timezone.utc).isoformat(timespec="seconds")
        self.records: list[Record] = []
        self._open: list[Record] = []
        #: One entry per embedding run: numbers by name.
        self.embedding_detail: list[dict] = []

    @contextmanager
    def stage(self, name: str, n_input: int | None = None, n_output: int | None = None, **notes):
        import os

        r = Record(self.run_id, len(self.records), name, self._open[-1].stage_name if self._open else "", len(self._open), n_input=n_input, n_output=n_output, notes=notes)
        self.records.append(r)
        self._open.append(r)
        wall, cpu = time.time(), os.times()
        group, outer = f"{self.run_id}-{r.stage_order}", None
        if self.spark:
            outer = self.spark.sparkContext.getLocalProperty("spark.jobGroup.id")
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", group)
        try:
            yield r
            r.status = "ok"
        except BaseException as e:
            r.status, r.error = "failed", f"{type(e).__name__}: {e}"
            raise
        finally:
            now = os.times()
            r.wall_time_s = time.time() - wall
            r.cpu_user_s = now.user - cpu.user + now.children_user - cpu.children_user
            r.cpu_sys_s = now.system - cpu.system + now.children_system - cpu.children_system
            r.cpu_total_s = r.cpu_user_s + r.cpu_sys_s
            self._open.pop()
            if self.spark:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", outer)
                for c, v in task_numbers(self.spark, group).items():
                    for of in (r, *self._open):
                        of.tasks[c] = of.tasks.get(c, 0) + v

    def stages(self, spark: SparkSession) -> DataFrame:
        columns = f"{COLUMNS}, {TASK_COLUMNS}"
        rows = [asdict(r) | {"notes_json": json.dumps(r.notes, sort_keys=True, default=str)} | {c: float(v) if c.endswith("_s") else int(v) for c, v in r.tasks.items()} for r in self.records]
        return spark.createDataFrame([tuple(row.get(c.split()[0]) for c in columns.split(", ")) for row in rows], columns)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: the stage total_pipeline if it ran, else the sum of the outermost stages; GPU without the total."""
        top = [r for r in self.records if r.stage_name == "total_pipeline"] or [r for r in self.records if r.depth == 0]
        gpu = sum(r.gpu_time_s for r in self.records if r.stage_name != "total_pipeline")
        row = (self.run_id, self.started, sum(r.wall_time_s for r in top), sum(r.cpu_total_s for r in top), gpu, all(r.status == "ok" for r in self.records))
        return spark.createDataFrame([row], "run_id string, started string, wall_time_s double, cpu_total_s double, gpu_time_s double, ok boolean")

    def details(self, spark: SparkSession) -> DataFrame | None:
        """The embedding runs; columns in the order in which they first occur. None without any."""
        names = list(dict.fromkeys(k for row in self.embedding_detail for k in row))
        if not names:
            return None
        rows = [(self.run_id, i, *[None if row.get(k) is None else str(row[k]) for k in names]) for i, row in enumerate(self.embedding_detail)]
        return spark.createDataFrame(rows, ", ".join(["run_id string", "run_order int", *[f"`{k}` string" for k in names]]))

    def save(self, spark: SparkSession, out_dir: str) -> None:
        from kindred.plans.sinks import write_csv

        write_csv(self.stages(spark), f"{out_dir}/perf_stage_breakdown.csv", ("stage_order",))
        write_csv(self.summary(spark), f"{out_dir}/perf_run_summary.csv")
        if (details := self.details(spark)) is not None:
            write_csv(details, f"{out_dir}/perf_near_embedding_detail.csv", ("run_order",))
