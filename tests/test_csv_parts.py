"""CSV files of whole tables: several tasks write them, and the readers take them like one file."""

from pathlib import Path

from kindred import catalogue, schema
from kindred.plans import sinks
from kindred.sources import tables


def test_no_task_writes_all_rows(spark):
    ids = spark.range(4000).repartition(4).selectExpr("concat('group_', id) as group_id", "id as group_size", "'d' as dataset", "case when id % 3 = 0 then '' else 'a \"b\", c' end as subject_id", "'k' as subject_key")
    path = catalogue._csv(ids)
    files = [f for f in Path(path.removeprefix("file:")).iterdir() if f.suffix == ".csv"]
    assert len(files) > 1 and max(len(f.read_text().splitlines()) for f in files) < 2000
    assert sorted(map(tuple, tables.read_groups(spark, path).collect())) == sorted(map(tuple, ids.collect()))


def test_order_and_no_rows(spark, tmp_path):
    rows = spark.range(1000).repartition(4).selectExpr("lpad(id, 4, '0') as resolved_path")
    path = sinks.write_csv_parts(rows, str(tmp_path / "some.csv"), ("resolved_path",))
    lines = [x for f in sorted(Path(path).glob("part-*.csv")) for x in f.read_text().splitlines()[1:]]
    assert lines == [f"{i:04d}" for i in range(1000)]
    empty = sinks.write_csv_parts(schema.empty(spark, schema.GROUPS), str(tmp_path / "none.csv"))
    assert tables.read_groups(spark, empty).count() == 0
