"""What may be broadcast: few rows and few bytes."""

from pyspark.sql import functions as F

from kindred.plans.sizes import broadcast_if_small, is_small


def test_rows_and_bytes_count(spark):
    few = spark.range(10).select("id", F.expr("repeat('x', 1000000)").alias("word"))
    assert is_small(few, 10) and not is_small(few, 9) and not is_small(few, 10, 5 << 20)
    nested = spark.range(3).select(F.expr("array_repeat('y', 1000)").alias("a"), F.expr("cast(null as string)").alias("odd.name"))
    assert is_small(nested, 3) and not is_small(nested, 3, 9000)
    assert is_small(spark.range(0), 0)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in str(plan(broadcast_if_small(few, 10))) or "hint" in plan(broadcast_if_small(few, 10)).lower()
    assert "hint" not in plan(broadcast_if_small(few, 9)).lower()
