"""Centres of a round and what stays are told apart by a row's own columns."""

from kindred.llm import near_duplicates as nd


def test_centres_and_the_rest_are_all(spark):
    rest = spark.range(3000).selectExpr("id % 3 as band", "id", "id div 10 as component", "0L as main", "990L as outside")
    for round_ in range(4):
        centres, left = nd.centres_of(rest, round_), rest.where(~nd._drawn(round_))
        assert centres.union(left).distinct().count() == 3000 == centres.count() + left.count()
        assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert centres.count() == 2990 and left.where("component <> main").count() == 0
