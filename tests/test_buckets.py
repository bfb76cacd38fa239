"""Bucketed tables: the same rows, and no shuffle where their key joins."""

from pyspark.sql import functions as F

from ledgerline.operators import reviews as ops
from ledgerline.sources.buckets import bucketed


def test_join_on_the_bucket_key_has_no_shuffle(spark):
    reviews = spark.range(3000).selectExpr("id % 40 AS app_id", "id % 700 AS user_id", "'true' AS is_recommended", "cast(id % 9 as float) AS hours")
    users = spark.range(690).selectExpr("id AS user_id", "id % 7 AS products")
    games = spark.range(40).selectExpr("id AS app_id", "concat('t', id) AS title", "'r' AS rating", "cast(0.5 as float) AS positive_ratio")
    plain = sorted(map(tuple, ops.score_games(reviews, games, users).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, known = bucketed(reviews, "user_id", 4, "reviews"), bucketed(users, "user_id", 4, "users")
        joined = stored.join(known, "user_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        counted = stored.groupBy("user_id").agg(F.count(F.lit(1)))
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, ops.score_games(stored, games, known).collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
