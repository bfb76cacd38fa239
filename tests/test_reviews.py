import math
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import reviews as ops

REVIEWS = "app_id string, user_id string, is_recommended string, hours string"
GAMES = "app_id string, title string, rating string, positive_ratio string"
USERS = "user_id string, products string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def scored(spark):
    def build(reviews, games, users):
        return ops.score_games(
            ops.typed_reviews(frame(spark, reviews, REVIEWS)),
            ops.typed_games(frame(spark, games, GAMES)),
            ops.typed_users(frame(spark, users, USERS)),
        )

    return build


GAME_ROWS = [("g1", "Orchard Run", "Mostly Positive", "0.5"), ("g2", "Deep Lantern", "Mixed", "0.25")]
REVIEW_ROWS = [("g1", "ann", "true", "8"), ("g1", "bob", "false", "4"), ("g2", "bob", "true", "1"), ("g1", "ann", "true", "3")]
USER_ROWS = [("ann", "10"), ("bob", "4")]


def test_counts(spark):
    df = frame(spark, [*REVIEW_ROWS, ("g3", "cy", None, "2")], REVIEWS)
    assert rows(ops.top_games(df)) == [("g1", 3), ("g2", 1), ("g3", 1)]
    assert sorted(rows(ops.sentiment(df)), key=str) == [("false", 1), ("true", 3), (None, 1)]


def test_activity(spark):
    df = frame(spark, REVIEW_ROWS[:3] + [("g9", "bob", "true", "1")], REVIEWS)
    assert sorted(rows(ops.user_activity(df))) == [("ann", 1), ("bob", 3)]
    assert rows(ops.most_active_users(df)) == [("bob", 3), ("ann", 1)]


def test_flags_are_grouped_as_written(spark):
    df = frame(spark, [("1", "u", f, "1") for f in ["true", "True", None, "", "false"]], REVIEWS)
    assert len(rows(ops.sentiment(df))) == 5
    assert rows(ops.app_sentiment(df)) == [("1", 1, 1)]
    assert sorted(rows(ops.sentiment_ratio(df))) == [(False, 4, 0.8), (True, 1, 0.2)]


def test_score(scored):
    first, second = rows(scored(REVIEW_ROWS, GAME_ROWS, USER_ROWS))
    assert first == ("g1", "Orchard Run", "Mostly Positive", 3, 5.0, 0.5, 2, 8.0, pytest.approx(2.5 * math.log(4)))
    assert second == ("g2", "Deep Lantern", "Mixed", 1, 1.0, 0.25, 1, 4.0, pytest.approx(0.25 * math.log(2)))


def test_score_drops_unmatched_and_multiplies_repeats(scored):
    reviews = REVIEW_ROWS + [("g9", "ann", "true", "5"), ("g1", "nobody", "true", "5"), (None, "ann", "true", "5")]
    games = GAME_ROWS + [("g2", "Deep Lantern", "Mixed", "0.75"), ("g2", "Lantern II", "Mixed", "0.5")]
    users = USER_ROWS + [("ann", "40")]
    found = {(r["app_id"], r["title"]): r for r in scored(reviews, games, users).collect()}
    first, second = found[("g1", "Orchard Run")], found[("g2", "Deep Lantern")]
    assert (first["total_recs"], first["positive_recs"]) == (5, 4)
    assert first["avg_hours_played"] == pytest.approx((8 + 8 + 4 + 3 + 3) / 5)
    assert first["avg_user_library_size"] == pytest.approx((10 + 40 + 4 + 10 + 40) / 5)
    assert (second["total_recs"], second["positive_recs"]) == (2, 2)
    assert second["avg_positive_ratio"] == pytest.approx(0.5)
    assert found[("g2", "Lantern II")]["total_recs"] == 1
    assert len(found) == 3


PLAIN_SCORE = """
SELECT app_id, title, rating, count(*), avg(hours), avg(positive_ratio), sum((is_recommended IS NOT DISTINCT FROM 'true')::INT),
       avg(products), avg(hours) * avg(positive_ratio) * ln(count(*) + 1)
FROM reviews JOIN games USING (app_id) JOIN users USING (user_id) GROUP BY app_id, title, rating"""


def test_score_equals_the_plain_join(spark):
    rng = random.Random(5)
    apps, people = [str(i) for i in range(12)], [f"u{i}" for i in range(20)]
    reviews = [
        (
            rng.choice(apps + ["x"]), "u0" if rng.random() < 0.4 else rng.choice(people + ["y"]),
            rng.choice(["true", "false", None, "True"]), rng.choice([str(rng.randint(0, 90)), "abc", None]),
        )
        for _ in range(800)
    ]
    games = [(a, f"t{rng.randint(0, 3)}", "r", rng.choice([str(rng.randint(0, 9)), None])) for a in apps for _ in range(2)]
    users = [(u, rng.choice([str(rng.randint(0, 50)), "?"])) for u in people] + [("u0", "7")]
    tables = {
        "reviews": ops.typed_reviews(frame(spark, reviews, REVIEWS)),
        "games": ops.typed_games(frame(spark, games, GAMES)),
        "users": ops.typed_users(frame(spark, users, USERS)),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    wanted = {row[:3]: row[3:] for row in con.execute(PLAIN_SCORE).fetchall()}
    found = {row[:3]: row[3:] for row in rows(ops.score_games(*tables.values()))}
    assert set(found) == set(wanted)
    for key, values in wanted.items():
        assert found[key] == tuple(v if v is None else pytest.approx(v) for v in values)


def test_bad_numbers_become_null(spark):
    df = ops.typed_reviews(frame(spark, [("1", "u", "true", "abc"), ("1", "u", "true", "1.5")], REVIEWS))
    assert [r["hours"] for r in df.collect()] == [None, 1.5]


def test_topk(scored):
    top = rows(ops.scored_games_topk(scored(REVIEW_ROWS, GAME_ROWS, USER_ROWS), k=1))
    assert [(r[0], r[2]) for r in top] == [("g1", 1)]


@pytest.mark.parametrize("ranges", [2, 64])
def test_every_scored_game_is_numbered(spark, ranges):
    rng = random.Random(8)
    data = [(f"a{i:04}", "t", "r", rng.choice([None, 1.5, 1.5, rng.random() * 9, -rng.random()])) for i in range(700)]
    numbered = ops.scored_games(frame(spark, data, "app_id string, title string, rating string, weighted_score double"), ranges)
    order = sorted(data, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    assert {r["app_id"]: r["row_number"] for r in numbered.collect()} == {r[0]: i + 1 for i, r in enumerate(order)}


def test_no_game_is_numbered(spark):
    empty = frame(spark, [], "app_id string, title string, rating string, weighted_score double")
    assert ops.scored_games(empty).count() == 0


def test_rank(spark):
    typed = "app_id string, user_id string, is_recommended string, hours float"
    df = frame(spark, [("x", "ann", "true", 7.5), ("y", "ann", "true", 9.0), ("z", "bob", "true", 1.0), ("w", "ann", "true", 7.5), ("v", "ann", "true", 2.0)], typed)
    assert {r["app_id"]: r["rank_in_library"] for r in ops.rank_in_library(df).collect()} == {"y": 1, "x": 2, "w": 2, "v": 4, "z": 1}


def test_rank_equals_a_window(spark):
    rng = random.Random(3)
    special = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, -1.5, -1e-30, 1e-40, 3e38, 1.0, 1.0000001]
    data = [
        (str(i), None if i % 50 == 0 else ("hot" if rng.random() < 0.5 else f"u{rng.randint(0, 5)}"), "true",
         rng.choice(special) if rng.random() < 0.3 else float(rng.randint(0, 4000)) / 8)
        for i in range(3000)
    ]
    df = frame(spark, data, "app_id string, user_id string, is_recommended string, hours float")
    plain = df.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("hours"))))
    wanted = {r["app_id"]: r["r"] for r in plain.collect()}
    ranked = ops.rank_in_library(df).collect()
    assert len(ranked) == len(data)
    assert {r["app_id"]: r["rank_in_library"] for r in ranked} == wanted
