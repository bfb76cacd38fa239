"""Game-review jobs: counts, the three-table score, the rank inside a user's library."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.frames import match_nulls_join
from ledgerline.functions.scalars import to_float, to_long, weighted_score
from ledgerline.operators.leaders import most_frequent
from ledgerline.sources.shared import written


def typed_reviews(raw: DataFrame) -> DataFrame:
    return raw.select("app_id", "user_id", "is_recommended", to_float(F.col("hours")).alias("hours"))


def typed_games(raw: DataFrame) -> DataFrame:
    return raw.select("app_id", "title", "rating", to_float(F.col("positive_ratio")).alias("positive_ratio"))


def typed_users(raw: DataFrame) -> DataFrame:
    return raw.select("user_id", to_long(F.col("products")).alias("products"))


def count_by(df: DataFrame, key: str, count_name="count") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))


def top_games(reviews: DataFrame, count_name="count") -> DataFrame:
    return count_by(reviews, "app_id", count_name).orderBy(F.desc(count_name), "app_id")


def sentiment(reviews: DataFrame) -> DataFrame:
    return count_by(reviews, "is_recommended")


def user_activity(reviews: DataFrame) -> DataFrame:
    return count_by(reviews, "user_id")


def most_active_users(reviews: DataFrame) -> DataFrame:
    return count_by(reviews, "user_id", "review_count").orderBy(F.desc("review_count"), "user_id")


def top_games_topk(reviews: DataFrame, k=100) -> DataFrame:
    """The first k rows of ``top_games``, without a count of every game."""
    return most_frequent(reviews, "app_id", k)


def most_active_users_topk(reviews: DataFrame, k=100) -> DataFrame:
    """The first k rows of ``most_active_users``, without a count of every user."""
    return most_frequent(reviews, "user_id", k, "review_count")


def app_sentiment(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("app_id").agg(
        F.count_if(F.col("is_recommended") == "true").alias("positive_count"),
        F.count_if(F.col("is_recommended") == "false").alias("negative_count"),
    )


def sentiment_ratio(reviews: DataFrame) -> DataFrame:
    """Recommended against all other reviews; at most two rows, so the total is a window over them."""
    recommended = F.coalesce(F.col("is_recommended") == "true", F.lit(False))
    counts = reviews.groupBy(recommended.alias("recommended")).agg(F.count(F.lit(1)).alias("review_count"))
    whole = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "share", F.try_divide(F.col("review_count"), F.sum("review_count").over(whole))
    )


def scored_in_any_order(reviews: DataFrame, games: DataFrame, users: DataFrame) -> DataFrame:
    """Review count, averages and weighted score per game, over reviews with a known game and user.

    Reviews are shuffled once, to meet their users. Both sides of that join are plain shuffles, so a user with
    very many reviews is split by adaptive execution. They are then folded per game before the second shuffle, so a
    hot game is one row per task, and games join last. Repeated users and games multiply the reviews; games are
    folded to one row per title first, and ``copies`` carries that.
    """
    recommended = F.when(F.col("is_recommended") == "true", 1).otherwise(0)
    per_game = (
        reviews.join(users.select("user_id", "products"), "user_id")
        .groupBy("app_id")
        .agg(
            F.count(F.lit(1)).alias("recs"),
            F.sum("hours").alias("hours"),
            F.count("hours").alias("timed"),
            F.sum(recommended).alias("positives"),
            F.sum("products").alias("products"),
            F.count("products").alias("sized"),
        )
    )
    per_title = games.groupBy("app_id", "title", "rating").agg(
        F.count(F.lit(1)).alias("copies"),
        F.avg("positive_ratio").alias("avg_positive_ratio"),
    )
    scored = per_game.join(per_title, "app_id").select(
        "app_id",
        "title",
        "rating",
        (F.col("recs") * F.col("copies")).alias("total_recs"),
        F.try_divide(F.col("hours"), F.col("timed")).alias("avg_hours_played"),
        "avg_positive_ratio",
        (F.col("positives") * F.col("copies")).alias("positive_recs"),
        F.try_divide(F.col("products").cast("double"), F.col("sized")).alias("avg_user_library_size"),
    )
    score = weighted_score(F.col("avg_hours_played"), F.col("avg_positive_ratio"), F.col("total_recs"))
    return scored.withColumn("weighted_score", score)


def score_games(reviews: DataFrame, games: DataFrame, users: DataFrame) -> DataFrame:
    """``scored_in_any_order``, best first."""
    return scored_in_any_order(reviews, games, users).orderBy(*score_order())


def score_order():
    return [F.desc("weighted_score"), F.col("app_id"), F.col("title"), F.col("rating")]


def scored_games(scored: DataFrame, ranges=64) -> DataFrame:
    """Every game with its place by score, best first, null last; ties by app_id, title and rating.

    Scores are split into ranges at their quantiles. A range's games are numbered by themselves, and the counts
    of the better ranges are added, so only ranges (at most ``ranges`` + 1 rows) meet in one task. Games of one
    score share a range. The scores are written first, since quantiles, counts and numbers read them; their order is
    not used.
    """
    numbered = written(scored.select("app_id", "title", "rating", "weighted_score"), "scored")
    cuts = F.percentile_approx("weighted_score", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]))
    bounds = numbered.agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("cuts")).scalar()
    better = F.size(F.filter(F.col("cuts"), lambda cut: cut > F.col("weighted_score")))
    ranged = numbered.withColumn("cuts", bounds).select(
        "app_id", "title", "rating", "weighted_score",
        F.when(F.col("weighted_score").isNull(), ranges + 1).otherwise(better).alias("range"),
    )
    before = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*score_order()))
    return ranged.withColumn("inside", inside).join(ahead, "range").select(
        "app_id", "weighted_score", (F.col("inside") + F.col("ahead")).alias("row_number")
    )


def scored_games_topk(scored: DataFrame, k=100) -> DataFrame:
    """A report of the k best games, numbered. Only these k rows meet in one task."""
    best = scored.orderBy(*score_order()).limit(k)
    numbered = Window.partitionBy(F.lit(1)).orderBy(*score_order())
    return best.select("app_id", "weighted_score", F.row_number().over(numbered).alias("row_number"))


def _hours_band(hours):
    """Order-preserving band of a float: eight per power of two, null lowest, NaN highest.

    A 32-bit float has at most about a million distinct values inside one band.
    """
    size = F.floor(F.least(F.log2(F.abs(hours.cast("double"))), F.lit(256.0)) * 8)
    return (
        F.when(hours.isNull(), F.lit(-100_000))
        .when(F.isnan(hours), F.lit(100_000))
        .when(hours > 0, 10_000 + size)
        .when(hours < 0, -10_000 - size)
        .otherwise(F.lit(0))
    )


def rank_in_library(reviews: DataFrame) -> DataFrame:
    """``rank()`` of each review among its user's reviews by hours, highest first, null last.

    No task ever holds all reviews of a user. Equal hours are counted first, with map-side combining. A window
    runs per (user, band of hours), where a 32-bit float has a bounded number of distinct values, and one
    per user over whole bands, of which there are some thousands at most. Both start from the same shuffle of
    the counts. The rank then joins back to the reviews, a hot user or tie being a hot key on their side only.
    """
    keyed = reviews.select("user_id", "hours", _hours_band(F.col("hours")).alias("band"))
    ties = keyed.groupBy("user_id", "band", "hours").agg(F.count(F.lit(1)).alias("n"))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("user_id", "band").orderBy(F.desc("hours")).rowsBetween(*before)
    across = Window.partitionBy("user_id").orderBy(F.desc("band")).rowsBetween(*before)
    within_band = ties.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    bands = (
        ties.groupBy("user_id", "band")
        .agg(F.sum("n").alias("n"))
        .select("user_id", "band", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("bands_ahead"))
    )
    ranks = match_nulls_join(within_band, bands, ["user_id", "band"]).select(
        "user_id", "hours", (F.col("ahead") + F.col("bands_ahead") + 1).alias("rank_in_library")
    )
    return match_nulls_join(reviews, ranks, ["user_id", "hours"])
