"""Column lists and result types.

Inputs arrive as text; the names below are fixed values of the data sets.
"""

from pyspark.sql import types as T

# Column names of the input files.
REVIEW_COLUMNS = ["app_id", "user_id", "is_recommended", "hours"]
GAME_COLUMNS = ["app_id", "title", "rating", "positive_ratio"]
USER_COLUMNS = ["user_id", "products"]
SALE_COLUMNS = [
    "transaction_id", "price", "date_of_transfer", "postcode",
    "property_type", "new_build", "tenure", "paon",
    "saon", "street", "locality", "town",
    "district", "county", "transaction_category", "record_status",
]
SAMPLE_COLUMNS = ["strategy", "timestamp", "executor_count", "cpu_millicores", "memory_mib"]


def text_schema(columns):
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


# Result columns and types by result name, as DDL. Key columns are text when read from files.
RESULTS = {
    "top_games": ("app_id string, count bigint"),
    "sentiment": ("is_recommended string, count bigint"),
    "user_activity": ("user_id string, count bigint"),
    "steam_heavy": (
        "app_id string, title string, rating string, total_recs bigint, avg_hours_played double, "
        "avg_positive_ratio double, positive_recs bigint, avg_user_library_size double, "
        "weighted_score double"
    ),
    "by_county": (
        "county string, total_sales bigint, avg_price double, median_price bigint, "
        "max_price bigint, min_price bigint"
    ),
    "by_year": ("year int, total_sales bigint, median_price bigint, avg_price double"),
    "by_property_type": (
        "property_type string, count bigint, median_price bigint, avg_price double"
    ),
    "affordability_gap": (
        "district string, county string, median_price bigint, p90_price bigint, "
        "p10_price bigint, total_sales bigint, affordability_ratio double"
    ),
}
