"""Activity log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.plans.registry import query
from talweg.sources.tables import table


@query(
    "agg_01_activity_by_user",
    """SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_login, count(*) FILTER (event_type = 'purchase') AS n_upload,
    count(*) FILTER (event_type = 'error') AS n_match, max(ts) AS last_ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def agg_01_activity_by_user(spark, sf_dir):
    """AGG-01: events of three kinds and the last moment, by user."""
    counted = lambda kind: F.count_if(F.col("event_type") == kind)
    return (
        table(spark, sf_dir, "events")
        .where("user_id is not null")
        .groupBy("user_id")
        .agg(counted("signup").alias("n_login"), counted("purchase").alias("n_upload"), counted("error").alias("n_match"), F.max("ts").alias("last_ts"))
    )
