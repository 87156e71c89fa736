"""Sliding-minute request counts per client."""

from pyspark.sql import functions as F


def request_rates(attempts, limit=30, lateness="10 minutes"):
    """Requests per client in sliding minutes, for streams and tables.

    Counts are combined before the shuffle, so a hot client sends one partial
    count per window and task. ``attempts.ts`` must be a TIMESTAMP.
    """
    windows = F.window("ts", "60 seconds", "10 seconds")
    return (
        attempts.withWatermark("ts", lateness)
        .groupBy("client", windows.alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(
            "client",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "requests",
            (F.col("requests") >= limit).alias("at_limit"),
        )
    )
