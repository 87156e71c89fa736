"""Registered queries: a Spark plan and, where SQL can say it, its check SQL."""

QUERIES = {}
CHECKS = {}


def query(name, sql=None):
    """Register ``plan(spark, folder)`` under ``name``."""

    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
