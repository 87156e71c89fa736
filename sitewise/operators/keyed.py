"""Row helpers, and per-key ones that stay whole and spread when one key holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def once(col):
    """``col`` as a generated column, nulls kept: worked out once per row.

    A long chain that filters and joins read as well would be copied into each of them.
    """
    return F.explode(F.array(col))


def keep_first(df, group, key, order):
    """First row per (group, key) by ``order``.

    An aggregate, not a window: copies collapse on the map side, so a hot group
    of copies never meets in one task.
    """
    rest = [c for c in df.columns if c not in [*group, key, order]]
    first = F.min(F.struct(order, *rest)).alias("_first")
    return df.groupBy(*group, key).agg(first).select(*group, key, "_first.*")


def first_n(df, group, order, n, rank="rank"):
    """Rows ranked 1..n per group.

    Spark limits each group before the shuffle (WindowGroupLimit), so at most n
    rows per group and map task travel, whatever the group's size.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def join_summary(rows, summary, key, spread_by, salts=16):
    """Left join of unbounded rows to one summary row per key, hot keys split.

    The rows of one key are spread over ``salts`` join keys by a hash of
    ``spread_by``; the one summary row per key is repeated for each.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    copies = summary.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
