"""Error enrichment joins and error-code reports."""

from functools import reduce

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import errors as E
from sitewise.session import stored


def enrich_codes(rows, code="code"):
    """Message, category, severity, priority and guidance next to each code.

    The three dimensions have 19, 9 and 3 fixed rows: safe to broadcast.
    """
    spark = rows.sparkSession
    catalog = F.broadcast(dims.error_catalog(spark).withColumnRenamed("code", code))
    actions = dims.action_guidance(spark).select(
        "action", "title", F.col("description").alias("guidance")
    )
    ranks = dims.severities(spark).select("severity", "priority")
    return (
        rows.join(catalog, code, "left")
        .join(F.broadcast(actions), "action", "left")
        .withColumn("severity", F.coalesce("severity", F.lit("medium")))
        .join(F.broadcast(ranks), "severity", "left")
        .withColumn(
            "text",
            F.when(
                F.col("message").isNotNull(),
                F.concat(F.col("message"), F.lit(" "), F.col("guidance"), F.lit(".")),
            ).otherwise(F.concat(F.lit("Unknown error: "), F.col(code))),
        )
    )


def enhanced_log(log):
    """Step log rows with readable error and suggested action on failures.

    An entry fails unless its status is 'success', also without any status; only a
    failed one with a code keeps it. The 19 codes are enriched once and broadcast, so
    the log meets one fixed table and keeps columns of any name.
    """
    failed = F.coalesce(F.col("status") != "success", F.lit(True)) & (F.col("error_code") != "")
    action = F.struct(F.col("action").alias("code"), "title", F.col("guidance").alias("description"))
    known = enrich_codes(dims.error_catalog(log.sparkSession).select("code")).select(
        F.col("code").alias("_code"),
        F.col("text").alias("_text"),
        F.when(F.col("title").isNotNull(), action).alias("_action"),
    )
    code = F.col("error_code")
    unknown = F.concat(F.lit("Unknown error: "), code)
    marked = log.withColumn("error_code", F.when(failed, code))
    return marked.join(F.broadcast(known), code == F.col("_code"), "left").select(
        *[F.col(f"`{c}`") for c in marked.columns],
        F.coalesce("_text", unknown).alias("human_readable_error"),
        F.col("_action").alias("suggested_action"),
    )


def code_rows(headers, pages):
    """(request_id, ord, code): the discovery reason first, then failed pages in order.

    ``pages.ord`` is the struct (source, rank) of the report order; the two sources
    keep it, and the discovery comes before both.
    """
    discovery = headers.where(
        (F.col("status") != "success") & (F.coalesce("reason", F.lit("")) != "")
    ).select("request_id", F.struct(F.lit(-1).alias("source"), F.lit(0).cast("long").alias("rank")).alias("ord"), F.col("reason").alias("code"))
    scraping = pages.where(
        (F.col("status") != "success") & (F.coalesce("reason", F.lit("")) != "")
    ).select(
        "request_id",
        F.struct(F.col("ord.source").cast("int").alias("source"), F.col("ord.rank").cast("long").alias("rank")).alias("ord"),
        F.col("reason").alias("code"),
    )
    return discovery.unionByName(scraping)


def report_codes(rows):
    """Ordered code array per report; a report has one code per kept URL at most."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "code")))
    return rows.groupBy("request_id").agg(ordered.alias("_codes")).select(
        "request_id", F.col("_codes.code").alias("codes")
    )


def distinct_codes(results, body="results"):
    """(request_id, code): the different codes of result trees of any depth.

    ``body`` is JSON text: an array of results, or one; a result has a status, a reason
    and maybe ``results`` of its own, and what is no object has no code. A tree is
    walked a level at a time, every tree at once; a level is written before the
    next, so that depth doesn't grow the plan. Text that is no JSON has no codes.
    """

    def opened(rows, text):
        whole = F.try_parse_json(text)
        many = F.try_variant_get(whole, "$", "array<variant>")
        return rows.select("request_id", F.explode(F.coalesce(many, F.array(whole))).alias("node"))

    level, found = opened(results.select("request_id", F.col(body).alias("_body")), F.col("_body")), []
    while True:
        field = lambda name, kind="string": F.try_variant_get("node", f"$.{name}", kind)
        read = level.select(
            "request_id",
            F.when(field("status").isNull() | (field("status") != "success"), F.nullif(field("reason"), F.lit(""))).alias("code"),
            F.to_json(field("results", "array<variant>")).alias("_body"),
        )
        level = stored(read.where("code is not null or _body is not null"), "tree-level")
        found.append(level.where("code is not null").select("request_id", "code"))
        deeper = level.where("_body is not null").select("request_id", "_body")
        if deeper.isEmpty():
            return reduce(lambda a, b: a.unionAll(b), found).distinct()
        level = opened(deeper, F.col("_body"))


def error_totals(rows):
    """Summary figures for any number of codes per request.

    Counted per (request, code) first, so a hot request shrinks to one row per
    distinct code on the map side before it is brought together.
    """
    counted = rows.groupBy("request_id", "code").agg(
        F.count("*").alias("n"), F.min("ord").alias("first")
    )
    code, n = F.col("code"), F.col("n")
    known = E.category_of(code).isNotNull()
    rank_names = F.create_map(
        *[F.lit(x) for name, rank, _ in dims.SEVERITIES for x in (rank, name)]
    )
    return (
        counted.groupBy("request_id")
        .agg(
            F.sum("n").alias("total_errors"),
            F.count("*").alias("distinct_codes"),
            F.sum(F.when(known, 0).otherwise(n)).alias("unknown_errors"),
            F.sum(F.when(code.isin(dims.PAYMENT_CODES), n).otherwise(0)).alias(
                "payment_errors"
            ),
            F.sum(F.when(code.isin(dims.RATE_LIMIT_CODES), n).otherwise(0)).alias(
                "rate_limit_errors"
            ),
            F.max(E.priority_of(code)).alias("max_priority"),
            F.array_sort(F.collect_set(E.action_of(code))).alias("recommended_actions"),
            F.array_sort(F.collect_set(E.category_of(code))).alias("categories"),
        )
        .withColumn("max_severity", F.try_element_at(rank_names, F.col("max_priority")))
    )
