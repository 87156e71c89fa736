"""Scored URLs, top-k per lead, runner-ups, filter statistics and reasons."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions.scoring import with_url_score
from sitewise.operators.keyed import first_n


def ranked_urls(urls, k=dims.URLS_KEPT, runner_ups=dims.RUNNER_UPS, base_url="website"):
    """The first k + runner_ups URLs per request by score, position breaking ties.

    Rows with a positive score are marked ``kept`` up to rank k and ``runner_up``
    behind it; both reports read this one limited table.
    """
    k = k or dims.URLS_KEPT
    scored = with_url_score(urls, "url", base_url)
    ranked = first_n(
        scored, ["request_id"], [F.desc("score"), F.asc("pos")], k + runner_ups
    )
    good = F.col("score") > 0
    return ranked.withColumn("kept", good & (F.col("rank") <= k)).withColumn(
        "runner_up", good & (F.col("rank") > k)
    )


def filter_stats(urls, k=dims.URLS_KEPT, base_url="website"):
    """input, output and filtered_out per request.

    The k best come first and only positive scores stay, so the output size is
    the smaller of k and the positive count: no ranking needed.
    """
    scored = with_url_score(urls, "url", base_url)
    positive = F.count_if(F.col("score") > 0)
    return (
        scored.groupBy("request_id")
        .agg(
            F.count("*").alias("input"),
            F.least(F.lit(k or dims.URLS_KEPT), positive).cast("long").alias("output"),
        )
        .withColumn("filtered_out", F.col("input") - F.col("output"))
    )


def kept_lists(ranked):
    """Per request: ordered kept URLs, reasons by URL, runner-up samples.

    At most k + runner_ups short rows per request reach the lists.
    """
    kept = F.when(F.col("kept"), F.struct("rank", "url", "reason"))
    extra = F.when(F.col("runner_up"), F.struct("rank", "url"))
    grouped = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(kept)).alias("_kept"),
        F.array_sort(F.collect_list(extra)).alias("_extra"),
    )
    pairs = F.array_distinct(
        F.transform("_kept", lambda row: F.struct(row["url"], row["reason"]))
    )
    return grouped.select(
        "request_id",
        F.col("_kept.url").alias("filtered_urls"),
        F.map_from_entries(pairs).alias("filter_reasons"),
        F.col("_extra.url").alias("filtered_out_samples"),
    )
