"""Run analytics: steps, resources, attempts, request rates and failure streaks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions.events import is_retryable, percent, rounded


def step_stats(log):
    """Processing statistics per request with a status histogram.

    Two levels: (request, status) partial counts first, then one row per status.
    """
    by_status = log.groupBy(
        "request_id", F.coalesce("status", F.lit("unknown")).alias("status")
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("ms"),
        F.sum(F.coalesce("api_calls", F.lit(0))).alias("calls"),
    )
    entries = F.array_sort(F.collect_list(F.struct("status", "n")))
    success = F.sum(F.when(F.col("status") == "success", F.col("n")).otherwise(0))
    return (
        by_status.groupBy("request_id")
        .agg(
            F.sum("ms").alias("total_duration_ms"),
            F.sum("n").alias("total_steps"),
            F.map_from_entries(entries).alias("status_counts"),
            F.sum("calls").alias("total_api_calls"),
            success.alias("_success"),
        )
        .withColumn(
            "total_duration_seconds", rounded(F.col("total_duration_ms") / 1000.0, 2)
        )
        .withColumn("success_rate", percent(F.col("_success"), F.col("total_steps")))
        .drop("_success")
    )


def content_sizes(pages):
    """Characters of content per request."""
    return pages.groupBy("request_id").agg(
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("content_bytes_scraped")
    )


def resource_usage(stats, sizes):
    """Content size and URL counts per request; the rate is scraped over kept."""
    return stats.join(sizes, "request_id", "left").select(
        "request_id",
        F.coalesce("content_bytes_scraped", F.lit(0)).alias("content_bytes_scraped"),
        F.col("total_discovered").alias("urls_discovered"),
        F.col("total_filtered").alias("urls_filtered"),
        F.col("total_scraped").alias("urls_scraped"),
        percent(F.col("total_scraped"), F.col("total_filtered")).alias(
            "scrape_success_rate"
        ),
    )


def retry_outcome(attempts, max_retries=dims.MAX_RETRIES):
    """Attempts, final answer and exhaustion per logical request."""
    final = F.max_by(F.struct("http_status", "error"), F.col("attempt"))
    last = F.col("_final")
    retryable = is_retryable(last["http_status"], last["error"])
    success = F.coalesce(last["http_status"].between(200, 299), F.lit(False))
    return (
        attempts.groupBy("client", "request")
        .agg(F.count("*").alias("attempts"), final.alias("_final"))
        .select(
            "client",
            "request",
            "attempts",
            last["http_status"].alias("final_status"),
            last["error"].alias("final_error"),
            success.alias("success"),
            (~success & retryable & (F.col("attempts") > max_retries)).alias("exhausted"),
        )
    )


def job_state(polls, max_wait=dims.CRAWL_MAX_WAIT_SECONDS):
    """State of each crawl job from its status polls.

    The first terminal poll inside the wait decides; without one the job has
    timed out or carries its latest status. Partial aggregates only.
    """
    heard = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    terminal = heard & F.col("status").isin("completed", "failed")
    at = F.unix_micros("ts")
    wait = max_wait * 1000000
    grouped = polls.groupBy("job_id").agg(
        F.min(at).alias("start"),
        F.max(at).alias("latest"),
        F.min(F.when(terminal, at)).alias("ended"),
        F.min_by("status", F.when(terminal, at)).alias("end_status"),
        F.max_by("status", F.when(heard, at)).alias("last_status"),
        F.count("*").alias("polls"),
    )
    ended = F.coalesce(F.col("ended") - F.col("start") < wait, F.lit(False))
    late = F.col("latest") - F.col("start") >= wait
    running = F.col("last_status").isin("scraping", "processing", "queued")
    state = (
        F.when(ended, F.col("end_status"))
        .when(late, "timeout")
        .when(running, "running")
        .otherwise("unknown")
    )
    return grouped.select("job_id", "polls", state.alias("state")).withColumn(
        "reason",
        F.when(F.col("state") == "failed", "crawl_failed").when(
            F.col("state") == "timeout", "crawl_timeout"
        ),
    )


def slow_requests(requests, threshold=1.0):
    return requests.where(F.col("duration") > threshold).withColumn(
        "duration_text", F.format_string("%.3f", F.bround("duration", 3))
    )


def time_chunks(calls, second, chunk_seconds, most_calls):
    """``calls`` with ``_who`` and ``chunk``, ordered pieces of a client's history.

    A chunk is a stretch of ``chunk_seconds``, cut at whole seconds into parts of about
    ``most_calls`` where a client has more. Only counts per second are added up, at
    most ``chunk_seconds`` of them in a stretch, so however busy a client is its calls
    are many small groups. ``_who`` stands for the client, also for none.
    """
    timed = (
        calls.withColumn("_who", F.struct("client"))
        .withColumn("_second", second.cast("long"))
        .withColumn("_time", F.floor(F.col("_second") / chunk_seconds).cast("long"))
    )
    so_far = Window.partitionBy("_who", "_time").orderBy("_second")
    parts = (
        timed.groupBy("_who", "_time", "_second")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        .withColumn("_part", F.floor(F.col("_before") / most_calls).cast("long"))
        .where("_part > 0")
        .select("_who", "_second", "_part")
    )
    chunk = F.struct("_time", F.coalesce("_part", F.lit(0)).alias("part"))
    return (
        timed.join(parts, ["_who", "_second"], "left")
        .withColumn("chunk", chunk)
        .drop("_second", "_time", "_part")
    )


def rate_window(
    attempts,
    limit=dims.REQUESTS_PER_MINUTE,
    frame_seconds=60,
    chunk_seconds=3600,
    most_calls=100_000,
):
    """Requests of the client in the trailing minute, exactly 60 s old included.

    Each call comes into the window and goes out again just after its minute; the
    running sum of these moves is the count, and the next to go is the oldest. The
    sums are taken inside small chunks, and one row per chunk carries them on, so a
    busy client or minute is no single task and no call meets all of its minute.
    Of calls at the same instant only those with a smaller id came before. A call
    without a time is in no window.
    """
    frame, at = frame_seconds * 1000000, F.unix_micros("ts")
    comes = attempts.withColumn("_pos", at).withColumn("_step", F.when(at.isNull(), 0).otherwise(1))
    goes = attempts.where("ts is not null").select(
        "client", "event_id", (at + frame + 1).alias("_pos"), at.alias("_went"), F.lit(-1).alias("_step")
    )
    moves = comes.unionByName(goes, allowMissingColumns=True)
    moves = time_chunks(moves, F.floor(F.col("_pos") / 1000000), chunk_seconds, most_calls)
    order = ("_pos", "_step", "event_id")
    group, first, last = Window.partitionBy("_who", "chunk"), Window.unboundedPreceding, Window.currentRow
    up = group.orderBy(*order).rowsBetween(first, last)
    down = group.orderBy(*[F.desc(c) for c in order]).rowsBetween(first, last)
    inside = (
        moves.withColumn("_in", F.sum("_step").over(up) - F.col("_step"))
        .withColumn("_oldest", F.last("_went", ignorenulls=True).over(down))
        .where("_step >= 0")
    )
    client = Window.partitionBy("_who")
    earlier = client.orderBy("chunk").rowsBetween(first, -1)
    later = client.orderBy(F.desc("chunk")).rowsBetween(first, -1)
    carried = (
        moves.groupBy("_who", "chunk")
        .agg(F.sum("_step").alias("_net"), F.min("_went").alias("_first"))
        .withColumn("_carry", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
        .withColumn("_next", F.last("_first", ignorenulls=True).over(later))
        .select("_who", "chunk", "_carry", "_next")
    )
    wait = F.lit(float(frame_seconds)) - (F.col("_pos") - F.coalesce("_oldest", "_next")) / 1000000.0
    return (
        inside.join(carried, ["_who", "chunk"])
        .withColumn("in_window", F.when(F.col("_step") == 0, 0).otherwise(F.col("_in") + F.col("_carry")))
        .withColumn("at_limit", F.col("in_window") >= limit)
        .withColumn(
            "wait_seconds",
            F.when(F.col("at_limit"), F.greatest(wait, F.lit(0.0))).otherwise(0.0),
        )
        .select(*attempts.columns, "in_window", "at_limit", "wait_seconds")
    )


def failure_streak(calls, threshold=dims.CIRCUIT_FAILURES, chunk_seconds=3600, most_calls=100_000):
    """Straight failures up to each call of a client, a success resets to zero.

    Streaks are counted inside small chunks of a client's history; what runs on over
    a border is carried by one summary row per chunk, so the only per-client
    ordering is over chunks. Calls without a time come first.
    """
    rows = Window.partitionBy("_who", "chunk").orderBy("ts", "event_id")
    rows = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunked = (
        time_chunks(calls, F.unix_seconds("ts"), chunk_seconds, most_calls)
        .withColumn("_rn", F.row_number().over(rows))
        .withColumn(
            "_last_ok", F.max(F.when(~F.col("failed"), F.col("_rn"))).over(rows)
        )
    )
    summary = chunked.groupBy("_who", "chunk").agg(
        F.count("*").alias("_n"), F.max("_last_ok").alias("_ok")
    )
    chunks = Window.partitionBy("_who").orderBy("chunk")
    run = Window.partitionBy("_who", "_run").orderBy("chunk")
    carried = (
        summary.withColumn("_trail", F.col("_n") - F.coalesce("_ok", F.lit(0)))
        .withColumn("_run", F.count("_ok").over(chunks))
        .withColumn("_out", F.sum("_trail").over(run))
        .withColumn("_carry", F.lag("_out", 1, 0).over(chunks))
        .select("_who", "chunk", "_carry")
    )
    streak = F.when(F.col("_last_ok").isNull(), F.col("_rn") + F.col("_carry")).otherwise(
        F.col("_rn") - F.col("_last_ok")
    )
    return (
        chunked.join(carried, ["_who", "chunk"])
        .withColumn("streak", streak.cast("long"))
        .withColumn("opens", F.col("streak") >= threshold)
        .select(*calls.columns, "streak", "opens")
    )
