"""Page results: shaping, reuse, zip, fallback routing and quality reports."""

from functools import reduce

from pyspark.sql import functions as F

from sitewise.functions import html as H
from sitewise.functions import text as T
from sitewise.functions import urls as U
from sitewise.functions.errors import error_text
from sitewise.functions.events import fallback_outcome, percent
from sitewise.operators.keyed import join_summary

PAGE_COLUMNS = (
    "url",
    "status",
    "content",
    "content_length",
    "format",
    "reason",
    "human_readable_error",
)


def shaped_pages(results, output_format="markdown"):
    """Cleaned content for successes, reason and readable error for failures."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    cleaned = T.clean_text(F.coalesce("content", F.lit("")))
    if output_format == "markdown":
        cleaned = T.clean_markdown(cleaned)
    reason = F.coalesce("reason", F.lit("unknown_error"))
    given = F.nullif(F.col("human_readable_error"), F.lit(""))
    return (
        results.withColumn("content", F.when(ok, cleaned).otherwise(""))
        .withColumn("content_length", F.when(ok, F.length("content")))
        .withColumn("format", F.when(ok, F.coalesce("format", F.lit(output_format))))
        .withColumn("human_readable_error", F.when(~ok, F.coalesce(given, error_text(reason))))
        .withColumn("reason", F.when(~ok, reason))
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
    )


def zip_results(urls, results):
    """Scrape results next to their URLs by position, for lists of unequal length.

    urls: (request_id, pos, url); results: (request_id, pos, url, ...). Every result
    stays: the URL it names wins, then the URL at its place; beyond the list it is
    'unknown'. A URL without a result has no row.
    """
    given = results.withColumnRenamed("url", "_given")
    joined = given.join(urls.select("request_id", "pos", "url"), ["request_id", "pos"], "left")
    return joined.withColumn("url", F.coalesce("_given", "url", F.lit("unknown"))).drop("_given")


def reuse_crawl_content(kept, crawl_pages):
    """Kept URLs that the crawl already delivered, with that content.

    The last copy of a URL wins. The winners are found on the narrow key
    columns; page content is read only for them.
    """
    last = (
        crawl_pages.select("request_id", "url", "pos")
        .groupBy("request_id", "url")
        .agg(F.max("pos").alias("_last"))
    )
    wanted = kept.select("request_id", "url", "rank").join(
        last, ["request_id", "url"], "inner"
    )
    pages = crawl_pages.select(
        "request_id",
        "url",
        F.col("pos").alias("_last"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("status", F.lit("success")).alias("status"),
    )
    return wanted.join(pages, ["request_id", "url", "_last"], "inner").drop("_last")


def urls_to_scrape(kept, crawl_pages):
    """Kept URLs without crawl content."""
    have = crawl_pages.select("request_id", "url")
    return kept.join(have, ["request_id", "url"], "left_anti")


def all_content(reused, scraped):
    """Crawl content first, scraped pages after it; ``ord`` is the report order."""
    order = F.struct(F.col("source"), F.col("rank"))
    first = reused.withColumn("source", F.lit(0))
    then = scraped.withColumn("source", F.lit(1))
    return first.unionByName(then, allowMissingColumns=True).withColumn("ord", order)


def fallback_routes(results):
    """Which failed pages are fetched again the simple way.

    Only where every page of the request failed with http_402 and at least one
    is simple; then only the simple ones. Rows of a hot request stay spread.
    """
    unpaid = F.coalesce(
        (F.col("status") == "error") & (F.col("reason") == "http_402"), F.lit(False)
    )
    marked = results.withColumn("simple", U.is_simple_scrape_url(F.col("url")))
    verdict = marked.groupBy("request_id").agg(
        (F.bool_and(unpaid) & F.bool_or("simple")).alias("fallback")
    )
    return (
        join_summary(marked, verdict, "request_id", ["pos"])
        .withColumn("refetch", F.col("fallback") & F.col("simple"))
        .drop("fallback")
    )


def refetched(results, fetches, output_format="markdown"):
    """``results`` with the pages that are fetched again replaced in their places.

    fetches: (request_id, url, http_status, error_kind, html), one row per plain
    fetch. Which pages go that way tells ``fallback_routes``; one that has no fetch
    keeps its failure. Rows that stay are never joined, and only the html that replaces
    a page is converted, after the join.
    """
    routed = fallback_routes(results)
    columns = results.columns
    outcome = fallback_outcome(F.col("http_status"), F.col("error_kind"))
    given = fetches.select("request_id", "url", outcome.alias("_o"), F.when(outcome["status"] == "success", F.col("html")).alias("_html"))
    again = routed.where("refetch").join(given, ["request_id", "url"], "left")
    done = F.col("_o").isNotNull()
    ok = F.col("_o.status") == "success"
    new = {
        "status": F.when(done, F.col("_o.status")).otherwise(F.col("status")),
        "reason": F.when(done, F.col("_o.reason")).otherwise(F.col("reason")),
        "human_readable_error": F.when(done, F.col("_o.human_readable_error")).otherwise(F.col("human_readable_error")),
        "content": F.when(done, F.when(ok, _plain_text(F.col("_html"), output_format)).otherwise("")).otherwise(F.col("content")),
        "format": F.when(ok, F.lit(output_format)).otherwise(F.col("format")),
    }
    return again.withColumns(new).select(*columns).unionByName(routed.where("not refetch").select(*columns))


def _plain_text(html, output_format):
    convert = H.html_to_markdown if output_format == "markdown" else H.html_to_text
    return T.clean_text(convert(html))


def fallback_content(fetched, output_format="markdown"):
    """Content of plainly fetched pages."""
    return fetched.withColumn("content", _plain_text(F.col("html"), output_format)).withColumn(
        "format", F.lit(output_format)
    )


def scrape_stats(results):
    ok = F.count_if(F.col("status") == "success")
    return (
        results.groupBy("request_id")
        .agg(F.count("*").alias("total"), ok.alias("success"))
        .withColumn("failed", F.col("total") - F.col("success"))
        .withColumn("success_rate", percent(F.col("success"), F.col("total")))
    )


def _lengths(results):
    ok = F.col("status") == "success"
    return results.withColumn(
        "_len", F.when(ok, F.length(F.coalesce("content", F.lit(""))))
    )


def content_quality(results):
    """Quality counts per request; issues are rows of ``content_issues``."""
    n = F.col("_len")
    return (
        _lengths(results)
        .groupBy("request_id")
        .agg(
            F.count("*").alias("total_urls"),
            F.count(n).alias("successful_scrapes"),
            F.count_if(n == 0).alias("empty_content"),
            F.count_if((n > 0) & (n < 100)).alias("low_quality"),
            F.count_if(n > 1000).alias("high_quality"),
            F.coalesce(F.bround(F.avg(n), 0), F.lit(0.0))
            .cast("long")
            .alias("average_content_length"),
        )
        .withColumn(
            "success_rate", percent(F.col("successful_scrapes"), F.col("total_urls"))
        )
    )


def content_issues(results):
    """One row per empty or very short page, in result order by ``pos``."""
    n = F.col("_len")
    issue = F.when(n == 0, F.concat(F.lit("Empty content: "), F.col("url"))).when(
        n < 100,
        F.concat(
            F.lit("Very short content ("),
            n.cast("string"),
            F.lit(" chars): "),
            F.col("url"),
        ),
    )
    return (
        _lengths(results)
        .select("request_id", "pos", issue.alias("issue"))
        .where("issue is not null")
    )


def site_stats(headers, urls, kept, pages):
    """Website statistics per request from the four phase tables.

    One aggregate over the union of narrow marks: a single shuffle.
    """

    def marks(df, name, flag=None):
        hit = F.lit(1) if flag is None else flag.cast("int")
        return df.select("request_id", F.lit(name).alias("kind"), hit.alias("n"))

    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    parts = [
        marks(headers, "lead"),
        marks(urls, "discovered"),
        marks(kept, "filtered"),
        marks(pages, "scraped", ok),
        marks(pages, "failed", ~ok),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b), parts)

    def total(kind):
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    return stacked.groupBy("request_id").agg(
        total("discovered").alias("total_discovered"),
        total("filtered").alias("total_filtered"),
        total("scraped").alias("total_scraped"),
        total("failed").alias("scrape_failures"),
    )
