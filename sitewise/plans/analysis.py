"""Website analysis of a batch of leads: discover, filter, content."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.operators import content, discovery, ranking
from sitewise.session import stored


def analyze_websites(
    leads,
    crawl_jobs,
    crawl_pages,
    scrape_results,
    fetches=None,
    max_urls=dims.URLS_PER_SITE,
    k=dims.URLS_KEPT,
):
    """Phase tables of the analysis, keyed by request_id.

    leads: event data. crawl_jobs: (request_id, crawl_status, crawl_reason).
    crawl_pages: (request_id, pos, url, content, status, has_content).
    scrape_results: one row per (request_id, url) with status, content, format,
    reason and human_readable_error; a URL without a row was skipped. fetches:
    (request_id, url, http_status, error_kind, html), the plain fetches; where every
    scraped page of a lead was refused for payment, they replace the simple pages.

    Each phase is written to the shared folder, so that the next one, the
    statistics, the log and the reports plan from its files. So are the crawl's pages,
    which three phases read: what they are parsed from is read once.
    """
    crawl_pages = stored(crawl_pages, "crawl")
    jobs = (
        leads.where(F.coalesce("company_website", F.lit("")) != "")
        .select("request_id", F.col("company_website").alias("website"))
        .join(crawl_jobs, "request_id", "left")
        .withColumn(
            "crawl_reason",
            F.when(F.col("crawl_status").isNull(), "no_api_key").otherwise(
                F.col("crawl_reason")
            ),
        )
        .withColumn("crawl_status", F.coalesce("crawl_status", F.lit("skipped")))
    )
    headers, urls = discovery.discover(
        jobs, crawl_pages.select("request_id", "pos", "url"), max_urls
    )
    headers, urls = stored(headers, "headers"), stored(urls, "urls")
    based = urls.join(headers.select("request_id", "website"), "request_id")
    ranked = stored(ranking.ranked_urls(based, k), "ranked")
    kept = ranked.where("kept").select("request_id", "rank", "url")
    delivered = crawl_pages.where("has_content").drop("has_content")
    reused = content.reuse_crawl_content(kept, delivered)
    wanted = content.urls_to_scrape(kept, delivered).withColumn("pos", F.col("rank"))
    scraped = (
        wanted.join(scrape_results, ["request_id", "url"], "left")
        .withColumn("reason", F.when(F.col("status").isNull(), "no_api_key").otherwise(F.col("reason")))
        .withColumn("status", F.coalesce("status", F.lit("skipped")))
    )
    if fetches is not None:
        scraped = content.refetched(stored(scraped, "scraped"), fetches)
    pages = content.all_content(reused, content.shaped_pages(scraped).drop("pos"))
    return {"headers": headers, "urls": urls, "ranked": ranked, "pages": stored(pages, "pages")}
