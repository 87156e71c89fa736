"""URL discovery: candidates, hints, outlinks, crawl results and routing."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import html as H
from sitewise.functions import urls as U
from sitewise.operators.keyed import first_n, once
from sitewise.operators.urls import dedup_first_seen
from sitewise.session import stored


def candidate_urls(sites, site="website"):
    """Usual pages of each site: 34 rows per site, one row for the minimal test host.

    Feed it distinct sites: the expansion then happens once per site.
    """
    url = F.col(site)
    minimal = F.lower(U.netloc(url)) == dims.MINIMAL_HOST
    base = F.col("_origin")
    usual = F.array_distinct(
        F.array(*[F.concat(base, F.lit(p)) for p in dims.CANDIDATE_PATHS])
    )
    return (
        sites.withColumn("_origin", U.origin(url))
        .withColumn(
            "method",
            F.when(minimal, "example_com_minimal").otherwise("fallback_patterns"),
        )
        .select(
            "*",
            F.posexplode(
                F.when(F.col("method") == "example_com_minimal", F.array(url)).otherwise(
                    usual
                )
            ).alias("pos", "url"),
        )
        .drop("_origin")
    )


def sitemap_hints(sites, site="website"):
    base = U.origin(F.col(site))
    hints = F.array(*[F.concat(base, F.lit(p)) for p in dims.SITEMAP_PATHS])
    return sites.select("*", F.posexplode(hints).alias("pos", "url"))


def page_parts(pages, url="url"):
    """``pages`` with what links on them are resolved against, taken once per page."""
    whole, place = U.origin(F.col(url)), U.path(F.col(url))
    staged = pages.withColumns({"_origin": whole, "_path": place})
    folder = F.regexp_replace("_path", r"[^/]*\z", "")
    return staged.withColumn(
        "_base",
        F.struct(
            F.col("_origin").alias("origin"),
            F.regexp_extract("_origin", "^([a-z]+:)", 1).alias("scheme"),
            F.col("_path").alias("path"),
            F.when(folder == "", "/").otherwise(folder).alias("folder"),
        ),
    ).drop("_origin", "_path")


def resolve_link(page_url, base, link):
    """Absolute URL of a link found on a page (no dot-segment folding); ``base`` is the
    page's struct of ``page_parts``."""
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(base["scheme"], link))
        .when(link.startswith("/"), F.concat(base["origin"], link))
        .when(link == "", page_url)
        .when(link.rlike(r"^[#?]"), F.concat(base["origin"], base["path"], link))
        .otherwise(F.concat(base["origin"], base["folder"], link))
    )


def outlinks(pages):
    """(page_id, page_url, pos, link, url) for every anchor of every page."""
    found = page_parts(pages.select("page_id", "url", "html")).select(
        "page_id",
        F.col("url").alias("page_url"),
        "_base",
        F.posexplode(H.link_targets(F.col("html"))).alias("pos", "link"),
    )
    return found.withColumn("url", resolve_link(F.col("page_url"), F.col("_base"), F.col("link"))).drop("_base")


def crawled_urls(crawl_rows, max_urls=dims.URLS_PER_SITE):
    """Cleaned, same-site, de-duplicated crawl URLs.

    Input (request_id, website, pos, url). Returns the first ``max_urls`` rows
    per request and a table of the counts before that cut.
    """
    cleaned = (
        crawl_rows.withColumn("url", once(U.safe_url(F.col("url"))))
        .where(F.col("url").isNotNull())
        .where(U.is_same_domain(F.col("url"), F.col("website")))
        .select("request_id", "pos", "url")
    )
    # both results read it: cleaned and compared once
    unique = stored(dedup_first_seen(cleaned, ["request_id"]), "crawled")
    totals = unique.groupBy("request_id").agg(F.count("*").alias("total_found"))
    kept = first_n(unique, ["request_id"], ["pos"], max_urls or dims.URLS_PER_SITE)
    return (
        kept.select("request_id", (F.col("rank") - 1).alias("pos"), "url"),
        totals,
    )


def with_route(jobs):
    """Add the canonical website and the branch each crawl job takes."""
    status, reason = F.col("crawl_status"), F.col("crawl_reason")
    no_credit = (status == "error") & F.coalesce(reason == "http_402", F.lit(False))
    return jobs.withColumn("website", once(U.safe_url(F.col("website")))).withColumn(
        "route",
        F.when(F.col("website").isNull(), "invalid")
        .when((status == "skipped") | no_credit, "candidates")
        .when(status != "success", "site_only")
        .otherwise("crawl"),
    )


def discover(jobs, crawl_rows, max_urls=dims.URLS_PER_SITE):
    """Discovery result of every crawl job.

    jobs: (request_id, website, crawl_status, crawl_reason); crawl_rows:
    (request_id, pos, url). Returns (headers, urls).
    """
    # every branch reads it: joined and cleaned once
    routed = stored(with_route(jobs), "routed")
    to_crawl = routed.where("route = 'crawl'").select("request_id", "website")
    crawled, totals = crawled_urls(
        crawl_rows.join(to_crawl, "request_id", "inner"), max_urls
    )
    candidates = candidate_urls(
        routed.where("route = 'candidates'").select("request_id", "website")
    ).select("request_id", "pos", "url")
    single = routed.where("route = 'site_only'").select(
        "request_id", F.lit(0).alias("pos"), F.col("website").alias("url")
    )
    urls = crawled.unionByName(candidates).unionByName(single)

    minimal = F.lower(U.netloc(F.col("website"))) == dims.MINIMAL_HOST
    route = F.col("route")
    no_credit = (route == "candidates") & (F.col("crawl_status") == "error")
    headers = routed.join(totals, "request_id", "left").select(
        "request_id",
        "website",
        "route",
        F.when(route == "invalid", "error")
        .when(route == "candidates", "success")
        .otherwise(F.col("crawl_status"))
        .alias("status"),
        F.when(route == "invalid", "invalid_url")
        .when(no_credit, "http_402")
        .when(
            route == "site_only",
            F.coalesce(
                "crawl_reason",
                F.when(F.col("crawl_status") == "rate_limited", "rate_limit").otherwise(
                    "unknown"
                ),
            ),
        )
        .alias("reason"),
        F.when(no_credit, "api_credits_exhausted").alias("original_status"),
        F.when(
            route == "candidates",
            F.when(minimal, "example_com_minimal").otherwise("fallback_patterns"),
        ).alias("method"),
        F.when(
            route == "candidates",
            F.when(minimal, "Minimal URL set for example.com testing").otherwise(
                "URLs generated from common patterns - not all may exist"
            ),
        ).alias("note"),
        F.when(route == "crawl", F.coalesce("total_found", F.lit(0)))
        .when(
            route == "candidates",
            F.when(minimal, 1).otherwise(len(dims.CANDIDATE_PATHS)),
        )
        .alias("total_found"),
        F.when(route == "crawl", U.domain(F.col("website"))).alias("domain"),
    )
    return headers, urls
