"""URL scores, top-k per site, filter reports, crawl payloads and routing."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.dims import literal_rows
from sitewise.functions.scoring import with_url_score
from sitewise.operators import discovery, ranking
from sitewise.plans import check_sql as Q
from sitewise.plans.registry import query, table
from sitewise.plans.url_queries import HOSTS_SQL, candidate_sql, discovered_urls, place
from sitewise.sources.crawls import parse_crawl_jobs, scraped_content

# one URL per rule that the tables do not reach
_DEEP = "https://s.example.com/a/b/c/d/e"
RULE_URLS = [
    f"https://s.example.com{p}"
    for p in (
        "/aboutus", "/our_team", "/products/x", "/testimonial", "/values", "/blog/x",
        "/insights/x", "/2024/x", "/mission", "/tag/x", "/category/x", "/page/12",
        "/search", "/login", "/signup", "/register", "/cart", "/checkout", "/a.pdf",
        "/a.JPG", "/a.css", "/wp-content", "/feed", "/rss", "/privacy/terms", "/x#y",
        "/x?about=1", "/home", "/index", "/", "", "/a/b/c", "/press-kit;about",
    )
] + [
    _DEEP,
    "https://s.example.com/" + "a" * 27,
    "https://s.example.com/" + "a" * 28,
    "https://s.example.com/" + "a" * 128,
    "https://s.example.com/" + "a" * 129,
    "https://www.s.example.com/about",
    "https://s.www.example.com/team",
    "https://elsewhere.example.com/about",
    "HTTPS://S.EXAMPLE.COM/ABOUT",
]
RULE_ROWS = [
    ("s.example.com", "https://s.example.com", i, url) for i, url in enumerate(RULE_URLS)
]


def scorable_urls(spark, folder):
    rules = literal_rows(
        spark, RULE_ROWS, "request_id string, website string, pos bigint, url string"
    )
    return discovered_urls(spark, folder).unionByName(rules.withColumn("pos", place(2, 0, "pos")))


SCORABLE_SQL = f"""{HOSTS_SQL},
    usual AS (SELECT host AS request_id, website, 0 AS source, 0 AS page, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS url
      FROM (SELECT host, website, list_transform({Q.word_list(dims.CANDIDATE_PATHS)},
        lambda x: website || x) AS l FROM hosts)),
    f AS (SELECT page_id, url AS page_url, {Q.link_targets('html')} AS l FROM pages),
    g AS (SELECT page_id, page_url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM f),
    h AS (SELECT {Q.netloc('page_url')} AS request_id, 1 AS source, page_id AS page, pos,
      {Q.resolve('page_url', 'link')} AS raw FROM g),
    links AS (SELECT request_id, 'https://' || request_id AS website, source, page, pos, {Q.safe_url('raw')} AS url FROM h),
    both_ AS (SELECT * FROM usual UNION ALL SELECT * FROM links WHERE url IS NOT NULL),
    first_ AS (SELECT *, row_number() OVER (PARTITION BY request_id, {Q.first_seen_key('url')}
      ORDER BY source, page, pos) AS rn FROM both_),
    scorable AS (SELECT request_id, website, source, page, pos, url FROM first_ WHERE rn = 1
      UNION ALL SELECT request_id, website, 2, 0, pos, url FROM (VALUES {Q.values(RULE_ROWS)}) AS v(request_id, website, pos, url)),
    parts AS (SELECT *, lower({Q.path('lower(url)')}) AS p FROM scorable),
    scored AS (SELECT request_id, website, source, page, pos, url, {Q.score_columns('url', 'website')} FROM parts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source, page, pos) AS rank
      FROM scored)"""


@query("url_scores", f"WITH {SCORABLE_SQL} SELECT request_id, source || '.' || page || '.' || pos AS pos, url, score, reason FROM scored")
def url_scores(spark, folder):
    scored = with_url_score(scorable_urls(spark, folder), "url", "website")
    return scored.select("request_id", F.concat_ws(".", "pos.*").alias("pos"), "url", F.col("score").cast("long"), "reason")


@query(
    "top_urls_per_site",
    f"WITH {SCORABLE_SQL} SELECT request_id, rank, url, score, reason FROM ranked "
    f"WHERE rank <= {dims.URLS_KEPT} AND score > 0",
)
def top_urls_per_site(spark, folder):
    """Flagship: the pages worth reading per site, with score and reason."""
    ranked = ranking.ranked_urls(scorable_urls(spark, folder))
    return ranked.where("kept").select(
        "request_id",
        F.col("rank").cast("long").alias("rank"),
        "url",
        F.col("score").cast("long").alias("score"),
        "reason",
    )


@query(
    "runner_up_urls",
    f"WITH {SCORABLE_SQL} SELECT request_id, rank - {dims.URLS_KEPT} AS place, url, score FROM ranked "
    f"WHERE rank > {dims.URLS_KEPT} AND rank <= {dims.URLS_KEPT + dims.RUNNER_UPS} AND score > 0",
)
def runner_up_urls(spark, folder):
    ranked = ranking.ranked_urls(scorable_urls(spark, folder))
    return ranked.where("runner_up").select(
        "request_id",
        (F.col("rank") - dims.URLS_KEPT).cast("long").alias("place"),
        "url",
        F.col("score").cast("long").alias("score"),
    )


@query(
    "filter_stats",
    f"WITH {SCORABLE_SQL}, n AS (SELECT request_id, count(*) AS input, "
    f"count(*) FILTER (rank <= {dims.URLS_KEPT} AND score > 0) AS output FROM ranked GROUP BY 1) "
    "SELECT *, input - output AS filtered_out FROM n",
)
def filter_stats(spark, folder):
    return ranking.filter_stats(scorable_urls(spark, folder))


@query(
    "filter_reason_map",
    f"""WITH {SCORABLE_SQL} SELECT request_id,
    coalesce(string_agg(url, ' ' ORDER BY rank) FILTER (rank <= {dims.URLS_KEPT} AND score > 0), '') AS filtered_urls,
    coalesce(string_agg(url || '=' || reason, ' | ' ORDER BY url)
      FILTER (rank <= {dims.URLS_KEPT} AND score > 0), '') AS reasons,
    coalesce(string_agg(url, ' ' ORDER BY rank) FILTER (rank > {dims.URLS_KEPT}
      AND rank <= {dims.URLS_KEPT + dims.RUNNER_UPS} AND score > 0), '') AS samples
    FROM ranked GROUP BY 1""",
)
def filter_reason_map(spark, folder):
    lists = ranking.kept_lists(ranking.ranked_urls(scorable_urls(spark, folder)))
    entries = F.array_sort(
        F.transform(
            F.map_entries("filter_reasons"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        )
    )
    return lists.select(
        "request_id",
        F.array_join("filtered_urls", " ").alias("filtered_urls"),
        F.array_join(entries, " | ").alias("reasons"),
        F.array_join("filtered_out_samples", " ").alias("samples"),
    )


def crawl_payloads(spark, folder):
    """(request_id, body): each page as a crawl job that delivered its links.

    Even items carry the link in the metadata, odd ones in ``url``; every fifth
    item has no URL; content is markdown, html or nothing in turn.
    """
    links = discovery.outlinks(table(spark, folder, "pages"))
    item = F.expr(
        """named_struct(
          'url', case when pos % 5 = 4 then '' when pos % 2 = 1 then url end,
          'markdown', case when pos % 3 = 0 then concat('# ', link) else '' end,
          'html', case when pos % 3 = 1 then concat('<b>', link, '</b>') end,
          'metadata', case when pos % 5 <> 4 and pos % 2 = 0
            then named_struct('sourceURL', url) end)"""
    )
    # the links of one page: a list bounded by the page itself
    jobs = links.groupBy("page_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))),
            lambda e: e["item"],
        ).alias("data")
    )
    body = F.to_json(
        F.struct(
            F.lit(True).alias("success"),
            F.lit("completed").alias("status"),
            F.concat(F.lit("job-"), "page_id").alias("id"),
            "data",
        )
    )
    return jobs.select(F.col("page_id").alias("request_id"), body.alias("body"))


@query(
    "crawl_parse",
    f"""WITH f AS (SELECT page_id, url AS page_url, {Q.link_targets('html')} AS l FROM pages),
    g AS (SELECT page_id, page_url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM f),
    h AS (SELECT page_id, pos, link, {Q.resolve('page_url', 'link')} AS url FROM g WHERE pos % 5 <> 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n,
      count(*) OVER (PARTITION BY page_id) AS total_found FROM h)
    SELECT page_id AS request_id, n AS pos, url, total_found,
      CASE pos % 3 WHEN 0 THEN '# ' || link WHEN 1 THEN '<b>' || link || '</b>' ELSE '' END AS content,
      CASE WHEN pos % 3 = 2 THEN 'no_content' ELSE 'success' END AS status
    FROM r WHERE n < {dims.URLS_PER_SITE}""",
)
def crawl_parse(spark, folder):
    parsed = parse_crawl_jobs(crawl_payloads(spark, folder))
    return parsed.select(
        "request_id",
        F.col("pos").cast("long").alias("pos"),
        "url",
        F.col("total_found").cast("long").alias("total_found"),
        "content",
        "status",
    )


@query(
    "scrape_format",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'md ' || url WHEN 1 THEN html
      WHEN 2 THEN '' ELSE 'md ' || url END AS content FROM pages""",
)
def scrape_format(spark, folder):
    pages = table(spark, folder, "pages")
    data = F.struct(F.concat(F.lit("md "), "url").alias("markdown"), "html")
    payloads = pages.select(
        "page_id",
        F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"))).alias("body"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("markdown", "html", "text", "any")]),
            (F.col("page_id") % 4 + 1).cast("int"),
        ).alias("output_format"),
    )
    return scraped_content(payloads).select("page_id", "content")


def crawl_jobs(spark, folder):
    """(request_id, website, crawl_status, crawl_reason): each page as a job."""
    return table(spark, folder, "pages").selectExpr(
        "page_id as request_id",
        "case when page_id % 11 = 5 then 'javascript:x' else url end as website",
        """case page_id % 10 when 0 then 'error' when 1 then 'error' when 2 then 'timeout'
           when 3 then 'skipped' when 4 then 'rate_limited' else 'success' end as crawl_status""",
        """case page_id % 10 when 0 then 'http_402' when 1 then 'http_429'
           when 2 then 'request_timeout' when 3 then 'no_api_key' end as crawl_reason""",
    )


ROUTING_SQL = f"""jobs AS (SELECT page_id AS request_id,
      CASE WHEN page_id % 11 = 5 THEN NULL ELSE {Q.safe_url('url')} END AS website, url AS page_url, html,
      CASE WHEN page_id % 11 = 5 THEN 'invalid' WHEN page_id % 10 IN (0, 3) THEN 'candidates'
        WHEN page_id % 10 IN (1, 2, 4) THEN 'site_only' ELSE 'crawl' END AS route,
      page_id % 10 AS k FROM pages),
    f AS (SELECT request_id, website, page_url, {Q.link_targets('html')} AS l FROM jobs WHERE route = 'crawl'),
    g AS (SELECT *, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM f),
    h AS (SELECT request_id, website, pos, {Q.resolve('page_url', 'link')} AS raw FROM g WHERE pos % 5 <> 4),
    i AS (SELECT request_id, website, pos, {Q.safe_url('raw')} AS url FROM h),
    j AS (SELECT *, row_number() OVER (PARTITION BY request_id, {Q.first_seen_key('url')} ORDER BY pos) AS rn
      FROM i WHERE url IS NOT NULL AND {Q.site_key('url')} = {Q.site_key('website')}),
    crawled AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS pos, url,
      count(*) OVER (PARTITION BY request_id) AS total_found FROM j WHERE rn = 1),
    usual AS ({candidate_sql('request_id', "jobs WHERE route = 'candidates'", 'website')})"""


@query(
    "discovery_urls",
    f"""WITH {ROUTING_SQL} SELECT request_id, url FROM crawled WHERE pos < {dims.URLS_PER_SITE}
    UNION ALL SELECT request_id, url FROM usual
    UNION ALL SELECT request_id, website FROM jobs WHERE route = 'site_only'""",
)
def discovery_urls(spark, folder):
    crawl = parse_crawl_jobs(crawl_payloads(spark, folder)).select("request_id", "pos", "url")
    _, urls = discovery.discover(crawl_jobs(spark, folder), crawl)
    return urls.select("request_id", "url")


@query(
    "discovery_routing",
    f"""WITH {ROUTING_SQL}, t AS (SELECT request_id, max(total_found) AS n FROM crawled GROUP BY 1)
    SELECT jobs.request_id, route,
      CASE WHEN route = 'invalid' THEN 'error' WHEN route IN ('candidates', 'crawl') THEN 'success'
        WHEN k = 1 THEN 'error' WHEN k = 2 THEN 'timeout' ELSE 'rate_limited' END AS status,
      CASE WHEN route = 'invalid' THEN 'invalid_url' WHEN route = 'candidates' AND k = 0 THEN 'http_402'
        WHEN route <> 'site_only' THEN NULL WHEN k = 1 THEN 'http_429' WHEN k = 2 THEN 'request_timeout'
        ELSE 'rate_limit' END AS reason,
      CASE WHEN route = 'candidates' AND k = 0 THEN 'api_credits_exhausted' END AS original_status,
      CASE WHEN route = 'candidates' THEN 'fallback_patterns' END AS method,
      CASE WHEN route = 'crawl' THEN coalesce(n, 0) WHEN route = 'candidates' THEN 34 END AS total_found
    FROM jobs LEFT JOIN t ON t.request_id = jobs.request_id""",
)
def discovery_routing(spark, folder):
    crawl = parse_crawl_jobs(crawl_payloads(spark, folder)).select("request_id", "pos", "url")
    headers, _ = discovery.discover(crawl_jobs(spark, folder), crawl)
    return headers.select(
        "request_id",
        "route",
        "status",
        "reason",
        "original_status",
        "method",
        F.col("total_found").cast("long").alias("total_found"),
    )
