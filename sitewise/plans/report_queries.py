"""The composed analysis and what is made of it: statistics, log, reports, files, codes.

Every page is a lead that runs through all phases.
"""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import urls as U
from sitewise.functions.errors import error_summary
from sitewise.functions.text import format_bytes
from sitewise.operators import content as C
from sitewise.operators import discovery
from sitewise.operators import errors as E
from sitewise.operators import reports as R
from sitewise.operators.leads import linkedin_stub
from sitewise.plans import check_sql as Q
from sitewise.plans.analysis import analyze_websites
from sitewise.plans.registry import query, table
from sitewise.plans.site_queries import ROUTING_SQL, crawl_jobs, crawl_payloads
from sitewise.plans.stream_queries import KEY, _EVENTS, _signed, _stream
from sitewise.session import stored
from sitewise.sources import reports as files
from sitewise.sources.crawls import parse_crawl_jobs
from sitewise.streaming import intake as I
from sitewise.streaming.runner import work_paths

NOW = "2024-03-01 10:20:30"
STAMP = "2024-03-01T10:20:30+00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _key():
    return F.col("page_id").cast("string")


def leads(spark, folder):
    """Every page as a lead; some have no site, some a profile, some failed midway."""
    return table(spark, folder, "pages").select(
        _key().alias("request_id"),
        F.lit(STAMP).alias("timestamp"),
        F.concat(F.lit("Ann"), _key()).alias("first_name"),
        F.when(F.col("page_id") % 5 != 0, "Bell").alias("last_name"),
        F.expr("case when page_id % 13 = 12 then null when page_id % 11 = 5 then 'javascript:x' else url end").alias("company_website"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("linkedin.com/in/"), _key())).alias("linkedin"),
        F.when(F.col("page_id") % 17 == 3, "stopped midway").alias("error_message"),
        F.when(F.col("page_id") % 17 == 3, "TimeoutError").alias("error_type"),
        F.when(F.col("page_id") % 17 == 3, STAMP).alias("error_timestamp"),
    )


def _scrapable(spark, folder):
    """(request_id, k, pos, url, html): what a page's site may be asked for."""
    pages = table(spark, folder, "pages")
    usual = discovery.candidate_urls(pages.withColumnRenamed("url", "website")).select("page_id", "html", "pos", "url")
    site = pages.select("page_id", "html", F.lit(99).alias("pos"), U.safe_url(F.col("url")).alias("url"))
    both = usual.unionByName(site)
    return both.select(_key().alias("request_id"), (F.col("page_id") % 4).alias("k"), "pos", "url", "html")


def scrape_results(spark, folder):
    """By the lead: all refused for payment, half of them, none, all broken."""
    refused = F.expr("k = 0 or (k = 1 and pos % 2 = 0)")
    failed = refused | (F.col("k") == 3)
    text = F.concat(F.lit("Words  of \n\n\n\n"), "url", F.lit(" end "))
    return _scrapable(spark, folder).select(
        "request_id",
        "url",
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(refused, "http_402").when(failed, "http_500").alias("reason"),
        F.lit(None).cast("string").alias("human_readable_error"),
        F.when(~failed, text).alias("content"),
        F.lit(None).cast("string").alias("format"),
    )


def fetches(spark, folder):
    """Plain fetches: a third is missing at its host, a third takes too long."""
    return _scrapable(spark, folder).where("k = 0").select(
        "request_id",
        "url",
        F.expr("case pos % 3 when 0 then 200 when 1 then 404 end").alias("http_status"),
        F.expr("case when pos % 3 = 2 then 'timeout' end").alias("error_kind"),
        "html",
    )


def analysis(spark, folder, given=None):
    jobs = crawl_jobs(spark, folder).select(F.col("request_id").cast("string").alias("request_id"), "crawl_status", "crawl_reason")
    payloads = crawl_payloads(spark, folder).where("request_id % 10 >= 5").withColumn("request_id", F.col("request_id").cast("string"))
    pages = parse_crawl_jobs(payloads).select("request_id", "pos", "url", "content", "status", F.lit(True).alias("has_content"))
    given = leads(spark, folder) if given is None else given
    return analyze_websites(given, jobs, pages, scrape_results(spark, folder), fetches(spark, folder))


_failed = "(k = 0 OR k = 3 OR (k = 1 AND pos % 2 = 0))"
_simple = (
    f"(lower({Q.netloc('url')}) IN ({', '.join(map(Q.text, dims.SIMPLE_HOSTS))}) OR "
    f"trim(lower({Q.path('url')}), '/') IN ({', '.join(map(Q.text, [''] + dims.SIMPLE_PATHS))}))"
)
_known = ", ".join(f"'{code}'" for code in ("http_402", "http_500", "no_api_key"))
_texts = "CASE reason " + " ".join(
    f"WHEN '{code}' THEN {Q.error_text(chr(39) + code + chr(39))}" for code in ("http_402", "http_500", "no_api_key")
) + " END"

ANALYSIS_SQL = f"""{ROUTING_SQL},
  js AS (SELECT * FROM jobs WHERE request_id % 13 <> 12),
  cand AS (SELECT request_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS url FROM
    (SELECT request_id, list_transform({Q.word_list(dims.CANDIDATE_PATHS)}, lambda x: {Q.origin('page_url')} || x) AS l FROM jobs)),
  found AS (SELECT c.request_id, website, pos, url FROM crawled c JOIN js USING (request_id) WHERE pos < {dims.URLS_PER_SITE}
    UNION ALL SELECT request_id, website, pos, url FROM cand JOIN js USING (request_id) WHERE route = 'candidates'
    UNION ALL SELECT request_id, website, 0, website FROM js WHERE route = 'site_only'),
  parts AS (SELECT *, lower({Q.path('lower(url)')}) AS p FROM found),
  scored AS (SELECT request_id, pos, url, {Q.score_columns('url', 'website')} FROM parts),
  kept AS (SELECT request_id, url, reason, score, rank FROM (SELECT *,
    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= {dims.URLS_KEPT} AND score > 0),
  it AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS n FROM
    (SELECT request_id, pos, link, {Q.resolve('page_url', 'link')} AS url FROM g WHERE pos % 5 <> 4)),
  late AS (SELECT request_id, url, max(pos) AS pos FROM it WHERE n <= {dims.URLS_PER_SITE} GROUP BY 1, 2),
  reused AS (SELECT kept.request_id, 0 AS source, rank, kept.url, CASE late.pos % 3 WHEN 2 THEN 'no_content' ELSE 'success' END AS status,
    NULL AS reason, NULL AS said, NULL AS format,
    CASE late.pos % 3 WHEN 0 THEN '# ' || link WHEN 1 THEN '<b>' || link || '</b>' ELSE '' END AS content
    FROM kept JOIN late USING (request_id, url) JOIN it ON it.request_id = late.request_id AND it.pos = late.pos),
  asked AS (SELECT c.request_id, c.request_id % 4 AS k, c.pos, c.url, html FROM (SELECT request_id, pos, url FROM cand
    UNION ALL SELECT page_id, 99, {Q.safe_url('url')} FROM pages) c JOIN pages ON page_id = c.request_id),
  scr AS (SELECT kept.request_id, rank, kept.url, a.html, a.pos,
    CASE WHEN a.k IS NULL THEN 'skipped' WHEN {_failed} THEN 'error' ELSE 'success' END AS status,
    CASE WHEN a.k IS NULL THEN 'no_api_key' WHEN k = 3 THEN 'http_500' WHEN {_failed} THEN 'http_402' END AS reason,
    {_simple.replace('url', 'kept.url')} AS simple
    FROM kept LEFT JOIN asked a ON a.request_id = kept.request_id AND a.url = kept.url
    WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.request_id = kept.request_id AND it.url = kept.url AND n <= {dims.URLS_PER_SITE})),
  verdict AS (SELECT request_id, bool_and(status = 'error' AND reason = 'http_402') AND bool_or(simple) AS again FROM scr GROUP BY 1),
  fetched AS (SELECT request_id, rank, url, html, again AND simple AS plain, CASE WHEN again AND simple THEN pos % 3 ELSE -1 END AS m, status, reason
    FROM scr JOIN verdict USING (request_id)),
  replaced AS (SELECT request_id, rank, url, CASE m WHEN -1 THEN status WHEN 0 THEN 'success' ELSE 'error' END AS status,
    CASE m WHEN -1 THEN reason WHEN 1 THEN 'http_404' WHEN 2 THEN 'timeout' END AS reason,
    CASE m WHEN 1 THEN 'HTTP 404 error when fetching the page' WHEN 2 THEN 'Page took too long to load' END AS said,
    CASE WHEN m = 0 THEN {Q.clean_text('(' + Q.html_to_markdown('html') + ')')} ELSE 'Words  of ' || chr(10) || chr(10) || chr(10) || chr(10) || url || ' end ' END AS raw
    FROM fetched),
  analysed AS (SELECT * FROM reused UNION ALL SELECT request_id, 1, rank, url, status, reason,
    CASE WHEN status <> 'success' THEN coalesce(said, {_texts}) END,
    CASE WHEN status = 'success' THEN 'markdown' END,
    CASE WHEN status = 'success' THEN {Q.clean_markdown('(' + Q.clean_text('raw') + ')')} ELSE '' END FROM replaced),
  totals AS (SELECT request_id,
    (SELECT count(*) FROM found WHERE found.request_id = js.request_id) AS total_discovered,
    (SELECT count(*) FROM kept WHERE kept.request_id = js.request_id) AS total_filtered,
    (SELECT count(*) FROM analysed a WHERE a.request_id = js.request_id AND status = 'success') AS total_scraped,
    (SELECT count(*) FROM analysed a WHERE a.request_id = js.request_id AND status <> 'success') AS scrape_failures,
    (SELECT count(*) FROM analysed a WHERE a.request_id = js.request_id AND source = 0) AS crawled,
    (SELECT coalesce(sum(length(content)), 0) FROM analysed a WHERE a.request_id = js.request_id) AS chars FROM js)"""


@query(
    "site_analysis",
    f"""WITH {ANALYSIS_SQL} SELECT request_id::VARCHAR AS request_id, source, rank::INT AS rank, url, status, reason,
    said AS human_readable_error, format, content FROM analysed""",
)
def site_analysis(spark, folder):
    """Pages of every lead after discovery, ranking, reuse, scraping and second fetch."""
    pages = analysis(spark, folder)["pages"]
    return pages.select("request_id", "source", "rank", "url", "status", "reason", "human_readable_error", "format", "content")


@query(
    "site_stats",
    f"""WITH {ANALYSIS_SQL} SELECT request_id::VARCHAR AS request_id, total_discovered, total_filtered, total_scraped, scrape_failures
    FROM totals""",
)
def site_stats(spark, folder):
    a = analysis(spark, folder)
    return C.site_stats(a["headers"], a["urls"], a["ranked"].where("kept"), a["pages"])


_route = "CASE route WHEN 'site_only' THEN CASE k WHEN 1 THEN 'error' WHEN 2 THEN 'timeout' ELSE 'rate_limited' END ELSE 'success' END"
_why = "CASE k WHEN 1 THEN 'http_429' WHEN 2 THEN 'request_timeout' ELSE 'rate_limit' END"
LOG_SQL = f"""{ANALYSIS_SQL},
  heads AS (SELECT request_id, route, {_route} AS status, CASE WHEN route = 'site_only' THEN {_why} END AS reason FROM js),
  steps AS (SELECT page_id AS request_id, 0 AS ord, 'linkedin_analysis' AS step, 'not_implemented' AS status, NULL AS a, NULL AS b, NULL AS c FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT request_id, 1, 'url_discovery', status, CASE WHEN status = 'success' THEN total_discovered ELSE 0 END, NULL, NULL
      FROM heads JOIN totals USING (request_id) WHERE route <> 'invalid'
    UNION ALL SELECT request_id, 2, 'url_filtering', 'success', total_discovered, total_filtered, NULL FROM heads JOIN totals USING (request_id) WHERE route <> 'invalid'
    UNION ALL SELECT request_id, 3, 'content_scraping', CASE WHEN total_scraped > 0 THEN 'success' ELSE 'partial' END, crawled, total_scraped, scrape_failures
      FROM heads JOIN totals USING (request_id) WHERE route <> 'invalid'
    UNION ALL SELECT request_id, 4, 'website_analysis', CASE WHEN route = 'invalid' THEN 'error' ELSE 'success' END, NULL, NULL, NULL FROM heads)"""


def _log(spark, folder, a):
    """The log with measured durations of the scraping."""
    times = table(spark, folder, "pages").select(
        _key().alias("request_id"), F.lit("content_scraping").alias("step"), (F.col("page_id") * 37 % 4000).alias("duration_ms")
    )
    return R.step_log(leads(spark, folder), a, _now(), times)


_enhanced = f"CASE WHEN status IN ('error', 'timeout', 'rate_limited') AND step = 'url_discovery' THEN {_why.replace('k WHEN', 'request_id % 10 WHEN')} END"


@query(
    "step_log",
    f"""WITH {LOG_SQL}, e AS (SELECT *, {_enhanced} AS code FROM steps)
    SELECT request_id::VARCHAR AS request_id, ord, step, status, a::BIGINT AS first_count, b::BIGINT AS second_count, c::BIGINT AS third_count,
    CASE WHEN step = 'content_scraping' THEN request_id * 37 % 4000 END::BIGINT AS duration_ms,
    CASE code WHEN 'http_429' THEN {Q.error_text("'http_429'")} WHEN 'request_timeout' THEN {Q.error_text("'request_timeout'")}
      WHEN 'rate_limit' THEN {Q.error_text("'rate_limit'")} END AS human_readable_error FROM e""",
)
def step_log(spark, folder):
    """The log made of the phases, its failed steps with what their code means."""
    a = analysis(spark, folder)
    codes = a["headers"].select("request_id", F.col("reason").alias("error_code"))
    log = _log(spark, folder, a).join(codes, "request_id", "left")
    log = log.withColumn("error_code", F.when(F.col("step") == "url_discovery", F.col("error_code")))
    counts = {
        "first_count": F.coalesce("urls_found", "input_urls", "urls_from_crawl"),
        "second_count": F.coalesce("output_urls", "successful_scrapes"),
        "third_count": F.col("failed_scrapes"),
    }
    return E.enhanced_log(log.withColumns(counts)).select("request_id", "ord", "step", "status", *counts, "duration_ms", "human_readable_error")


def reports(spark, folder):
    a = analysis(spark, folder)
    return R.build_reports(leads(spark, folder), a, stored(_log(spark, folder, a), "log"), _now())


def digest(found, *more):
    """The report in columns, its lists as text."""
    site, meta = F.col("website_analysis"), F.col("_metadata")
    pages = F.transform(
        site["scraped_content"],
        lambda p: F.concat_ws("|", p["url"], F.coalesce(p["status"], F.lit("ok")), F.coalesce(p["reason"], F.lit("-")), F.length(p["content"]).cast("string")),
    )
    steps = F.transform("_processing_log", lambda s: F.concat_ws(":", s["step"], s["status"]))
    resources = meta["resources"]
    return found.select(
        "request_id",
        meta["filename"].alias("filename"),
        meta["person_name"].alias("person_name"),
        F.array_join(site["discovered_urls"], " ").alias("discovered"),
        F.array_join(site["filtered_urls"], " ").alias("filtered"),
        F.array_join(pages, " ").alias("pages"),
        F.array_join(F.transform(site["filtered_urls"], lambda u: F.element_at(site["filter_reasons"], u)), "; ").alias("reasons"),
        site["discovery_status"].alias("discovery_status"),
        site["discovery_reason"].alias("discovery_reason"),
        site["error"].alias("website_error"),
        site["statistics"]["total_scraped"].alias("total_scraped"),
        resources["content_bytes_scraped"].alias("content_bytes"),
        format_bytes(resources["content_bytes_scraped"]).alias("content_size"),
        resources["urls_discovered"].alias("urls_discovered"),
        resources["scrape_success_rate"].alias("scrape_success_rate"),
        F.array_join(steps, " ").alias("steps"),
        meta["processing"]["statistics"]["total_duration_ms"].alias("total_duration_ms"),
        meta["processing"]["statistics"]["success_rate"].alias("success_rate"),
        F.array_join(meta["error_summary"]["error_codes"], ",").alias("codes"),
        F.col("linkedin_analysis.url").alias("profile"),
        F.col("error.message").alias("error_message"),
        *more,
    )


_size = f"""CASE WHEN coalesce(chars, 0) < 1024 THEN printf('%.2f B', coalesce(chars, 0)::DOUBLE)
  WHEN chars < 1048576 THEN printf('%.2f KB', round_even(chars::DOUBLE / 1024, 2)) ELSE printf('%.2f MB', round_even(chars::DOUBLE / 1048576, 2)) END"""
REPORT_SQL = f"""{LOG_SQL},
  said_ AS (SELECT request_id, string_agg(step || ':' || status, ' ' ORDER BY ord) AS steps, count(*) AS n, count(*) FILTER (status = 'success') AS good FROM steps GROUP BY 1),
  urls_ AS (SELECT request_id, string_agg(url, ' ' ORDER BY pos) AS discovered FROM found GROUP BY 1),
  kept_ AS (SELECT request_id, string_agg(url, ' ' ORDER BY rank) AS filtered, string_agg(reason, '; ' ORDER BY rank) AS reasons FROM kept GROUP BY 1),
  pages_ AS (SELECT request_id, string_agg(url || '|' || CASE status WHEN 'success' THEN 'ok' ELSE status END || '|' ||
      CASE status WHEN 'success' THEN '-' ELSE coalesce(reason, 'unknown') END || '|' || length(content), ' ' ORDER BY source, rank) AS pages,
    string_agg(coalesce(reason, 'unknown'), ',' ORDER BY source, rank) FILTER (status <> 'success') AS codes FROM analysed GROUP BY 1),
  report AS (SELECT page_id::VARCHAR AS request_id,
    'analysis_20240301_102030_' || 'Ann' || CASE WHEN page_id % 5 <> 0 THEN 'B' ELSE '' END || '_' || left(page_id::VARCHAR, 8) || '.json' AS filename,
    CASE WHEN page_id % 5 <> 0 THEN 'Ann' || page_id || ' Bell' END AS person_name,
    coalesce(discovered, '') AS discovered, coalesce(filtered, '') AS filtered, coalesce(pages_.pages, '') AS pages,
    CASE WHEN route <> 'invalid' THEN coalesce(reasons, '') WHEN route IS NULL OR route = 'invalid' THEN '' END AS reasons,
    CASE WHEN heads.status <> 'success' AND route <> 'invalid' THEN heads.status END AS discovery_status,
    CASE WHEN heads.status <> 'success' AND route <> 'invalid' THEN reason END AS discovery_reason,
    CASE WHEN route = 'invalid' THEN 'Invalid URL' END AS website_error,
    CASE WHEN route <> 'invalid' THEN total_scraped END AS total_scraped,
    coalesce(chars, 0)::BIGINT AS content_bytes, {_size} AS content_size,
    coalesce(CASE WHEN route <> 'invalid' THEN total_discovered END, 0)::BIGINT AS urls_discovered,
    {Q.percent('coalesce(total_scraped, 0)', 'coalesce(total_filtered, 0)')} AS scrape_success_rate,
    coalesce(steps, '') AS steps,
    CASE WHEN n > 0 THEN CASE WHEN route <> 'invalid' THEN page_id * 37 % 4000 ELSE 0 END END::BIGINT AS total_duration_ms,
    CASE WHEN n > 0 THEN {Q.percent('good', 'n')} END AS success_rate,
    nullif(concat_ws(',', CASE WHEN heads.status <> 'success' AND route <> 'invalid' THEN reason END, codes), '') AS codes,
    CASE WHEN page_id % 3 = 0 THEN 'linkedin.com/in/' || page_id END AS profile,
    CASE WHEN page_id % 17 = 3 THEN 'stopped midway' END AS error_message
    FROM pages LEFT JOIN heads ON heads.request_id = page_id LEFT JOIN totals ON totals.request_id = page_id
    LEFT JOIN said_ ON said_.request_id = page_id LEFT JOIN urls_ ON urls_.request_id = page_id
    LEFT JOIN kept_ ON kept_.request_id = page_id LEFT JOIN pages_ ON pages_.request_id = page_id)"""


@query("lead_report", f"WITH {REPORT_SQL} SELECT * FROM report")
def lead_report(spark, folder):
    """One nested report per lead, none dropped, in columns."""
    return digest(reports(spark, folder))


BROKEN = '{"request_id": '


def _saved(spark, folder):
    """Reports written twice, as a replay would, a broken line and an empty file."""
    path, _ = work_paths(spark, "reports")
    found = stored(reports(spark, folder), "reports")
    for _ in range(2):
        files.write_reports(found, path)
    day = f"{path}/report_date={NOW[:10]}"
    spark.sql("select :line as value", args={"line": BROKEN}).write.mode("append").text(day)
    spark.sql("select '' as value where false").write.mode("append").text(day)
    return path


@query(
    "report_roundtrip",
    f"""WITH {REPORT_SQL} SELECT request_id, person_name, discovered, pages, codes, error_message, NULL AS corrupt FROM report
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '{BROKEN}'""",
)
def report_roundtrip(spark, folder):
    """Reports as read back from their files; what is broken there is kept as text."""
    found = files.read_reports(spark, _saved(spark, folder))
    # the files are parsed once: a broken line keeps its id and its text
    shown = [F.when(F.col("corrupt").isNull(), F.col(c)).alias(c) for c in ("person_name", "discovered", "pages", "codes", "error_message")]
    return digest(found, F.col("_corrupt").alias("corrupt")).select("request_id", *shown, "corrupt")


@query(
    "expired_reports",
    """SELECT true AS has_files, true AS all_older_than_a_second_less, 0::BIGINT AS at_the_limit, 0::BIGINT AS of_another_name,
    (SELECT count(*) FROM pages) AS reports""",
)
def expired_reports(spark, folder):
    """Report files past retention, by the modification times of the files alone."""
    path = _saved(spark, folder)
    found = files.report_files(spark, path, "*.json")
    limit = F.col("modified") + F.make_interval(days=F.lit(30))
    late = R.expired(found, limit + F.make_interval(secs=F.lit(1)), 30)
    counts = files.count_reports(spark, path, "*.json").select(F.col("reports").alias("files"))
    rows = files.read_reports(spark, path).where("_corrupt is null").agg(F.count("request_id").alias("reports"))
    return (
        counts.join(late.agg(F.count("*").alias("late")))
        .join(R.expired(found, limit, 30).agg(F.count("*").alias("at_the_limit")))
        .join(files.count_reports(spark, path).select(F.col("reports").alias("of_another_name")))
        .join(rows)
        .select((F.col("files") > 0).alias("has_files"), (F.col("late") == F.col("files")).alias("all_older_than_a_second_less"),
                "at_the_limit", "of_another_name", "reports")
    )


@query(
    "zip_results",
    f"""WITH f AS (SELECT page_id, url AS page_url, {Q.link_targets('html')} AS l FROM pages),
    u AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS pos FROM f),
    r AS (SELECT page_id, unnest(range(0, len(l) + page_id % 3 - 1)) AS pos FROM f WHERE len(l) > 0)
    SELECT r.page_id::VARCHAR AS request_id, r.pos::BIGINT AS pos,
      CASE WHEN r.pos % 4 = 1 THEN 'given ' || r.pos ELSE coalesce(url, 'unknown') END AS url
    FROM r LEFT JOIN u ON u.page_id = r.page_id AND u.pos = r.pos""",
)
def zip_results(spark, folder):
    """Results next to the links of a page: one too few, as many, one too many."""
    links = discovery.outlinks(table(spark, folder, "pages"))
    urls = links.select(_key().alias("request_id"), F.col("pos").cast("long").alias("pos"), F.col("link").alias("url"))
    sizes = links.groupBy("page_id").agg(F.count("*").alias("n"))
    last = F.col("n") + F.col("page_id") % 3 - 2
    results = sizes.where(last >= 0).select(_key().alias("request_id"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos"))
    named = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("given "), F.col("pos").cast("string")))
    return C.zip_results(urls, results.withColumn("url", named)).select("request_id", "pos", "url")


_codes = "CASE event_type WHEN 'click' THEN 'http_429' WHEN 'error' THEN 'http_500' WHEN 'signup' THEN 'odd_code' WHEN 'purchase' THEN 'request_timeout' END"
_categories = "CASE code " + " ".join(f"WHEN '{row[0]}' THEN '{row[2]}'" for row in dims.ERROR_CATALOG) + " END"


@query(
    "report_codes",
    f"""WITH c AS (SELECT page_id AS r, -1 AS source, 0 AS rank, 'http_402' AS code FROM pages WHERE page_id % 3 > 0
      UNION ALL SELECT user_id, (value > 50)::INT, event_id, {_codes} FROM events WHERE event_type <> 'view' AND user_id IN (SELECT page_id FROM pages)),
    g AS (SELECT *, {_categories} AS category FROM c),
    k AS (SELECT r, category || '=' || string_agg(code, '+' ORDER BY source, rank) AS part, min((source, rank)) AS first FROM g WHERE category IS NOT NULL GROUP BY r, category),
    p AS (SELECT r, string_agg(part, ';' ORDER BY first) AS categories FROM k GROUP BY r)
    SELECT r::VARCHAR AS request_id, string_agg(code, ',' ORDER BY source, rank) AS codes, coalesce(any_value(categories), '') AS categories
    FROM c LEFT JOIN p USING (r) GROUP BY r""",
)
def report_codes(spark, folder):
    """Codes of a report: the discovery's, then both sources in their own order."""
    pages = table(spark, folder, "pages")
    headers = pages.select(
        _key().alias("request_id"), F.when(F.col("page_id") % 3 == 0, "success").otherwise("error").alias("status"), F.lit("http_402").alias("reason")
    )
    events = table(spark, folder, "events").join(pages.select(F.col("page_id").alias("user_id")), "user_id", "left_semi")
    results = events.select(
        F.col("user_id").cast("string").alias("request_id"),
        F.struct((F.col("value") > 50).cast("int").alias("source"), F.col("event_id").alias("rank")).alias("ord"),
        F.when(F.col("event_type") == "view", "success").otherwise("error").alias("status"),
        F.expr(_codes).alias("reason"),
    )
    found = E.report_codes(E.code_rows(headers, results))
    parts = F.transform(F.map_entries("s.categories"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return found.withColumn("s", error_summary(F.col("codes"))).select(
        "request_id", F.array_join("codes", ",").alias("codes"), F.array_join(parts, ";").alias("categories")
    )


@query(
    "nested_codes",
    """WITH c AS (SELECT user_id AS r, 'top_' || event_type AS code FROM events WHERE event_type <> 'view'
      UNION ALL SELECT user_id, 'mid_' || event_type FROM events WHERE event_id % 2 = 0
      UNION ALL SELECT user_id, 'deep_' || event_id % 5 FROM events WHERE event_id % 6 = 0
      UNION ALL SELECT user_id, 'last_' || event_id % 7 FROM events WHERE event_id % 30 = 0)
    SELECT DISTINCT r AS request_id, code FROM c""",
)
def nested_codes(spark, folder):
    """Codes of result trees of one to four levels."""
    kind, key = F.col("event_type"), F.col("event_id")
    code = lambda name, value: F.concat(F.lit(name + "_"), value.cast("string"))
    last = F.when(key % 5 == 0, F.array(F.struct(F.lit("lost").alias("status"), code("last", key % 7).alias("reason"))))
    deep = F.when(key % 3 == 0, F.array(F.struct(F.lit("error").alias("status"), code("deep", key % 5).alias("reason"), last.alias("results"))))
    middle = F.when(key % 2 == 0, F.array(F.struct(code("mid", kind).alias("reason"), deep.alias("results"))))
    top = F.struct(F.when(kind == "view", "success").otherwise("error").alias("status"), code("top", kind).alias("reason"), middle.alias("results"))
    trees = table(spark, folder, "events").select(F.col("user_id").alias("request_id"), F.to_json(F.array(top)).alias("results"))
    return E.distinct_codes(trees)


@query(
    "profile_stub",
    f"""SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'linkedin.com/in/' || page_id END AS url, 'not_implemented' AS status,
    CASE WHEN page_id % 4 = 1 THEN {Q.text(dims.LINKEDIN_PLAN)} END AS plan FROM pages""",
)
def profile_stub(spark, folder):
    given = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("linkedin.com/in/"), _key())).when(F.col("page_id") % 4 == 2, "")
    stub = table(spark, folder, "pages").select("page_id", linkedin_stub(given).alias("s"))
    return stub.select("page_id", "s.url", "s.status", F.col("s.implementation_plan").alias("plan"))


@query(
    "setting_words",
    f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ' , '), ','), lambda x: {Q.strip('x')}),
    lambda x: x <> ''), '|') AS words FROM pages""",
)
def setting_words(spark, folder):
    """A comma-separated setting as trimmed words, here made of the parts of a URL."""
    setting = F.replace("url", F.lit("/"), F.lit(" , "))
    return table(spark, folder, "pages").select("page_id", F.array_join(dims.comma_list(setting), "|").alias("words"))


_STREAMED = f"""{_EVENTS}
SELECT id AS request_id, 34::BIGINT AS urls_discovered, {dims.URLS_KEPT}::BIGINT AS urls_filtered,
  array_to_string(list_transform(range({dims.URLS_KEPT}), lambda i: 'no_api_key'), ',') AS codes, 'https://x' || user_id || '.com' AS site
FROM s JOIN events USING (event_id) WHERE s.event_type IN ('signup', 'purchase') AND id IS NOT NULL AND last_name <> ''
"""


@query("stream_reports", _STREAMED)
def stream_reports(spark, folder):
    """Every event is delivered twice; its lead is analysed once, without a crawl, and
    its report saved by micro-batch."""
    path, checkpoint = work_paths(spark, "stream-reports")
    events = _stream(spark, folder).withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2))))
    signed = _signed(events, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    new = I.intake_once(signed, KEY, _now(), "60 days")
    # in the batch's own session, whose partitions follow the leads
    I.write_report_stream(new, lambda batch: streamed_reports(batch.sparkSession, batch), path, checkpoint).awaitTermination()
    return streamed_digest(spark.read.schema(R.schemas.REPORT).json(path))


def streamed_reports(spark, batch):
    jobs = batch.select("request_id", F.lit(None).cast("string").alias("crawl_status"), F.lit(None).cast("string").alias("crawl_reason"))
    pages = spark.sql("select '' as request_id, 0 as pos, '' as url, '' as content, '' as status, true as has_content where false")
    results = spark.sql("select '' as request_id, '' as url, '' as status, '' as reason, '' as human_readable_error, '' as content, '' as format where false")
    a = analyze_websites(batch, jobs, pages, results)
    return R.build_reports(batch, a, R.step_log(batch, a, _now()), _now())


def streamed_digest(found):
    resources, meta = F.col("_metadata.resources"), F.col("_metadata")
    return found.select(
        "request_id",
        resources["urls_discovered"].alias("urls_discovered"),
        resources["urls_filtered"].alias("urls_filtered"),
        F.array_join(meta["error_summary"]["error_codes"], ",").alias("codes"),
        F.col("input_data.company_website").alias("site"),
    )
