"""URL normalisation, parts, classes and de-duplication over the pages table."""

from pyspark.sql import functions as F

from sitewise.dims import (
    CATEGORY_KEYWORDS,
    SIMPLE_HOSTS,
    SIMPLE_PATHS,
    VALUABLE_DISCOVERY_WORDS,
    literal_rows,
)
from sitewise.functions import urls as U
from sitewise.operators import discovery, keyed
from sitewise.operators import urls as url_ops
from sitewise.plans import check_sql as Q
from sitewise.plans.registry import query, table

# corner cases the tables do not hold
LITERAL_URLS = [
    (-1, "HTTP://Ex.com/A"),
    (-2, "mailto:x@y"),
    (-3, "//a.com"),
    (-4, "https://a.com/a b|c"),
    (-5, "http://a.com/x;p?q#f"),
    (-6, "http://a.com/x?"),
    (-7, "https://[bad"),
    (-8, "\xa0example.com "),
    (-9, ""),
    (-10, "   "),
    (-11, "javascript:alert('xss')"),
    (-12, "not-a-url"),
    (-13, "http://a.com;"),
    (-14, "http://a.com/x;;?#"),
    (-15, "https://u@[::1]:8080/#"),
    (-16, "https://example.com/2024/about-us/?page=1#team"),
    (-17, "FTP://files.example.com/x"),
    (-18, "https://www.a.www.com/feature/blog"),
]

# the same URL in the spellings that intake meets, by page number
_SPELLINGS = [
    ("url", "url"),
    ("regexp_replace(url, '^https?://', '')", "regexp_replace(url, '^https?://', '')"),
    ("concat('  ', url, ' ')", "'  ' || url || ' '"),
    ("concat('javascript:', url)", "'javascript:' || url"),
    ("replace(url, 'http', 'HTTP')", "replace(url, 'http', 'HTTP')"),
    ("concat(url, ';')", "url || ';'"),
    (
        "concat(regexp_replace(url, '[?#].*$', ''), '?#')",
        "regexp_replace(url, '[?#].*$', '') || '?#'",
    ),
    ("concat(left(url, 12), '\\t', substr(url, 13))", "left(url, 12) || chr(9) || substr(url, 13)"),
]


def raw_urls(spark, folder):
    """(id, raw): every page URL in one spelling, and the corner cases."""
    cases = " ".join(f"when {i} then {s}" for i, (s, _) in enumerate(_SPELLINGS))
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"),
        F.expr(f"case page_id % {len(_SPELLINGS)} {cases} end").alias("raw"),
    )
    return pages.unionByName(literal_rows(spark, LITERAL_URLS, "id bigint, raw string"))


_raw_cases = " ".join(f"WHEN {i} THEN {d}" for i, (_, d) in enumerate(_SPELLINGS))
RAW_SQL = (
    f"raw_urls AS (SELECT page_id AS id, CASE page_id % {len(_SPELLINGS)} {_raw_cases} END AS raw "
    f"FROM pages UNION ALL SELECT * FROM (VALUES {Q.values(LITERAL_URLS)}) AS v(id, raw))"
)


@query("url_normalize", f"WITH {RAW_SQL} SELECT id, raw, {Q.safe_url('raw')} AS url FROM raw_urls")
def url_normalize(spark, folder):
    return raw_urls(spark, folder).withColumn("url", U.safe_url(F.col("raw")))


@query(
    "url_valid",
    f"WITH {RAW_SQL} SELECT id, {Q.matches(Q.ready('raw'), '(?i)^https?://')} "
    f"AND {Q.netloc('raw')} <> '' AND NOT {Q.bad_brackets(Q.netloc('raw'))} AS valid FROM raw_urls",
)
def url_valid(spark, folder):
    return raw_urls(spark, folder).select("id", U.is_valid_url(F.col("raw")).alias("valid"))


@query(
    "url_domain",
    f"WITH {RAW_SQL} SELECT id, {Q.domain('raw')} AS domain, {Q.site_key('raw')} AS site "
    "FROM raw_urls",
)
def url_domain(spark, folder):
    raw = F.col("raw")
    return raw_urls(spark, folder).select(
        "id", U.domain(raw).alias("domain"), U.site_key(raw).alias("site")
    )


@query(
    "outlinks",
    f"""WITH f AS (SELECT page_id, url AS page_url, {Q.link_targets('html')} AS l FROM pages),
    g AS (SELECT page_id, page_url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM f)
    SELECT page_id, pos, link, {Q.resolve('page_url', 'link')} AS url FROM g""",
)
def outlinks(spark, folder):
    found = discovery.outlinks(table(spark, folder, "pages"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "link", "url")


# links as pages carry them, every third turned to another host or another spelling
_TARGET = (
    "case pos % 4 when 1 then replace(url, '://', '://www.') "
    "when 2 then replace(url, 'example', 'elsewhere') else url end"
)


@query(
    "same_site_filter",
    f"""WITH f AS (SELECT page_id, url AS page_url, {Q.link_targets('html')} AS l FROM pages),
    g AS (SELECT page_id, page_url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM f),
    h AS (SELECT page_id, page_url, pos, {Q.resolve('page_url', 'link')} AS url FROM g),
    t AS (SELECT page_id, pos, page_url, {_TARGET} AS target FROM h)
    SELECT page_id, pos, target FROM t
    WHERE coalesce({Q.site_key('target')} = {Q.site_key('page_url')}, false)""",
)
def same_site_filter(spark, folder):
    links = discovery.outlinks(table(spark, folder, "pages")).withColumn(
        "target", F.expr(_TARGET)
    )
    return links.where(U.is_same_domain(F.col("target"), F.col("page_url"))).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "target"
    )


def _host_urls(spark, folder):
    """(host, pos, url): every page URL and its bare spelling, by host."""
    pages = table(spark, folder, "pages")
    both = F.array(F.col("url"), F.regexp_replace("url", r"/?[?#].*$", ""))
    return pages.select(
        U.netloc(F.col("url")).alias("host"),
        F.col("page_id"),
        F.posexplode(both).alias("variant", "url"),
    ).select("host", (F.col("page_id") * 2 + F.col("variant")).alias("pos"), "url")


HOST_URLS_SQL = (
    f"host_urls AS (SELECT {Q.netloc('url')} AS host, page_id * 2 AS pos, url FROM pages "
    f"UNION ALL SELECT {Q.netloc('url')}, page_id * 2 + 1, {Q.sub('url', '/?[?#].*$', '', '')} "
    "FROM pages)"
)


def _first_sql(key):
    return (
        f"WITH {HOST_URLS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY host, {key} "
        "ORDER BY pos) AS rn FROM host_urls) SELECT host, pos, url FROM k WHERE rn = 1"
    )


@query("url_dedup_first", _first_sql(Q.first_seen_key("url")))
def url_dedup_first(spark, folder):
    unique = url_ops.dedup_first_seen(_host_urls(spark, folder), ["host"])
    return unique.select("host", "pos", "url")


@query("url_dedup_similar", _first_sql(Q.similar_key("url")))
def url_dedup_similar(spark, folder):
    unique = url_ops.dedup_similar(_host_urls(spark, folder), ["host"])
    return unique.select("host", "pos", "url")


def classified_urls(spark, folder):
    """(id, url): the usual pages of every page's site, their links, corner cases."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("website")
    )
    usual = discovery.candidate_urls(pages).select("id", "url")
    links = discovery.outlinks(table(spark, folder, "pages")).select(
        F.col("page_id").alias("id"), "url"
    )
    literal = literal_rows(spark, LITERAL_URLS, "id bigint, url string")
    return usual.unionByName(links).unionByName(literal)


def candidate_sql(columns, source, site):
    from sitewise.dims import CANDIDATE_PATHS, MINIMAL_HOST

    return (
        f"SELECT {columns}, unnest(CASE WHEN lower({Q.netloc(site)}) = {Q.text(MINIMAL_HOST)} "
        f"THEN [{site}] ELSE list_transform({Q.word_list(CANDIDATE_PATHS)}, "
        f"lambda x: {Q.origin(site)} || x) END) AS url FROM {source}"
    )


CLASSIFIED_SQL = f"""c AS ({candidate_sql('page_id AS id', 'pages', 'url')}
    UNION ALL SELECT page_id, {Q.resolve('url', 'link')} FROM
      (SELECT page_id, url, unnest({Q.link_targets('html')}) AS link FROM pages)
    UNION ALL SELECT * FROM (VALUES {Q.values(LITERAL_URLS)}) AS v(id, raw)),
    p AS (SELECT id, url, lower({Q.path('lower(url)')}) AS p, {Q.path('url')} AS bare FROM c)"""

_has = "len(list_filter({words}, lambda w: contains(p, w))) > 0"


@query(
    "url_category",
    f"WITH {CLASSIFIED_SQL} SELECT id, url, CASE "
    + " ".join(
        f"WHEN {_has.format(words=Q.word_list(words))} THEN '{name}'"
        for name, words in CATEGORY_KEYWORDS
    )
    + " ELSE 'other' END AS category FROM p",
)
def url_category(spark, folder):
    return classified_urls(spark, folder).withColumn("category", U.url_category(F.col("url")))


@query(
    "url_valuable",
    f"WITH {CLASSIFIED_SQL} SELECT id, url, {_has.format(words=Q.word_list(VALUABLE_DISCOVERY_WORDS))} "
    f"OR {Q.matches('p', '/20[0-9]{2}/')} AS valuable FROM p",
)
def url_valuable(spark, folder):
    return classified_urls(spark, folder).withColumn(
        "valuable", U.is_valuable_discovery_url(F.col("url"))
    )


@query(
    "url_simple",
    f"WITH {CLASSIFIED_SQL} SELECT id, url, lower({Q.netloc('url')}) IN "
    f"({', '.join(map(Q.text, SIMPLE_HOSTS))}) OR trim(lower(bare), '/') IN "
    f"({', '.join(map(Q.text, [''] + SIMPLE_PATHS))}) AS simple FROM p",
)
def url_simple(spark, folder):
    return classified_urls(spark, folder).withColumn(
        "simple", U.is_simple_scrape_url(F.col("url"))
    )


@query(
    "site_members",
    f"""WITH s AS (SELECT {Q.site_key('url')} AS site, count(*) AS pages, min(page_id) AS first_page
      FROM pages GROUP BY 1),
    l AS (SELECT page_id AS lead, replace(url, '://', '://www.') AS website FROM pages)
    SELECT lead, website, coalesce(pages, 0) AS pages, first_page
    FROM l LEFT JOIN s ON s.site = {Q.site_key('website')}""",
)
def site_members(spark, folder):
    pages = table(spark, folder, "pages")
    leads = pages.select(
        F.col("page_id").alias("lead"),
        F.replace("url", F.lit("://"), F.lit("://www.")).alias("company_website"),
    )
    return url_ops.pages_per_lead(leads, pages).select(
        "lead", F.col("company_website").alias("website"), "pages", "first_page"
    )


def hosts(spark, folder):
    """(host, website, first_page): one row per host of the pages table."""
    return (
        table(spark, folder, "pages")
        .groupBy(U.netloc(F.col("url")).alias("host"))
        .agg(F.min("page_id").alias("first_page"))
        .withColumn("website", F.concat(F.lit("https://"), "host"))
    )


HOSTS_SQL = (
    f"hosts AS (SELECT {Q.netloc('url')} AS host, min(page_id) AS first_page, "
    f"'https://' || {Q.netloc('url')} AS website FROM pages GROUP BY 1, 3)"
)


def with_minimal_host(spark, sites):
    return sites.unionByName(
        literal_rows(
            spark,
            [("example.com", "https://example.com/x?y")],
            "host string, website string",
        ),
        allowMissingColumns=True,
    )


_SITES_SQL = (
    f"{HOSTS_SQL}, s AS (SELECT host, website FROM hosts UNION ALL "
    "SELECT 'example.com', 'https://example.com/x?y')"
)


@query(
    "candidate_urls",
    f"WITH {_SITES_SQL}, c AS ({candidate_sql('host, website', 's', 'website')}) "
    "SELECT host, url, CASE WHEN host = 'example.com' THEN 'example_com_minimal' "
    "ELSE 'fallback_patterns' END AS method FROM c",
)
def candidate_urls(spark, folder):
    sites = with_minimal_host(spark, hosts(spark, folder).drop("first_page"))
    return discovery.candidate_urls(sites).select("host", "url", "method")


@query(
    "sitemap_hints",
    f"""WITH {HOSTS_SQL} SELECT host, website || unnest(
    ['/sitemap.xml', '/sitemap_index.xml', '/sitemap', '/robots.txt']) AS url FROM hosts""",
)
def sitemap_hints(spark, folder):
    return discovery.sitemap_hints(hosts(spark, folder)).select("host", "url")


def place(source, page, pos):
    """A position that orders by source, page and place there, however many links."""
    long = lambda x: (F.lit(x) if isinstance(x, int) else F.col(x)).cast("long")
    return F.struct(F.lit(source).alias("source"), long(page).alias("page"), long(pos).alias("pos"))


def discovered_urls(spark, folder):
    """(request_id, website, pos, url) per host: usual pages, then page links."""
    sites = hosts(spark, folder)
    usual = discovery.candidate_urls(sites).select(
        F.col("host").alias("request_id"),
        "website",
        place(0, 0, "pos").alias("pos"),
        "url",
    )
    links = discovery.outlinks(table(spark, folder, "pages"))
    host = U.netloc(F.col("page_url"))
    links = links.select(
        host.alias("request_id"),
        F.concat(F.lit("https://"), host).alias("website"),
        place(1, "page_id", "pos").alias("pos"),
        U.safe_url(F.col("url")).alias("url"),
    ).where("url is not null")
    both = usual.unionByName(links)
    return keyed.keep_first(
        both.withColumn("_key", U.first_seen_key(F.col("url"))),
        ["request_id", "website"],
        "_key",
        "pos",
    ).drop("_key")
