"""Content, page-result and lead plans over pages, documents and the events log."""

from pyspark.sql import functions as F

from sitewise.functions import html as H
from sitewise.functions import text as T
from sitewise.functions.events import report_name
from sitewise.operators import content as C
from sitewise.operators import leads as L
from sitewise.plans import check_sql as S
from sitewise.plans.registry import query, table

NOW = "2024-03-01 10:20:30"


def _pages(spark, folder, name, value):
    return table(spark, folder, "pages").select("page_id", value.alias(name))


def _docs(spark, folder, name, value):
    return table(spark, folder, "documents").select("doc_id", value.alias(name))


@query("html_markdown", f"SELECT page_id, {S.html_to_markdown('html')} AS markdown FROM pages")
def html_markdown(spark, folder):
    return _pages(spark, folder, "markdown", H.html_to_markdown(F.col("html")))


@query("html_text", f"SELECT page_id, {S.html_to_text('html')} AS plain FROM pages")
def html_text(spark, folder):
    return _pages(spark, folder, "plain", H.html_to_text(F.col("html")))


@query("html_entities", f"SELECT page_id, {S.unescape('html')} AS decoded FROM pages")
def html_entities(spark, folder):
    return _pages(spark, folder, "decoded", H.unescape(F.col("html")))


@query("clean_text", f"SELECT doc_id, {S.clean_text('text')} AS cleaned FROM documents")
def clean_text(spark, folder):
    return _docs(spark, folder, "cleaned", T.clean_text(F.col("text")))


@query("clean_markdown", f"SELECT doc_id, {S.clean_markdown('text')} AS cleaned FROM documents")
def clean_markdown(spark, folder):
    return _docs(spark, folder, "cleaned", T.clean_markdown(F.col("text")))


@query("truncate", f"SELECT doc_id, {S.truncate('text', 200)} AS cut FROM documents")
def truncate(spark, folder):
    return _docs(spark, folder, "cut", T.truncate(F.col("text"), 200))


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_PHONE = r"\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b"


def _sorted_sql(pattern):
    return f"array_to_string(list_sort(list_distinct({S.extract_all('text', pattern)})), ' ')"


@query(
    "contacts",
    f"SELECT doc_id, {_sorted_sql(_EMAIL)} AS emails, {_sorted_sql(_PHONE)} AS phones FROM documents",
)
def contacts(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.array_join(T.emails(F.col("text")), " ").alias("emails"),
        F.array_join(T.phone_numbers(F.col("text")), " ").alias("phones"),
    )


def _platform_sql(name):
    found = S.extract_all("t", rf'(?i)(?:https?://)?(?:www\.)?{name}\.com/[^{S.WS}<>"{{}}|\\^`\[\]]+')
    return f"list_transform({found}, lambda x: '{name} ' || x)"


_SOCIAL = f"""
WITH p AS (SELECT page_id, 'at https://www.linkedin.com/company/' || page_id || ' GitHub.com/a' || page_id
  || ', http://twitter.com/t (instagram.com/i) facebook.com/f ' || html AS t FROM pages)
SELECT page_id, array_to_string(list_concat(list_concat(list_concat(list_concat(
  {_platform_sql('linkedin')}, {_platform_sql('twitter')}), {_platform_sql('facebook')}),
  {_platform_sql('instagram')}), {_platform_sql('github')}), chr(10)) AS links FROM p
"""


@query("social_links", _SOCIAL)
def social_links(spark, folder):
    """Links of every page, whose text begins with one of each platform."""
    key = F.col("page_id").cast("string")
    text = F.concat(
        F.lit("at https://www.linkedin.com/company/"), key, F.lit(" GitHub.com/a"), key,
        F.lit(", http://twitter.com/t (instagram.com/i) facebook.com/f "), F.col("html"),
    )
    shown = F.transform(T.social_links(text), lambda x: F.concat(x["platform"], F.lit(" "), x["url"]))
    return _pages(spark, folder, "links", F.array_join(shown, "\n"))


_SECTIONS = f"""
WITH p AS (SELECT page_id, {S.html_to_markdown('html')} AS t FROM pages)
SELECT page_id, array_to_string(({S.extract_all('t', rf'(?m)^#{{1,3}}[{S.WS}]+(.+)$', 1)})[1:10], chr(10))
  AS sections FROM p
"""


@query("key_sections", _SECTIONS)
def key_sections(spark, folder):
    found = T.key_sections(H.html_to_markdown(F.col("html")))
    return _pages(spark, folder, "sections", F.array_join(found, "\n"))


def _phrase_sql(lead, rest):
    return S.extract_all("t", rf"(?i)(?:{lead})[{S.WS}]+({rest})", 1)


_DESCRIPTIONS = f"""
WITH d AS (SELECT doc_id, text || ' we are ' || source || ' people. Founded in 1999 in ' || lang
  || '. Mission: ' || text || '.' AS t FROM documents),
f AS (SELECT doc_id, list_concat(list_concat({_phrase_sql("We are|Our company is|We're", "[^.]+[.]")},
  {_phrase_sql("Our mission is|Mission:", "[^.]+[.]")}),
  {_phrase_sql("Founded in|Established in", "[0-9]{4}[^.]*[.]")}) AS found FROM d)
SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(found[1:3], chr(10)) END AS described FROM f
"""


@query("descriptions", _DESCRIPTIONS)
def descriptions(spark, folder):
    """Company phrases of every document, to which three phrases are added."""
    text = F.concat(
        "text", F.lit(" we are "), "source", F.lit(" people. Founded in 1999 in "), "lang",
        F.lit(". Mission: "), "text", F.lit("."),
    )
    return _docs(spark, folder, "described", F.array_join(T.company_descriptions(text), "\n"))


_SUMMARY = f"""
WITH p AS (SELECT page_id, {S.html_to_markdown('html')} AS t FROM pages),
l AS (SELECT page_id, t, list_filter(list_transform(
    regexp_split_to_array(substr(t, strpos(t, '#') + 1), '[#\\n]'), lambda x: {S.strip('x')}),
    lambda x: length(x) > 50)[1] AS line,
  {S.sub('t', r'^[#*\- \n]+', '', '')} AS opening FROM p)
SELECT page_id, CASE WHEN coalesce(t, '') = '' THEN 'No content available'
  WHEN contains(t, '#') AND line IS NOT NULL THEN {S.truncate('line', 500)}
  ELSE {S.truncate('opening', 500)} END AS summary FROM l
"""


@query("content_summary", _SUMMARY)
def content_summary(spark, folder):
    marked = _pages(spark, folder, "t", H.html_to_markdown(F.col("html")))
    return marked.select("page_id", T.content_summary(F.col("t")).alias("summary"))


#: Documents as page results: a source is a request, French ones were refused.
_RESULTS = """
WITH r AS (SELECT source AS request_id, doc_id AS pos, 'https://' || source || '/' || doc_id AS url,
  CASE WHEN lang = 'fr' THEN 'error' ELSE 'success' END AS status, text AS content,
  CASE WHEN lang = 'fr' THEN NULL ELSE length(coalesce(text, '')) END AS n FROM documents)
"""


def _results(spark, folder):
    refused = F.coalesce(F.col("lang") == "fr", F.lit(False))
    return table(spark, folder, "documents").select(
        F.col("source").alias("request_id"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(refused, "error").otherwise("success").alias("status"),
        F.when(refused, "http_402").alias("reason"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("format"),
        F.lit(None).cast("string").alias("human_readable_error"),
    )


_QUALITY = f"""{_RESULTS}
SELECT request_id, count(*) AS total_urls, count(n) AS successful_scrapes,
  count(*) FILTER (n = 0) AS empty_content, count(*) FILTER (n > 0 AND n < 100) AS low_quality,
  count(*) FILTER (n > 1000) AS high_quality,
  coalesce(round_even(avg(n), 0), 0)::BIGINT AS average_content_length,
  {S.percent('count(n)', 'count(*)')} AS success_rate
FROM r GROUP BY 1
"""


@query("content_quality", _QUALITY)
def content_quality(spark, folder):
    return C.content_quality(_results(spark, folder))


_ISSUES = f"""{_RESULTS}
SELECT request_id, pos, CASE WHEN n = 0 THEN 'Empty content: ' || url
  ELSE 'Very short content (' || n || ' chars): ' || url END AS issue FROM r WHERE n < 100
"""


@query("content_issues", _ISSUES)
def content_issues(spark, folder):
    return C.content_issues(_results(spark, folder))


_STATS = f"""{_RESULTS}
SELECT request_id, count(*) AS total, count(n) AS success, count(*) - count(n) AS failed,
  {S.percent('count(n)', 'count(*)')} AS success_rate FROM r GROUP BY 1
"""


@query("scrape_stats", _STATS)
def scrape_stats(spark, folder):
    return C.scrape_stats(_results(spark, folder))


_SHAPED = f"""{_RESULTS}
SELECT request_id, pos, status,
  CASE WHEN status = 'success' THEN {S.clean_markdown('(' + S.clean_text("coalesce(content, '')") + ')')}
    ELSE '' END AS content,
  CASE WHEN status = 'success' THEN 'markdown' END AS format,
  CASE WHEN status = 'error' THEN 'http_402' END AS reason,
  CASE WHEN status = 'error' THEN {S.error_text("'http_402'")} END AS human_readable_error
FROM r
"""


@query("page_results", _SHAPED)
def page_results(spark, folder):
    return C.shaped_pages(_results(spark, folder)).drop("url", "content_length")


#: A view or purchase of a page is a crawl copy of it.
_COPIES = """
WITH c AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k
  FROM events WHERE event_type IN ('view', 'purchase'))
"""


def _kept_and_copies(spark, folder):
    kept = table(spark, folder, "pages").select(
        F.col("page_id").alias("request_id"), "url", F.col("page_id").alias("rank")
    )
    events = table(spark, folder, "events").where(F.col("event_type").isin("view", "purchase"))
    copies = events.join(kept, F.col("user_id") == F.col("request_id")).select(
        "request_id", "url", F.col("event_id").alias("pos"), F.col("props").alias("content"),
        F.lit(None).cast("string").alias("status"),
    )
    return kept, copies


@query(
    "content_reuse",
    f"""{_COPIES} SELECT page_id AS request_id, url, page_id AS rank, coalesce(props, '') AS content,
    'success' AS status FROM pages JOIN c ON user_id = page_id AND k = 1""",
)
def content_reuse(spark, folder):
    return C.reuse_crawl_content(*_kept_and_copies(spark, folder))


@query(
    "pages_to_scrape",
    f"{_COPIES} SELECT page_id AS request_id, url, page_id AS rank FROM pages WHERE page_id NOT IN (SELECT user_id FROM c)",
)
def pages_to_scrape(spark, folder):
    return C.urls_to_scrape(*_kept_and_copies(spark, folder))


#: Pages as leads: the first path part and the host are names, repeated past the limit.
_LEADS = f"""
WITH r AS (SELECT page_id, ' ' || {S.extract('url', '^https?://[^/]+/([^/]*)', 1)} || ' ' AS f,
  repeat({S.extract('url', '^https?://([^/]+)', 1)}, (1 + page_id % 9)::INT) AS l,
  CASE WHEN page_id % 4 < 2 THEN ' ' || url ELSE ' ' END AS w,
  CASE WHEN page_id % 3 = 0 THEN 'linkedin.com/in/' || page_id END AS i FROM pages),
t AS (SELECT page_id, length(l) AS n, {S.strip('f')} AS first_name, {S.strip('l')} AS last_name, w AS web, i AS profile,
  nullif({S.strip('w')}, '') AS company_website, i AS linkedin,
  list_filter([CASE WHEN length(f) > 100 THEN 'first_name: too long' WHEN {S.strip('f')} = '' THEN 'first_name: blank' END,
    CASE WHEN length(l) < 1 THEN 'last_name: too short' WHEN length(l) > 100 THEN 'last_name: too long' END,
    CASE WHEN length(w) > 500 THEN 'company_website: too long' END], lambda x: x IS NOT NULL) AS e FROM r),
v AS (SELECT *, CASE WHEN len(e) = 0 AND company_website IS NULL AND linkedin IS NULL
  THEN 'source: none given' ELSE array_to_string(e, ', ') END AS errors FROM t)
"""


def _leads(spark, folder):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    part = F.regexp_extract("url", "^https?://[^/]+/([^/]*)", 1)
    key = F.col("page_id")
    return table(spark, folder, "pages").select(
        "page_id",
        F.concat(F.lit("req-"), key.cast("string")).alias("request_id"),
        F.concat(F.lit(" "), part, F.lit(" ")).alias("first_name"),
        F.repeat(host, (key % 9 + 1).cast("int")).alias("last_name"),
        F.when(key % 4 < 2, F.concat(F.lit(" "), "url")).otherwise(" ").alias("company_website"),
        F.when(key % 3 == 0, F.concat(F.lit("linkedin.com/in/"), key.cast("string"))).alias("linkedin"),
    )


@query("lead_validate", f"{_LEADS} SELECT page_id, first_name, last_name, company_website, linkedin, errors FROM v")
def lead_validate(spark, folder):
    out = L.validated(_leads(spark, folder))
    return out.drop("request_id").withColumn("errors", F.array_join("errors", ", "))


_ACCEPT = f"""{_LEADS}
SELECT page_id, 'req-' || page_id AS request_id, first_name, last_name,
  {S.safe_url('company_website')} AS company_website, {S.safe_url('linkedin')} AS linkedin,
  '2024-03-01T10:20:30+00:00' AS timestamp,
  'Registration accepted for ' || first_name || ' ' || last_name || '. Processing in background.' AS message,
  concat_ws(', ', 'website: ' || {S.safe_url('company_website')}, 'linkedin: ' || {S.safe_url('linkedin')}) AS sources
FROM v WHERE errors = ''
"""


@query("lead_accept", _ACCEPT)
def lead_accept(spark, folder):
    return L.accepted(_leads(spark, folder), F.lit(NOW).cast("timestamp"))


_NAMES = f"""{_LEADS}
SELECT page_id, 'analysis_20240301_102030_' || CASE WHEN {S.capitalised('first_name', 10)} <> ''
  THEN {S.capitalised('first_name', 10)} || {S.capitalised('last_name', 1)} || '_' ELSE '' END
  || left('req-' || page_id, 8) || '.json' AS file FROM v
"""


@query("report_name", _NAMES)
def report_names(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    name = report_name(F.col("request_id"), F.col("first_name"), F.col("last_name"), now)
    return _leads(spark, folder).select("page_id", name.alias("file"))
