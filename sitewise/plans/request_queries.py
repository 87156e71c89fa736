"""Request bodies, enriched step logs, readable sizes and calls that an open circuit blocks."""

from pyspark.sql import functions as F

from sitewise.functions import events as V
from sitewise.functions.text import format_bytes
from sitewise.operators import errors as O
from sitewise.operators import leads as L
from sitewise.plans import check_sql as S
from sitewise.plans.event_queries import CODES
from sitewise.plans.registry import query, table
from sitewise.sources.leads import read_leads
from sitewise.streaming.runner import work_paths

#: Request bodies by page: ``?`` is the page's URL. Whole, of the wrong form, lacking.
BODIES = (
    '{"first_name": " Ann ", "last_name": "Bell", "company_website": "?", "linkedin": null, "page": ',
    '{"first_name": 5, "last_name": true, "company_website": "?", "page": ',
    '{"first_name": "Ann", "last_name": ',
    '["Ann", "Bell", "?", ',
    '{"first_name": "Ann", "company_website": "?", "page": ',
    '{"first_name": "Ann", "last_name": "Bell", "company_website": "  ", "page": ',
    '{"first_name": "Ann", "last_name": "Bell", "company_website": {"url": "?"}, "page": ',
    '{"first_name": "  ", "last_name": null, "linkedin": "linkedin.com/in/bell", "page": ',
    '{"last_name": "Bell", "first_name": "Ann", "linkedin": " linkedin.com/in/bell ", "page": ',
)
_ENDS = ("}", "}", "", "]", "}", "}", "}", "}", "}")

_LINES = f"""
WITH l AS (SELECT page_id % {len(BODIES)} AS k, url,
  replace({S.word_list(BODIES)}[page_id % {len(BODIES)} + 1], '?', url) || page_id || {S.word_list(_ENDS)}[page_id % {len(BODIES)} + 1] AS line
  FROM pages WHERE url IS NOT NULL)
SELECT line, CASE k WHEN 7 THEN '' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'Ann' END AS first_name,
  CASE WHEN k IN (0, 5, 6, 8) THEN 'Bell' END AS last_name, CASE WHEN k IN (0, 1, 4) THEN url END AS company_website,
  CASE WHEN k IN (7, 8) THEN 'linkedin.com/in/bell' END AS linkedin,
  CASE k WHEN 1 THEN 'first_name: no text, last_name: no text' WHEN 2 THEN 'body: no object' WHEN 3 THEN 'body: no object'
    WHEN 4 THEN 'last_name: missing' WHEN 5 THEN 'source: none given' WHEN 6 THEN 'company_website: no text'
    WHEN 7 THEN 'first_name: blank, last_name: missing' ELSE '' END AS errors
FROM l
"""


@query("lead_requests", _LINES)
def lead_requests(spark, folder):
    """Request bodies as they come in a file, broken ones included, parsed and judged."""
    place = (F.col("page_id") % len(BODIES)).cast("int")
    body, end = (F.get(F.array(*[F.lit(x) for x in parts]), place) for parts in (BODIES, _ENDS))
    lines = table(spark, folder, "pages").where("url is not null").select(
        F.concat(F.replace(body, F.lit("?"), F.col("url")), F.col("page_id").cast("string"), end).alias("value")
    )
    path, _ = work_paths(spark, "requests")
    lines.write.text(path)
    found = L.requested(read_leads(spark, path))
    return found.withColumnRenamed("value", "line").withColumn("errors", F.array_join("errors", ", "))


_STEPS = ("linkedin_analysis", "url_discovery", "url_filtering", "content_scraping", "website_analysis")
_ENHANCED = f"""
WITH l AS (SELECT event_id, user_id AS request_id, {S.word_list(_STEPS)}[event_id % 5 + 1] AS step,
  CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'skipped' WHEN 'signup' THEN NULL ELSE 'error' END AS status,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 6 = 0 THEN '' ELSE {S.word_list(CODES)}[event_id % {len(CODES)} + 1] END AS given,
  'kept' AS title FROM events),
m AS (SELECT * EXCLUDE (given), CASE WHEN coalesce(status, '') <> 'success' AND given <> '' THEN given END AS error_code FROM l)
SELECT m.event_id, m.request_id, m.step, m.status, m.error_code, m.title,
  CASE WHEN c.code IS NULL THEN 'Unknown error: ' || m.error_code ELSE c.message || ' ' || a.guidance || '.' END AS human_readable_error,
  a.action AS action_code, a.title AS action_title, a.guidance AS action_description
FROM m LEFT JOIN {S.CATALOG} ON c.code = m.error_code LEFT JOIN {S.ACTIONS} ON a.action = c.action
"""


@query("enhanced_log", _ENHANCED)
def enhanced_log(spark, folder):
    """Events as step rows, whose own title stays beside that of the suggested action."""
    kind, key = F.col("event_type"), F.col("event_id")
    pick = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))
    log = table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("request_id"),
        pick(_STEPS).alias("step"),
        F.when(kind == "view", "success").when(kind == "click", "skipped").when(kind != "signup", "error").alias("status"),
        F.when(key % 7 == 0, None).when(key % 6 == 0, "").otherwise(pick(CODES)).alias("error_code"),
        F.lit("kept").alias("title"),
    )
    action = F.col("suggested_action")
    return O.enhanced_log(log).select(
        *log.columns,
        "human_readable_error",
        action["code"].alias("action_code"),
        action["title"].alias("action_title"),
        action["description"].alias("action_description"),
    )


_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
_BYTES = "floor(value * 1000)::BIGINT * (1::BIGINT << (event_id % 5 * 10)::INT) + event_id % 1000"
_SIZES = " ".join(
    f"WHEN bytes < {1024 ** (i + 1)} THEN printf('%.2f {u}', {S.rounded(f'bytes::DOUBLE / {1024 ** i}', 2)})" for i, u in enumerate(_UNITS[:-1])
)


@query(
    "size_format",
    f"""WITH b AS (SELECT event_id, {_BYTES} AS bytes FROM events)
    SELECT event_id, bytes, CASE {_SIZES} ELSE printf('%.2f PB', {S.rounded(f'bytes::DOUBLE / {1024 ** 5}', 2)}) END AS size FROM b""",
)
def size_format(spark, folder):
    power = F.array(*[F.lit(1024**i) for i in range(5)])
    scaled = F.floor(F.col("value") * 1000) * F.get(power, (F.col("event_id") % 5).cast("int"))
    sizes = table(spark, folder, "events").select("event_id", (scaled + F.col("event_id") % 1000).alias("bytes"))
    return sizes.withColumn("size", format_bytes(F.col("bytes")))


@query(
    "blocked_outcomes",
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'circuit_open' WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'success' ELSE 'error' END AS status,
    CASE event_type WHEN 'purchase' THEN 'circuit_breaker_open' WHEN 'error' THEN 'request_timeout' WHEN 'click' THEN 'http_error'
      WHEN 'view' THEN 'http_503' END AS reason FROM events""",
)
def blocked_outcomes(spark, folder):
    """Calls that an open circuit held back never reached the other side."""
    kind = F.col("event_type")
    fault = F.when(kind == "purchase", "circuit_open").when(kind == "error", "timeout").when(kind == "click", "network")
    status = F.when(kind == "view", 503).when(kind == "signup", 200)
    found = V.fetch_outcome(status, F.lit(True), F.lit(True), fault, F.lit("no message"))
    return table(spark, folder, "events").select("event_id", found.alias("o")).select("event_id", "o.*")
