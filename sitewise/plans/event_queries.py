"""Error, outcome, retry and step plans over the events log.

A user is a client, request or job; an event is a call, a step or a poll. Its error
code is the one at the place that its id sets in the catalogue, after which one
unknown code follows.
"""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import errors as E
from sitewise.functions import events as V
from sitewise.operators import errors as O
from sitewise.operators import leads as L
from sitewise.operators import runs as R
from sitewise.plans import check_sql as S
from sitewise.plans.registry import query, table
from sitewise.streaming.rates import request_rates

CODES = [row[0] for row in dims.ERROR_CATALOG] + ["odd_code"]
KEY = "signing key of the check"

_CODED = f"""
WITH k AS (SELECT event_id, user_id, {S.word_list(CODES)}[event_id % {len(CODES)} + 1] AS code FROM events),
e AS (SELECT k.*, c.message, c.category, c.action, coalesce(c.severity, 'medium') AS severity
      FROM k LEFT JOIN {S.CATALOG} ON c.code = k.code),
f AS (SELECT e.*, s.priority, a.title, a.guidance FROM e
      LEFT JOIN {S.ACTIONS} ON a.action = e.action LEFT JOIN {S.SEVERITIES} ON s.severity = e.severity)
"""


def _coded(spark, folder):
    codes = F.array(*[F.lit(c) for c in CODES])
    place = (F.col("event_id") % len(CODES)).cast("int")
    return table(spark, folder, "events").select("event_id", "user_id", F.get(codes, place).alias("code"))


@query(
    "error_enrich",
    f"""{_CODED} SELECT event_id, user_id, code, message, category, action, severity, priority, title, guidance,
    coalesce(message || ' ' || guidance || '.', 'Unknown error: ' || code) AS text FROM f""",
)
def error_enrich(spark, folder):
    rich = O.enrich_codes(_coded(spark, folder))
    return rich.select(
        "event_id", "user_id", "code", "message", "category", "action", "severity", "priority", "title", "guidance", "text"
    )


_PAYMENT, _LIMITED = (f"code IN ({', '.join(S.text(c) for c in x)})" for x in (dims.PAYMENT_CODES, dims.RATE_LIMIT_CODES))

_TOTALS = f"""{_CODED}
SELECT user_id AS request_id, count(*) AS total_errors, count(DISTINCT code) AS distinct_codes,
  count(*) FILTER (category IS NULL) AS unknown_errors, count(*) FILTER ({_PAYMENT}) AS payment_errors,
  count(*) FILTER ({_LIMITED}) AS rate_limit_errors, max(priority)::INT AS max_priority,
  arg_max(severity, priority) AS max_severity,
  array_to_string(list_sort(list(DISTINCT action) FILTER (action IS NOT NULL)), ',') AS recommended_actions,
  array_to_string(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), ',') AS categories
FROM f GROUP BY 1
"""


@query("error_totals", _TOTALS)
def error_totals(spark, folder):
    rows = _coded(spark, folder).withColumnsRenamed({"user_id": "request_id", "event_id": "ord"})
    joined = {c: F.array_join(c, ",") for c in ("recommended_actions", "categories")}
    return O.error_totals(rows).withColumns(joined)


#: Reports of three codes: an event's own and those after it in the catalogue.
_NEXT = f"[{', '.join(f'{S.word_list(CODES)}[(event_id + {i} * user_id) % {len(CODES)} + 1]' for i in range(3))}]"
_LOOK = f"""
WITH r AS (SELECT event_id, {_NEXT} AS codes FROM events),
x AS (SELECT event_id, codes, unnest(codes) AS code, generate_subscripts(codes, 1) AS place FROM r),
f AS (SELECT x.*, c.category, c.action, s.priority, s.severity FROM x LEFT JOIN {S.CATALOG} ON c.code = x.code
      JOIN {S.SEVERITIES} ON s.severity = coalesce(c.severity, 'medium')),
g AS (SELECT event_id, any_value(array_to_string(codes, ',')) AS codes, max(priority)::INT AS max_priority,
  arg_max(severity, priority) AS max_severity, bool_or({_PAYMENT}) AS pay, bool_or({_LIMITED}) AS limited,
  coalesce(array_to_string(list_sort(list(DISTINCT action) FILTER (action IS NOT NULL)), ','), '') AS actions,
  list(category ORDER BY place) FILTER (category IS NOT NULL) AS seen FROM f GROUP BY 1),
h AS (SELECT *, list_filter(coalesce(seen, []), lambda c, i: list_position(seen, c) = i) AS names FROM g)
SELECT event_id, codes, max_priority, max_severity, pay AS has_payment_issues, limited AS has_rate_limit_issues,
  actions AS recommended_actions, array_to_string(names, ',') AS categories,
  CASE WHEN pay THEN {S.text(dims.PAYMENT_MESSAGE)} WHEN limited THEN {S.text(dims.RATE_LIMIT_MESSAGE)}
    WHEN list_contains(names, 'server_error') THEN {S.text(dims.SERVER_MESSAGE)}
    WHEN list_contains(names, 'configuration') THEN {S.text(dims.CONFIGURATION_MESSAGE)}
    ELSE {S.text(dims.OTHER_AREAS_PREFIX)} || array_to_string(names, ', ') || '.' END AS user_message
FROM h
"""


@query("error_summary", _LOOK)
def error_summary(spark, folder):
    codes = F.array(*[F.lit(c) for c in CODES])
    places = [((F.col("event_id") + i * F.col("user_id")) % len(CODES)).cast("int") for i in range(3)]
    rows = table(spark, folder, "events").select("event_id", F.array(*[F.get(codes, p) for p in places]).alias("codes"))
    found = rows.select("event_id", E.error_summary(F.col("codes")).alias("s"))
    return found.select(
        "event_id",
        F.array_join("s.error_codes", ",").alias("codes"),
        "s.max_priority",
        "s.max_severity",
        "s.has_payment_issues",
        "s.has_rate_limit_issues",
        F.array_join("s.recommended_actions", ",").alias("recommended_actions"),
        F.array_join(F.map_keys("s.categories"), ",").alias("categories"),
        "s.user_message",
    )


#: An event as a remote call: its value sets the status, its kind the fault.
_CALLS = """
WITH c AS (SELECT event_id, user_id, CASE WHEN event_type <> 'signup' THEN 200 + floor(value * 2)::BIGINT END AS http,
  CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'connect' ELSE 'parse' END END AS kind,
  event_id % 5 > 0 AS ok, event_id % 7 > 0 AS job, (user_id % 9)::INT AS attempt FROM events)
"""


def _calls(spark, folder):
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(kind != "signup", F.lit(200) + F.floor(F.col("value") * 2)).alias("http"),
        F.when(kind == "error", "timeout")
        .when(kind == "click", F.when(key % 2 == 0, "connect").otherwise("parse"))
        .alias("kind"),
        (key % 5 > 0).alias("ok"),
        (key % 7 > 0).alias("job"),
        (F.col("user_id") % 9).cast("int").alias("attempt"),
    )


@query(
    "retryable",
    f"""{_CALLS} SELECT event_id, coalesce(http = 429 OR http BETWEEN 500 AND 599, false)
    OR coalesce(kind IN ('timeout', 'connect', 'network'), false) AS retry FROM c""",
)
def retryable(spark, folder):
    return _calls(spark, folder).select("event_id", V.is_retryable(F.col("http"), F.col("kind")).alias("retry"))


@query(
    "backoff",
    f"""{_CALLS} SELECT event_id, least(1.0::DOUBLE * pow(2, attempt), 60.0::DOUBLE) AS delay,
    least(pow(2, attempt), 60) * 0.75::DOUBLE AS low, least(pow(2, attempt), 60) * 1.25::DOUBLE AS high FROM c""",
)
def backoff(spark, folder):
    return _calls(spark, folder).select("event_id", V.backoff_bounds(F.col("attempt")).alias("b")).select("event_id", "b.*")


_KEYS = f"""{_CALLS}
SELECT event_id,
  CASE WHEN http IS NULL THEN 'no_key' WHEN http = 401 THEN 'invalid_key' WHEN http = 402 THEN 'no_credits'
    WHEN http = 403 THEN 'forbidden' WHEN http BETWEEN 200 AND 299 THEN 'valid' ELSE 'error' END AS status,
  coalesce(http = 402 OR http BETWEEN 200 AND 299, false) AS valid,
  CASE WHEN http IS NULL THEN 'No API key configured' WHEN http = 401 THEN 'API key is invalid or expired'
    WHEN http = 402 THEN 'API key is valid but account has insufficient credits'
    WHEN http = 403 THEN 'API key lacks required permissions'
    WHEN http BETWEEN 200 AND 299 THEN 'API key is valid and working'
    ELSE 'Unexpected response status: ' || http END AS message
FROM c
"""


@query("key_status", _KEYS)
def key_status(spark, folder):
    return _calls(spark, folder).select("event_id", V.key_status(F.col("http")).alias("k")).select("event_id", "k.*")


_OUTCOMES = f"""{_CALLS}
SELECT event_id,
  CASE WHEN kind = 'timeout' THEN 'timeout' WHEN kind IS NOT NULL OR http NOT BETWEEN 200 AND 299 OR NOT ok OR NOT job
    THEN 'error' ELSE 'success' END AS status,
  CASE WHEN kind = 'timeout' THEN 'request_timeout' WHEN kind = 'connect' THEN 'http_error'
    WHEN kind IS NOT NULL THEN 'fault in ' || kind WHEN http NOT BETWEEN 200 AND 299 THEN 'http_' || http
    WHEN NOT ok THEN 'api_failure' WHEN NOT job THEN 'no_job_id' END AS reason
FROM c
"""


@query("fetch_outcomes", _OUTCOMES)
def fetch_outcomes(spark, folder):
    fault = F.concat(F.lit("fault in "), "kind")
    found = V.fetch_outcome(F.col("http"), F.col("ok"), F.col("job"), F.col("kind"), fault)
    return _calls(spark, folder).select("event_id", found.alias("o")).select("event_id", "o.*")


_PLAIN = f"""{_CALLS}
SELECT event_id, CASE WHEN kind IS NOT NULL OR http NOT BETWEEN 200 AND 299 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN kind = 'timeout' THEN 'timeout' WHEN kind IS NOT NULL THEN 'scraping_error'
    WHEN http NOT BETWEEN 200 AND 299 THEN 'http_' || http END AS reason,
  CASE WHEN kind = 'timeout' THEN 'Page took too long to load' WHEN kind IS NOT NULL THEN 'Failed to scrape page: ' || kind
    WHEN http NOT BETWEEN 200 AND 299 THEN 'HTTP ' || http || ' error when fetching the page' END AS human_readable_error
FROM c
"""


@query("fallback_outcomes", _PLAIN)
def fallback_outcomes(spark, folder):
    found = V.fallback_outcome(F.col("http"), F.col("kind"))
    return _calls(spark, folder).select("event_id", found.alias("o")).select("event_id", "o.*")


#: A user's events of one day are the attempts of one request.
_ATTEMPTS = """
WITH a AS (SELECT user_id AS client, strftime(ts, '%Y-%m-%d') AS request, event_id AS attempt,
  CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'error' THEN 500 WHEN 'signup' THEN 404 END AS http_status,
  CASE event_type WHEN 'purchase' THEN 'timeout' END AS error FROM events),
g AS (SELECT client, request, count(*) AS attempts,
  arg_max(struct_pack(s := http_status, e := error), attempt) AS l FROM a GROUP BY 1, 2)
SELECT client, request, attempts, l.s AS final_status, l.e AS final_error, coalesce(l.s BETWEEN 200 AND 299, false) AS success,
  NOT coalesce(l.s BETWEEN 200 AND 299, false) AND (coalesce(l.s IN (429, 500), false) OR coalesce(l.e = 'timeout', false))
    AND attempts > 1 AS exhausted
FROM g
"""


@query("retry_outcome", _ATTEMPTS)
def retry_outcome(spark, folder):
    kind = F.col("event_type")
    status = F.when(kind == "view", 200).when(kind == "click", 429).when(kind == "error", 500).when(kind == "signup", 404)
    attempts = table(spark, folder, "events").select(
        F.col("user_id").alias("client"),
        F.date_format("ts", "yyyy-MM-dd").alias("request"),
        F.col("event_id").alias("attempt"),
        status.alias("http_status"),
        F.when(kind == "purchase", "timeout").alias("error"),
    )
    return R.retry_outcome(attempts, max_retries=1)


#: A user's events are the polls of one job, a day the longest wait.
_JOBS = """
WITH p AS (SELECT user_id AS job_id, epoch_us(ts) AS us, event_type <> 'click' AS heard,
  CASE event_type WHEN 'view' THEN 'scraping' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'paused' END AS status FROM events),
g AS (SELECT job_id, count(*) AS polls, min(us) AS first, max(us) AS latest,
  min(us) FILTER (status IN ('completed', 'failed')) AS ended,
  arg_min(status, us) FILTER (status IN ('completed', 'failed')) AS end_status,
  arg_max(status, us) FILTER (heard) AS last_status FROM p GROUP BY 1),
s AS (SELECT job_id, polls, CASE WHEN coalesce(ended - first < 86400000000, false) THEN end_status
  WHEN latest - first >= 86400000000 THEN 'timeout' WHEN last_status = 'scraping' THEN 'running' ELSE 'unknown' END AS state FROM g)
SELECT *, CASE state WHEN 'failed' THEN 'crawl_failed' WHEN 'timeout' THEN 'crawl_timeout' END AS reason FROM s
"""


@query("job_state", _JOBS)
def job_state(spark, folder):
    kind = F.col("event_type")
    polls = table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "click", 503).otherwise(200).alias("http_status"),
        F.when(kind == "view", "scraping").when(kind == "purchase", "completed").when(kind == "error", "failed")
        .when(kind == "signup", "paused").alias("status"),
    )
    return R.job_state(polls, max_wait=86400)


_SLOW = "SELECT event_id, value AS duration, printf('%.3f', round_even(value, 3)) AS duration_text FROM events WHERE value > 100"


@query("slow_requests", _SLOW)
def slow_requests(spark, folder):
    calls = table(spark, folder, "events").select("event_id", F.col("value").alias("duration"))
    return R.slow_requests(calls, threshold=100.0)


#: Events as step rows: a view is a success, the rest keep their kind as status.
_STEPS = f"""
WITH l AS (SELECT user_id AS request_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'unknown' ELSE event_type END AS status,
  CASE WHEN event_type <> 'signup' THEN floor(value * 100)::BIGINT ELSE 0 END AS ms, event_id % 3 AS calls FROM events),
n AS (SELECT request_id, status, count(*) AS n FROM l GROUP BY 1, 2),
h AS (SELECT request_id, string_agg(status || '=' || n, ',' ORDER BY status) AS status_counts FROM n GROUP BY 1),
t AS (SELECT request_id, sum(ms)::BIGINT AS total_duration_ms, count(*) AS total_steps, sum(calls)::BIGINT AS total_api_calls,
  count(*) FILTER (status = 'success') AS good FROM l GROUP BY 1)
SELECT request_id, total_duration_ms, total_steps, status_counts, total_api_calls,
  {S.rounded('total_duration_ms::DOUBLE / 1000', 2)} AS total_duration_seconds, {S.percent('good', 'total_steps')} AS success_rate
FROM t JOIN h USING (request_id)
"""


@query("step_stats", _STEPS)
def step_stats(spark, folder):
    kind = F.col("event_type")
    log = table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"),
        F.when(kind == "view", "success").when(kind != "click", kind).alias("status"),
        F.when(kind != "signup", F.floor(F.col("value") * 100)).alias("duration_ms"),
        (F.col("event_id") % 3).alias("api_calls"),
    )
    pairs = F.transform(F.map_entries("status_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return R.step_stats(log).withColumn("status_counts", F.array_join(pairs, ","))


_USAGE = f"""
WITH s AS (SELECT source AS request_id, count(*) AS d, count(*) FILTER (lang <> 'fr') AS f, count(*) FILTER (lang = 'en') AS g,
  coalesce(sum(length(coalesce(text, ''))) FILTER (lang = 'en'), 0)::BIGINT AS size FROM documents GROUP BY 1)
SELECT request_id, size AS content_bytes_scraped, d AS urls_discovered, f AS urls_filtered, g AS urls_scraped,
  {S.percent('g', 'f')} AS scrape_success_rate FROM s WHERE request_id IS NOT NULL
"""


@query("resource_usage", _USAGE)
def resource_usage(spark, folder):
    """A source is a request, its English documents the scraped pages."""
    docs = table(spark, folder, "documents").where("source is not null").withColumnRenamed("source", "request_id")
    stats = docs.groupBy("request_id").agg(
        F.count("*").alias("total_discovered"),
        F.count_if(F.col("lang") != "fr").alias("total_filtered"),
        F.count_if(F.col("lang") == "en").alias("total_scraped"),
    )
    pages = docs.where("lang = 'en'").withColumnRenamed("text", "content")
    return R.resource_usage(stats, R.content_sizes(pages))


def _pad(byte):
    """Hex of the key, padded to a block, each byte combined with ``byte``."""
    return bytes(b ^ byte for b in KEY.encode().ljust(64, b"\0")).hex()


_SIGNED = f"""
WITH s AS (SELECT event_id, props, sha256(from_hex('{_pad(0x5C)}') ||
  from_hex(sha256(from_hex('{_pad(0x36)}') || encode(coalesce(props, ''))))) AS mac FROM events)
SELECT event_id, mac FROM s WHERE event_id % 3 <> 0
"""


@query("signed_events", _SIGNED)
def signed_events(spark, folder):
    """Signed events of which every third carries a wrong signature and goes."""
    payload = F.coalesce("props", F.lit(""))
    mac = V.hmac_sha256(payload.cast("binary"), KEY)
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("s=0"), mac)).otherwise(F.concat(F.lit("s="), mac))
    events = table(spark, folder, "events").select(
        "event_id", payload.alias("payload"), given.alias("signature"), mac.alias("mac")
    )
    return L.authentic_events(events, KEY).select("event_id", "mac")


_WINDOWS = """
WITH w AS (SELECT user_id AS client, (epoch_us(ts) // 10000000 - unnest(range(6))) * 10000000 AS us FROM events)
SELECT client, epoch_ms(us // 1000) AS window_start, epoch_ms(us // 1000 + 60000) AS window_end, count(*) AS requests,
  count(*) >= 2 AS at_limit FROM w GROUP BY ALL
"""


@query("sliding_rates", _WINDOWS)
def sliding_rates(spark, folder):
    """The stream's sliding minutes over the table."""
    calls = table(spark, folder, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    found = request_rates(calls, limit=2)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
