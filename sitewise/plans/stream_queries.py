"""Stream plans: the events log read as a stream, drained into a table."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import events as V
from sitewise.plans import check_sql as S
from sitewise.plans.registry import query, table
from sitewise.streaming import intake as I
from sitewise.streaming.rates import request_rates
from sitewise.streaming.runner import drain, table_stream, work_paths

KEY = "signing key of the check"
NOW = "2024-03-01 10:20:30"

#: Events as signed payloads: an error is badly signed, a click broken, a view foreign.
#: A signup registers; each third lacks both ids, a value over 100 has no last name.
_EVENTS = """
WITH s AS (SELECT event_id, event_type, CASE WHEN event_id % 3 > 0 THEN 'e' || event_id END AS id,
  'A' || user_id AS first_name, CASE WHEN value > 100 THEN '' ELSE 'B' END AS last_name, 'x' || user_id || '.com' AS site FROM events)
"""


def _signed(events, *kept):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    lead = F.struct(
        F.concat(F.lit("A"), user).alias("first_name"),
        F.when(F.col("value") > 100, "").otherwise("B").alias("last_name"),
        F.concat(F.lit("x"), user, F.lit(".com")).alias("company_website"),
    )
    name = F.when(kind == "view", "page.viewed").otherwise(dims.REGISTRATION_EVENT)
    key = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    whole = F.to_json(F.struct(name.alias("name"), lead.alias("data"), key.alias("id")))
    payload = F.when(kind == "click", F.concat(F.lit("{"), whole)).otherwise(whole)
    mac = F.concat(F.lit("s="), V.hmac_sha256(payload.cast("binary"), KEY))
    return events.select(
        "event_id", payload.alias("payload"), F.when(kind == "error", "s=00").otherwise(mac).alias("signature"), *kept
    )


def _stream(spark, folder):
    return table_stream(spark, folder, "events", table(spark, folder, "events").schema)


def _drained(spark, rows, name):
    path, checkpoint = work_paths(spark, name)
    return spark.read.schema(rows.schema).parquet(drain(rows, path, checkpoint))


_LEADS = f"""{_EVENTS}
SELECT id AS request_id, first_name, last_name, {S.safe_url('site')} AS company_website, NULL::VARCHAR AS linkedin,
  '2024-03-01T10:20:30+00:00' AS timestamp,
  'Registration accepted for ' || first_name || ' ' || last_name || '. Processing in background.' AS message,
  'website: ' || {S.safe_url('site')} AS sources
FROM s WHERE event_type IN ('signup', 'purchase') AND id IS NOT NULL AND last_name <> ''
"""


@query("stream_intake", _LEADS)
def stream_intake(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    return _drained(spark, I.intake(_signed(_stream(spark, folder)), KEY, now), "leads")


_REFUSED = f"""{_EVENTS}, r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'signature' WHEN event_type = 'click' THEN 'payload'
  WHEN event_type = 'view' THEN 'event' WHEN id IS NULL THEN 'id' WHEN last_name = '' THEN 'lead: last_name: too short' END AS refused FROM s)
SELECT refused, count(*) AS n FROM r WHERE refused IS NOT NULL GROUP BY 1
"""


@query("stream_refused", _REFUSED)
def stream_refused(spark, folder):
    """Refused events by reason, from their table."""
    rows = I.refused_events(_signed(_stream(spark, folder)), KEY)
    return _drained(spark, rows, "refused").groupBy("refused").agg(F.count("*").alias("n"))


_RATES = """
WITH w AS (SELECT user_id AS client, (epoch_us(ts) // 10000000 - unnest(range(6))) * 10000000 AS us FROM events),
g AS (SELECT client, us, count(*) AS requests FROM w GROUP BY ALL)
SELECT client, epoch_ms(us // 1000) AS window_start, epoch_ms(us // 1000 + 60000) AS window_end, requests, requests >= 2 AS at_limit
FROM g WHERE us + 60000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000
"""


@query("stream_rate", _RATES)
def stream_rate(spark, folder):
    """Sliding minutes that the watermark has closed."""
    calls = _stream(spark, folder).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    found = _drained(spark, request_rates(calls, limit=2), "rates")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
