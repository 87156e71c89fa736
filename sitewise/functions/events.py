"""Request, event and clock columns: retry classes, signatures, durations."""

import hashlib

from pyspark.sql import functions as F

from sitewise import dims


def is_retryable(status_code, error_kind):
    """429, 5xx, time-outs and connection faults are worth another attempt."""
    by_status = F.coalesce(
        (status_code == 429) | status_code.between(500, 599), F.lit(False)
    )
    by_kind = F.coalesce(
        error_kind.isin("timeout", "connect", "network"), F.lit(False)
    )
    return by_status | by_kind


def backoff_bounds(attempt, base=dims.BASE_DELAY_SECONDS, limit=dims.MAX_DELAY_SECONDS):
    """(delay, low, high) in seconds: doubling, capped, a quarter of jitter each way."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(limit)))
    return F.struct(
        delay.alias("delay"),
        F.greatest(F.lit(0.0), delay * 0.75).alias("low"),
        F.greatest(F.lit(0.0), delay * 1.25).alias("high"),
    )


def key_status(status_code):
    """What a probe's HTTP status says about an API key; null status = no key."""

    def verdict(status, valid, message):
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(valid).alias("valid"),
            (message if not isinstance(message, str) else F.lit(message)).alias("message"),
        )

    return (
        F.when(
            status_code.isNull(), verdict("no_key", False, "No API key configured")
        )
        .when(
            status_code == 401,
            verdict("invalid_key", False, "API key is invalid or expired"),
        )
        .when(
            status_code == 402,
            verdict(
                "no_credits",
                True,
                "API key is valid but account has insufficient credits",
            ),
        )
        .when(
            status_code == 403,
            verdict("forbidden", False, "API key lacks required permissions"),
        )
        .when(
            status_code.between(200, 299),
            verdict("valid", True, "API key is valid and working"),
        )
        .otherwise(
            verdict(
                "error",
                False,
                F.concat(
                    F.lit("Unexpected response status: "), status_code.cast("string")
                ),
            )
        )
    )


def fetch_outcome(http_status, success, has_job_id, error_kind, error_message):
    """(status, reason) of one remote call, as the crawl and scrape steps report it."""

    def outcome(status, reason):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    return (
        F.when(error_kind == "circuit_open", outcome("circuit_open", "circuit_breaker_open"))
        .when(error_kind == "timeout", outcome("timeout", "request_timeout"))
        .when(error_kind.isin("connect", "network", "http"), outcome("error", "http_error"))
        .when(error_kind.isNotNull(), outcome("error", error_message))
        .when(
            ~http_status.between(200, 299),
            outcome("error", F.concat(F.lit("http_"), http_status.cast("string"))),
        )
        .when(~F.coalesce(success, F.lit(False)), outcome("error", "api_failure"))
        .when(~F.coalesce(has_job_id, F.lit(True)), outcome("error", "no_job_id"))
        .otherwise(outcome("success", F.lit(None).cast("string")))
    )


def fallback_outcome(http_status, error_kind):
    """(status, reason, human_readable_error) of a plain page fetch."""
    return F.struct(
        F.when(error_kind.isNotNull() | ~http_status.between(200, 299), "error")
        .otherwise("success")
        .alias("status"),
        F.when(error_kind == "timeout", F.lit("timeout"))
        .when(error_kind.isNotNull(), F.lit("scraping_error"))
        .when(
            ~http_status.between(200, 299),
            F.concat(F.lit("http_"), http_status.cast("string")),
        )
        .alias("reason"),
        F.when(error_kind == "timeout", F.lit("Page took too long to load"))
        .when(
            error_kind.isNotNull(),
            F.concat(F.lit("Failed to scrape page: "), error_kind),
        )
        .when(
            ~http_status.between(200, 299),
            F.concat(
                F.lit("HTTP "),
                http_status.cast("string"),
                F.lit(" error when fetching the page"),
            ),
        )
        .alias("human_readable_error"),
    )


def hmac_sha256(payload, key):
    """Hex HMAC-SHA256 of a binary column under a plan-time key."""
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in secret))
    outer = F.lit(bytearray(b ^ 0x5C for b in secret))
    inside = F.unhex(F.sha2(F.concat(inner, payload), 256))
    return F.sha2(F.concat(outer, inside), 256)


def is_authentic(payload, signature, key):
    """Signature 's=<hex>' fits the payload; without a key everything passes."""
    if not key:
        return F.lit(True)
    expected = F.concat(F.lit("s="), hmac_sha256(payload, key))
    return F.coalesce(signature == expected, F.lit(False))


def iso_utc(ts):
    """ISO-8601 UTC text; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def rounded(value, digits):
    """A double of at least zero, to one or two decimals, by its exact binary value.

    ``bround`` looks at the shortest decimal text, where 298.165 is a tie; the double
    lies above it. The fraction is taken as a whole number of 2^-56 (2^-60 below 1/16),
    which loses no bit, and ties go to the even digit.
    """
    power = 10**digits
    whole = F.floor(value)

    def steps(bits):
        scaled = ((value - whole) * float(2**bits)).cast("long") * power
        down = F.shiftright(scaled, bits)
        rest, half = scaled.bitwiseAND(F.lit(2**bits - 1)), F.lit(2 ** (bits - 1))
        up = (rest > half) | ((rest == half) & (down % 2 == 1))
        return down + up.cast("long")

    fraction = F.when(value < 0.0625, steps(60)).otherwise(steps(56))
    return (whole * power + fraction) / float(power)


def seconds_of(duration_ms):
    """Milliseconds as seconds with two decimals; zero has no seconds value."""
    return F.when(duration_ms != 0, rounded(duration_ms / 1000.0, 2))


def percent(part, whole):
    """Share in percent with one decimal, 0.0 for an empty whole."""
    return F.when(whole > 0, rounded(part / whole * 100, 1)).otherwise(F.lit(0.0))


def report_name(request_id, first_name, last_name, now, include_name=True):
    """analysis_<yyyyMMdd_HHmmss>_[First10LastInitial_]<id8>.json"""
    from sitewise.functions.text import capitalised_letters

    first = capitalised_letters(first_name, 10)
    person = F.when(
        F.lit(include_name) & (first != ""),
        F.concat(first, capitalised_letters(last_name, 1), F.lit("_")),
    ).otherwise("")
    short_id = F.left(F.regexp_replace(request_id, r"[^a-zA-Z0-9\-_]", ""), F.lit(8))
    return F.concat(
        F.lit("analysis_"),
        F.date_format(now, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        person,
        short_id,
        F.lit(".json"),
    )
