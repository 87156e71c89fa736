"""Lead validation, acceptance and the not-yet-implemented profile stub."""

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions import text as T
from sitewise.functions import urls as U
from sitewise.functions.events import is_authentic, iso_utc

NAME_LIMIT = 100
URL_LIMIT = 500


def _name_error(field):
    raw = F.col(field)
    return (
        F.when(raw.isNull(), f"{field}: missing")
        .when(F.length(raw) < 1, f"{field}: too short")
        .when(F.length(raw) > NAME_LIMIT, f"{field}: too long")
        .when(T.strip(raw) == "", f"{field}: blank")
    )


def _url_error(field):
    return F.when(F.length(field) > URL_LIMIT, f"{field}: too long")


def validated(leads):
    """Leads with trimmed fields and an ``errors`` array; empty means accepted.

    Lengths are checked before trimming; the need for one source is checked only
    when every field is fine.
    """
    fields = F.array_compact(
        F.array(
            _name_error("first_name"),
            _name_error("last_name"),
            _url_error("company_website"),
            _url_error("linkedin"),
        )
    )
    trimmed = {c: T.strip(F.col(c)) for c in ("first_name", "last_name")}
    trimmed |= {c: T.non_blank(F.col(c)) for c in ("company_website", "linkedin")}
    no_source = (
        (F.size("errors") == 0)
        & F.col("company_website").isNull()
        & F.col("linkedin").isNull()
    )
    return (
        leads.withColumn("errors", fields)
        .withColumns(trimmed)
        .withColumn(
            "errors",
            F.when(no_source, F.array(F.lit("source: none given"))).otherwise(
                F.col("errors")
            ),
        )
    )


def requested(leads):
    """``validated`` for the rows of ``read_leads``: fields of the wrong form come first,
    and such a body is rejected for them alone."""
    checked = validated(leads)
    errors = F.when(F.size("shape_errors") > 0, F.col("shape_errors")).otherwise(F.col("errors"))
    return checked.withColumn("errors", errors).drop("shape_errors")


def accepted(leads, now):
    """Accepted leads as event data: id, time, canonical URLs, message, sources.

    ``request_id`` is given at intake: it must not change when a task is run
    again, and two leads of one person stay two requests.
    """
    if "request_id" not in leads.columns:
        raise ValueError("leads need a request_id; give one at intake")
    good = validated(leads).where(F.size("errors") == 0).drop("errors")
    site, profile = F.col("company_website"), F.col("linkedin")
    return (
        good.withColumn("timestamp", iso_utc(now))
        .withColumns(
            {"company_website": U.safe_url(site), "linkedin": U.safe_url(profile)}
        )
        .withColumn(
            "message",
            F.concat(
                F.lit("Registration accepted for "),
                F.col("first_name"),
                F.lit(" "),
                F.col("last_name"),
                F.lit(". Processing in background."),
            ),
        )
        .withColumn(
            "sources",
            F.concat_ws(
                ", ",
                F.concat(F.lit("website: "), site),
                F.concat(F.lit("linkedin: "), profile),
            ),
        )
    )


def rejected(leads):
    return validated(leads).where(F.size("errors") > 0)


def linkedin_stub(linkedin):
    """Status column for a profile URL; the analysis itself was never built."""
    given = F.coalesce(linkedin, F.lit("")) != ""
    return F.struct(
        F.lit("not_implemented").alias("status"),
        F.when(given, linkedin).alias("url"),
        F.when(given, F.lit(dims.LINKEDIN_PLAN)).alias("implementation_plan"),
    )


def authentic_events(events, key):
    """Events whose signature fits the payload."""
    return events.where(
        is_authentic(F.col("payload").cast("binary"), F.col("signature"), key)
    )
