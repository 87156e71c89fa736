"""One nested report per lead from the analysis tables."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise import dims, schemas
from sitewise.functions.errors import error_summary
from sitewise.functions.events import iso_utc, percent, report_name, rounded, seconds_of
from sitewise.operators.leads import linkedin_stub

LOG_FIELDS = [f.split(":")[0].strip() for f in schemas.LOG_ENTRY.split(", ")]


_STEP_KINDS = {"step": "string", "status": "string", "timestamp": "string"}
#: Places of the steps of a log.
_STEPS = ("linkedin_analysis", "url_discovery", "url_filtering", "content_scraping", "website_analysis")


def _stacked(tables):
    """One union of tables that each fill ``request_id`` and a struct of their own."""
    parts = [df.select("request_id", row.alias(name)) for name, (df, row) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def step_log(leads, analysis, now, times=None):
    """(request_id, ord, step, status, counts ...): the processing log of each lead.

    Made of the phase tables: one union, one aggregate. Rows of a hot lead are counted
    before they are brought together. times: (request_id, step, duration_ms), where
    durations were measured.
    """
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    one = F.lit(1).cast("long")
    tables = {
        "lead": (leads, F.struct(F.coalesce(F.col("linkedin") != "", F.lit(False)).alias("linkedin"))),
        "head": (analysis["headers"], F.struct("route", "status")),
        "found": (analysis["urls"], F.struct(one.alias("n"))),
        "kept": (analysis["ranked"].where("kept"), F.struct(one.alias("n"))),
        "page": (analysis["pages"], F.struct((F.col("source") == 0).alias("crawled"), ok.alias("ok"))),
    }
    if times is not None:
        tables["time"] = (times, F.struct("step", "duration_ms"))
    stacked = _stacked(tables)
    if times is None:
        stacked = stacked.withColumn("time", F.lit(None).cast("struct<step:string,duration_ms:bigint>"))
    took = {s: F.sum(F.when(F.col("time.step") == s, F.col("time.duration_ms"))).alias(f"_{s}") for s in _STEPS}
    counted = stacked.groupBy("request_id").agg(
        F.max("lead.linkedin").alias("linkedin"),
        F.max("head").alias("head"),
        F.count("found").alias("found"),
        F.count("kept").alias("kept"),
        F.count_if("page.crawled").alias("crawled"),
        F.count("page").alias("pages"),
        F.count_if("page.ok").alias("good"),
        *took.values(),
    )

    def entry(step, status, **counts):
        given = {"step": F.lit(step), "status": status, "timestamp": iso_utc(now), "duration_ms": F.col(f"_{step}"), **counts}
        columns = [given.get(n, F.lit(None)).cast(_STEP_KINDS.get(n, "bigint")).alias(n) for n in LOG_FIELDS]
        return F.struct(F.lit(_STEPS.index(step)).alias("ord"), *columns)

    analysed = F.col("head").isNotNull() & (F.col("head.route") != "invalid")
    entries = F.array(
        F.when(F.col("linkedin"), entry("linkedin_analysis", F.lit("not_implemented"))),
        F.when(analysed, entry("url_discovery", F.col("head.status"), urls_found=F.when(F.col("head.status") == "success", F.col("found")).otherwise(0))),
        F.when(analysed, entry("url_filtering", F.lit("success"), input_urls=F.col("found"), output_urls=F.col("kept"))),
        F.when(
            analysed,
            entry(
                "content_scraping",
                F.when(F.col("good") > 0, "success").otherwise("partial"),
                urls_from_crawl=F.col("crawled"),
                urls_scraped_separately=F.col("pages") - F.col("crawled"),
                successful_scrapes=F.col("good"),
                failed_scrapes=F.col("pages") - F.col("good"),
            ),
        ),
        F.when(F.col("head").isNotNull(), entry("website_analysis", F.when(analysed, "success").otherwise("error"))),
    )
    return counted.select("request_id", F.inline(F.array_compact(entries)))


def _counts_of(values):
    """map<value, times> of a short array, by value."""
    different = F.array_sort(F.array_distinct(values))
    return F.map_from_entries(
        F.transform(different, lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).cast("bigint")))
    )


def gathered(leads, analysis, log):
    """One row per lead with what every phase table says of it.

    One union of the tables, each under a tag of its own, and one aggregate: the
    lists of a report are bounded by the limits of the phases.
    """
    optional = {"duration_ms": "bigint", "error_message": "string", "error_type": "string", "error_timestamp": "string"}
    for name, kind in optional.items():
        if name not in leads.columns:
            leads = leads.withColumn(name, F.lit(None).cast(kind))
    for name in LOG_FIELDS:
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(_STEP_KINDS.get(name, "bigint")))
    data = ("timestamp", "first_name", "last_name", "company_website", "linkedin", *optional)
    failed = F.coalesce(F.col("status") != "success", F.lit(True))
    page = F.struct(
        "ord",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.when(failed, F.coalesce("status", F.lit("unknown"))).alias("status"),
        F.when(failed, F.coalesce("reason", F.lit("unknown"))).alias("reason"),
        F.when(failed, F.col("human_readable_error")).alias("human_readable_error"),
    )
    tables = {
        "lead": (leads, F.struct(*data)),
        "head": (analysis["headers"], F.struct("route", "status", "reason")),
        "found": (analysis["urls"], F.struct("pos", "url")),
        "kept": (analysis["ranked"].where("kept"), F.struct("rank", "url", "reason")),
        "page": (analysis["pages"], page),
        "step": (log, F.struct("ord", *LOG_FIELDS)),
    }
    lists = [F.array_sort(F.collect_list(n)).alias(n) for n in ("found", "kept", "page", "step")]
    rows = _stacked(tables).groupBy("request_id").agg(F.min("lead").alias("lead"), F.min("head").alias("head"), *lists)
    return rows.where("lead is not null")


def build_reports(leads, analysis, log, now, version=dims.REPORT_VERSION):
    """REPORT rows, one per lead, none dropped.

    leads: event data, optionally with duration_ms, and with error_message,
    error_type, error_timestamp for runs that failed midway: what they had reached
    stays in the report. analysis: dict with headers, urls, ranked and pages. log:
    (request_id, ord, step, duration_ms, status, ..), as ``step_log`` gives it.
    """
    rows = gathered(leads, analysis, log)
    analysed = F.col("head").isNotNull() & (F.col("head.route") != "invalid")
    lost = analysed & (F.col("head.status") != "success")
    bad = F.filter("page", lambda p: p["status"].isNotNull())
    statuses = F.transform("step", lambda s: F.coalesce(s["status"], F.lit("unknown")))
    total = lambda name: F.aggregate(
        "step", F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(s[name], F.lit(0))
    )
    rows = rows.withColumns(
        {
            "analysed": analysed,
            "lost": lost,
            "codes": F.array_compact(
                F.concat(
                    F.array(F.when(lost, F.coalesce("head.reason", F.lit("unknown")))),
                    F.transform(bad, lambda p: p["reason"]),
                )
            ),
            "n_found": F.size("found").cast("long"),
            "n_kept": F.size("kept").cast("long"),
            "n_failed": F.size(bad).cast("long"),
            "n_scraped": (F.size("page") - F.size(bad)).cast("long"),
            "chars": F.aggregate("page", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["content"])),
            "took": total("duration_ms"),
            "statuses": statuses,
            "calls": total("api_calls"),
        }
    )
    steps = F.transform("step", lambda e: F.struct(*[e[name].alias(name) for name in LOG_FIELDS]))
    good = F.size(F.filter("statuses", lambda s: s == "success"))
    statistics = F.struct(
        F.col("took").alias("total_duration_ms"),
        rounded(F.col("took") / 1000.0, 2).alias("total_duration_seconds"),
        F.size("step").cast("bigint").alias("total_steps"),
        _counts_of(F.col("statuses")).alias("status_counts"),
        F.col("calls").alias("total_api_calls"),
        percent(good, F.size("step")).alias("success_rate"),
    )
    pairs = F.array_distinct(F.transform("kept", lambda k: F.struct(k["url"], k["reason"])))
    website = F.struct(
        F.col("found.url").alias("discovered_urls"),
        F.col("kept.url").alias("filtered_urls"),
        F.transform(
            "page", lambda p: F.struct(*[p[n].alias(n) for n in ("url", "content", "status", "reason", "human_readable_error")])
        ).alias("scraped_content"),
        F.when(F.col("analysed"), F.map_from_entries(pairs)).alias("filter_reasons"),
        F.when(F.col("lost"), F.col("head.status")).alias("discovery_status"),
        F.when(F.col("lost"), F.coalesce("head.reason", F.lit("unknown"))).alias("discovery_reason"),
        F.when(
            F.col("analysed"),
            F.struct(
                F.col("n_found").alias("total_discovered"),
                F.col("n_kept").alias("total_filtered"),
                F.col("n_scraped").alias("total_scraped"),
                F.col("n_failed").alias("scrape_failures"),
            ),
        ).alias("statistics"),
        F.when(F.col("head.route") == "invalid", "Invalid URL").alias("error"),
    )
    names = [F.col("lead.first_name"), F.col("lead.last_name")]
    both = (F.coalesce(names[0], F.lit("")) != "") & (F.coalesce(names[1], F.lit("")) != "")
    metadata = F.struct(
        report_name(F.col("request_id"), *names, now).alias("filename"),
        F.when(both, F.concat_ws(" ", *names)).alias("person_name"),
        iso_utc(now).alias("saved_at"),
        F.lit(version).alias("version"),
        F.struct(
            F.col("lead.timestamp").alias("started_at"),
            iso_utc(now).alias("completed_at"),
            F.col("lead.duration_ms").alias("duration_ms"),
            seconds_of(F.col("lead.duration_ms")).alias("duration_seconds"),
            steps.alias("steps"),
            F.when(F.size("step") > 0, statistics).alias("statistics"),
        ).alias("processing"),
        F.struct(
            F.col("chars").alias("content_bytes_scraped"),
            F.when(F.col("analysed"), F.col("n_found")).otherwise(0).alias("urls_discovered"),
            F.when(F.col("analysed"), F.col("n_kept")).otherwise(0).alias("urls_filtered"),
            F.col("n_scraped").alias("urls_scraped"),
            percent(F.col("n_scraped"), F.col("n_kept")).alias("scrape_success_rate"),
        ).alias("resources"),
        F.when(F.size("codes") > 0, error_summary(F.col("codes"))).alias("error_summary"),
    )
    report = rows.select(
        "request_id",
        F.col("lead.timestamp").alias("timestamp"),
        F.struct(*[f"lead.{n}" for n in ("first_name", "last_name", "company_website", "linkedin")]).alias("input_data"),
        linkedin_stub(F.col("lead.linkedin")).alias("linkedin_analysis"),
        website.alias("website_analysis"),
        steps.alias("_processing_log"),
        metadata.alias("_metadata"),
        F.when(
            F.col("lead.error_message").isNotNull(),
            F.struct(
                F.col("lead.error_message").alias("message"),
                F.col("lead.error_type").alias("type"),
                F.col("lead.error_timestamp").alias("timestamp"),
            ),
        ).alias("error"),
    )
    fields = T.StructType.fromDDL(schemas.REPORT).fields
    return report.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def expired(reports, now, retention_days, modified="modified"):
    """Reports strictly older than ``retention_days`` before ``now``.

    A table of what may go; deleting is left to the owner of the storage.
    """
    cutoff = now - F.make_interval(days=F.lit(retention_days))
    return reports.where(F.col(modified) < cutoff)


def report_json(reports):
    """(request_id, json) with nulls kept."""
    return reports.select(
        "request_id",
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"),
    )


def parsed_report(rows, json="json"):
    """Report struct from JSON text; broken or missing text gives a null report."""
    parsed = F.from_json(F.col(json), schemas.REPORT)
    return rows.withColumn("report", F.when(parsed["request_id"].isNotNull(), parsed))
