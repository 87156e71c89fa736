"""Event-driven lead intake and report writing."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from sitewise.functions.events import is_authentic
from sitewise.operators.leads import accepted, validated
from sitewise.session import in_place, shared_dir, stored
from sitewise.sources.leads import decode_envelopes

LEAD_FIELDS = ("first_name", "last_name", "company_website", "linkedin")

#: Leads of a batch in a shuffle partition; each has up to 50 URLs and some 20 other rows.
LEADS_PER_PARTITION = 10_000

#: Leads of a batch that are analysed at a time; phase tables and shuffles hold some 1.2 KB of each.
LEADS_PER_SLICE = 1_000_000


def sorted_events(events, key):
    """Signed event payloads with ``refused``: why one is no lead, null for leads.

    events: payload (text or binary), signature. The reasons are 'signature',
    'payload' (no JSON object), 'event' (a foreign name), 'id' (an event without
    one, nor its lead) and 'lead: ' with the faults of its fields. Works on streams and tables,
    and drops nothing: write the refused rows to a table of their own.
    """
    body = F.col("payload").cast("binary")
    known = events.withColumn("_signed", is_authentic(body, F.col("signature"), key))
    decoded = decode_envelopes(known)
    event = F.col("event")
    lead = decoded.select(
        *decoded.columns,
        F.coalesce(F.nullif(event["data"]["request_id"], F.lit("")), event["id"]).alias("request_id"),
        *[event["data"][c].alias(c) for c in LEAD_FIELDS],
    )
    return (
        validated(lead)
        .withColumn(
            "refused",
            F.when(~F.col("_signed"), "signature")
            .when(F.col("verdict") == "rejected", "payload")
            .when(F.col("verdict") == "acknowledge", "event")
            .when(F.coalesce("request_id", F.lit("")) == "", "id")
            .when(F.size("errors") > 0, F.concat(F.lit("lead: "), F.array_join("errors", ", "))),
        )
        .drop("_signed", "event", "verdict", "errors")
    )


def intake(events, key, now):
    """The leads among signed events as event data; without its own id a lead has the event's.

    What doesn't pass is in ``refused_events``.
    """
    good = sorted_events(events, key).where("refused is null")
    return accepted(good.select("request_id", *LEAD_FIELDS), now)


def intake_once(events, key, now, lateness="1 day"):
    """``intake`` in which an event that is delivered again gives no second lead.

    events: payload, signature and ``ts``, the time of the event. A stream keeps the
    ids it has seen until the watermark has passed them by ``lateness``.
    """
    good = sorted_events(events, key).where("refused is null")
    if good.isStreaming:
        once = good.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["request_id"])
    else:
        once = good.dropDuplicates(["request_id"])
    return accepted(once.select("request_id", *LEAD_FIELDS), now)


def refused_events(events, key):
    """(payload, signature, refused): every event that gives no lead, with its reason."""
    return sorted_events(events, key).where("refused is not null").select("payload", "signature", "refused")


@contextmanager
def _sized(spark, leads):
    """Shuffle partitions by the number of leads, at least as many as set.

    A stream's session keeps the number its state began with and has no adaptive plans,
    so that the tasks of a large batch would grow with it. Shuffle files go when the
    write that made them has ended: nothing reads them again, and until the driver
    collects its garbage those of all phases would lie on the disk. Both settings are
    put back, as the state of the next batch goes by the number.
    """
    partitions = "spark.sql.shuffle.partitions"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = {partitions: spark.conf.get(partitions), cleanup: spark.conf.get(cleanup, "false")}
    spark.conf.set(partitions, str(max(int(usual[partitions]), -(-leads // LEADS_PER_PARTITION))))
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def saved_batch(build, path):
    """The work on a micro-batch of leads: reports in a folder of its own.

    ``build`` maps leads to reports, each lead by itself. The leads are written first,
    so that the stream's state is read once, and analysed in slices of about
    ``LEADS_PER_SLICE`` by a hash of their id: the tables of a slice take the place of
    those before, so that only the reports, packed by gzip, grow with the batch. A
    partition holds about ``LEADS_PER_PARTITION`` leads.

    A batch overwrites its folder: one that runs again after a lost executor leaves one
    copy. Until it has ended its folder holds the slices that are done.
    """
    name = f"batches-{uuid.uuid4().hex}"

    def save(batch, batch_id):
        work = f"{shared_dir(batch.sparkSession).rstrip('/')}/{name}"
        with in_place(work):
            leads = stored(batch, "leads")
        spark, n = leads.sparkSession, leads.count()
        slices = max(1, -(-n // LEADS_PER_SLICE))
        place = F.pmod(F.xxhash64("request_id"), F.lit(slices))
        for k in range(slices):
            with _sized(spark, -(-n // slices)), in_place(f"{work}/slice"):
                part = leads if slices == 1 else leads.where(place == k)
                (
                    build(part).write.mode("append" if k else "overwrite")
                    .option("ignoreNullFields", False)
                    .option("compression", "gzip")
                    .json(f"{path}/batch={batch_id}")
                )

    return save


def write_report_stream(leads, build, path, checkpoint):
    """Analyse and save each micro-batch of leads; ``build`` maps leads to reports."""
    return (
        leads.writeStream.foreachBatch(saved_batch(build, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
