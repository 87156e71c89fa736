"""Lead intake and event envelopes."""

from pyspark.sql import functions as F

from sitewise import dims, schemas


def parsed_leads(lines, value="value"):
    """Lead fields of request bodies; ``shape_errors`` says what has not the right form.

    A body is a JSON object, its fields are text or null. (The JSON reader would take a
    number for text and a broken line for a lead of nulls.) Other fields are passed over.
    """
    whole = F.try_parse_json(F.col(value).cast("string"))
    names = [part.split()[0] for part in schemas.LEAD_IN.split(", ")]
    kinds = {n: F.schema_of_variant(F.try_variant_get(whole, f"$.{n}", "variant")) for n in names}
    broken = whole.isNull() | ~F.schema_of_variant(whole).startswith("OBJECT")
    wrong = [F.when(~kinds[n].isin("STRING", "VOID"), F.lit(f"{n}: no text")) for n in names]
    shape = F.when(broken, F.array(F.lit("body: no object"))).otherwise(F.array_compact(F.array(*wrong)))
    fields = {n: F.when(kinds[n] == "STRING", F.try_variant_get(whole, f"$.{n}", "string")) for n in names}
    return lines.withColumns({**fields, "shape_errors": shape})


def read_leads(spark, path):
    """Lead rows of request bodies, one per line; blank lines are none."""
    lines = spark.read.text(path)
    return parsed_leads(lines.where(F.trim("value") != ""))


def decode_envelopes(events, payload="payload"):
    """Add ``event`` (the decoded envelope) and ``verdict`` to payload rows.

    'rejected' for text that is not a JSON object, 'process' for registration
    events, 'acknowledge' for every other name.
    """
    text = F.col(payload).cast("string")
    event = F.from_json(text, schemas.ENVELOPE)
    whole = F.try_parse_json(text)
    broken = whole.isNull() | ~F.schema_of_variant(whole).startswith("OBJECT")
    name = F.col("event")["name"]
    return events.withColumn("event", event).withColumn(
        "verdict",
        F.when(broken, "rejected")
        .when(name == dims.REGISTRATION_EVENT, "process")
        .otherwise("acknowledge"),
    )
