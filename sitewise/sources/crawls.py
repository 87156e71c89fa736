"""Crawl and scrape payloads."""

from pyspark.sql import functions as F

from sitewise import dims, schemas


def parse_crawl_jobs(payloads, limit=dims.URLS_PER_SITE, body="body"):
    """One row per delivered page of a completed crawl job.

    Items without a URL are passed over; ``total_found`` counts before the
    limit. All of it stays inside the payload row: no shuffle.
    """
    job = F.from_json(F.col(body), schemas.CRAWL_JOB)

    def url(item):
        return F.coalesce(
            F.nullif(item["metadata"]["sourceURL"], F.lit("")),
            F.nullif(item["url"], F.lit("")),
        )

    named = F.filter(job["data"], lambda item: url(item).isNotNull())
    text = F.coalesce(
        F.nullif(F.col("item.markdown"), F.lit("")),
        F.nullif(F.col("item.html"), F.lit("")),
        F.lit(""),
    )
    return (
        payloads.withColumn("_items", named)
        .withColumn("total_found", F.size("_items"))
        .select(
            *[c for c in payloads.columns if c != body],
            "total_found",
            F.posexplode(F.slice("_items", 1, limit)).alias("pos", "item"),
        )
        .withColumn("url", url(F.col("item")))
        .withColumn("content", text)
        .withColumn(
            "status", F.when(F.col("content") != "", "success").otherwise("no_content")
        )
        .drop("item")
    )


def scraped_content(payloads, body="body", output_format="output_format"):
    """Add ``content``: the field of the wanted format, else the first non-empty."""
    data = F.from_json(F.col(body), schemas.SCRAPE_BODY)["data"]
    wanted = F.col(output_format)
    first = F.coalesce(*[F.nullif(data[f], F.lit("")) for f in ("markdown", "html", "text")])
    content = (
        F.when(wanted == "markdown", data["markdown"])
        .when(wanted == "html", data["html"])
        .when(wanted == "text", data["text"])
        .otherwise(first)
    )
    return payloads.withColumn("content", F.coalesce(content, F.lit("")))
