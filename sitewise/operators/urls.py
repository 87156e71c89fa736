"""Set-form URL operators: de-duplication and site membership."""

from pyspark.sql import functions as F

from sitewise.functions import urls as U
from sitewise.operators.keyed import keep_first


def dedup_first_seen(urls, group, order="pos"):
    """One URL per page, the earliest kept; trailing slash and fragment ignored."""
    keyed = urls.withColumn("_key", U.first_seen_key(F.col("url")))
    return keep_first(keyed, group, "_key", order).drop("_key")


def dedup_similar(urls, group, order="pos"):
    """Near-duplicates out: case, slash, scheme, query and fragment ignored."""
    keyed = urls.withColumn("_key", U.similar_key(F.col("url")))
    return keep_first(keyed, group, "_key", order).drop("_key")


def pages_per_lead(leads, pages):
    """Page count and first page of each lead's own site, an equi-join on the domain.

    Pages are reduced to one row per domain before they meet the leads. Leads without
    a site are spread by a key of their own, which no site has.
    """
    sites = (
        pages.withColumn("site_key", U.site_key(F.col("url")))
        .where("site_key is not null")
        .groupBy("site_key")
        .agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
    )
    keyed = leads.withColumn("site_key", U.site_key(F.col("company_website")))
    none = F.concat(F.lit(" "), F.xxhash64(*leads.columns).cast("string"))
    keyed = keyed.withColumn("_site", F.coalesce("site_key", none))
    sites = sites.withColumnRenamed("site_key", "_site")
    return keyed.join(sites, "_site", "left").drop("_site").withColumn(
        "pages", F.coalesce("pages", F.lit(0))
    )
