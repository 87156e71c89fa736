"""URL filters: dated list entries as validity intervals, joined as of the fetch."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from sitewise.llm.common import written

LEVELS = ("prefix", "host", "domain")


def url_keys(url):
    """Patterns that can list a URL, most specific first: host with the first
    path segment, host, last two host labels. Null where the URL has no host."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:@]*)", 1))
    segment = F.regexp_extract(rest, r"^[^/]*/([^/]+)", 1)
    some = F.nullif(host, F.lit(""))
    return {
        "prefix": F.when(segment != "", F.concat(some, F.lit("/"), segment)),
        "host": some,
        "domain": F.regexp_extract(some, r"([^.]+\.[^.]+)$", 1),
    }


def validity(entries):
    """Validity intervals per pattern from dated entries.

    entries: (pattern, entry_date, seq, listed). The last entry of a day (by
    ``seq``, then listed before unlisted) holds for that day, so a pattern has at
    most one row per day before the window sorts it, however often it is written.
    A null pattern or date is no entry. An entry holds until the next one.
    """
    last = F.max(F.struct("seq", "listed"))["listed"].alias("listed")
    daily = (
        entries.where("pattern is not null and entry_date is not null and listed is not null")
        .groupBy("pattern", "entry_date")
        .agg(last)
    )
    order = Window.partitionBy("pattern").orderBy("entry_date")
    return daily.select(
        "pattern",
        F.col("entry_date").alias("valid_from"),
        F.lead("entry_date").over(order).alias("valid_to"),
        "listed",
    ).where("listed")


def filter_urls(captures, entries):
    """Every capture row with the most specific entry active when it was fetched.

    captures: (page_id, url, fetch_date). Adds ``blocked``, ``matched_pattern``
    and ``listed_since``. Each row is kept once, repeated rows too; a null URL,
    host or fetch date is never blocked; other columns are dropped.

    The intervals of a pattern meet in one array (at most one per two days of the
    list's life), so each join is one row of the list to many captures and never
    multiplies rows. The list is written once: each join then reads both its sides
    from shuffles, where Spark can split the captures of a hot host among tasks.
    Without captures there are no rows; without entries nothing is blocked.
    """
    spans = validity(entries)
    listing = spans.groupBy("pattern").agg(
        F.collect_list(F.struct("valid_from", "valid_to")).alias("spans")
    )
    listing = written(listing, "listing")
    out = captures.select("page_id", "url", "fetch_date").select(
        "*", *[key.alias(f"_{level}") for level, key in url_keys(F.col("url")).items()]
    )
    for level in LEVELS:
        side = listing.select(
            F.col("pattern").alias(f"_{level}_pattern"), F.col("spans").alias(f"_{level}_spans")
        )
        out = out.join(side, F.col(f"_{level}") == F.col(f"_{level}_pattern"), "left")
        active = F.filter(
            f"_{level}_spans",
            lambda x: (x["valid_from"] <= F.col("fetch_date"))
            & (x["valid_to"].isNull() | (F.col("fetch_date") < x["valid_to"])),
        )
        hit = F.get(active, F.lit(0))
        out = out.withColumn(
            f"_{level}_hit",
            F.when(
                hit.isNotNull(),
                F.struct(F.col(f"_{level}_pattern").alias("pattern"), hit["valid_from"].alias("since")),
            ),
        ).drop(f"_{level}_pattern", f"_{level}_spans")
    best = F.coalesce(*[F.col(f"_{level}_hit") for level in LEVELS])
    return out.select(
        "page_id",
        "url",
        "fetch_date",
        best.isNotNull().alias("blocked"),
        best["pattern"].alias("matched_pattern"),
        best["since"].alias("listed_since"),
    )
