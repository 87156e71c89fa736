"""Registered plans of the engine against their check SQL, and wrong results mended."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sitewise.functions.text import social_links
from sitewise.functions.events import percent, seconds_of
from sitewise.operators import leads, runs, urls
from sitewise.plans import load_all
from sitewise.plans.registry import CHECKS, QUERIES

load_all()
SF = "/root/testdata/sf0.001"


def printed(rows):
    return sorted(str([repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_equals_check(spark, name):
    base = duckdb.connect()
    base.execute("SET timezone = 'UTC'")
    for t in ("events", "documents", "pages", "benchmark", "labels"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    check = base.execute(CHECKS[name])
    names = [d[0] for d in check.description]
    assert sorted(names) == sorted(found.columns)
    assert printed(found.select(*names).collect()) == printed(check.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_calls_at_one_instant_count_in_order(spark):
    calls = spark.createDataFrame([(i, "c", "2024-01-01 00:00:00") for i in range(3)], "event_id long, client string, ts string")
    out = runs.rate_window(calls.withColumn("ts", F.to_timestamp("ts")))
    assert [r.in_window for r in out.orderBy("event_id").collect()] == [0, 1, 2]


def history(clients, n, draw):
    """(event_id, client, ts, failed): many calls of one client in few minutes, ties included."""
    start = 1_704_067_200_000_000
    ids = draw.sample(range(n), n)
    spread = [3_000_000 * draw.randrange(2400) if draw.random() < 0.3 else 50_000 * draw.randrange(12_000) for _ in ids]
    return [(i, draw.choice(clients), start + at, draw.random() < 0.7) for i, at in zip(ids, spread)]


@pytest.mark.parametrize("clients", [["c"], ["a", "b", None]])
def test_busy_client_is_many_chunks(spark, clients):
    rows = history(clients, 6000, random.Random(3)) + [(9000, "c", None, True)]
    calls = spark.createDataFrame(rows, "event_id long, client string, at long, failed boolean")
    calls = calls.select("event_id", "client", F.timestamp_micros("at").alias("ts"), "failed", F.lit("x").alias("chunk_"))
    order = sorted(rows[:-1], key=lambda r: (r[2], r[0]))
    streaks, windows, failing, seen = {9000: 1}, {9000: (0, 0.0)}, {"c": 1}, {}
    for i, client, at, failed in order:
        failing[client] = failing.get(client, 0) + 1 if failed else 0
        streaks[i] = failing[client]
        held = seen[client] = [x for x in seen.get(client, []) if x >= at - 60_000_000]
        wait = max(0.0, 60 - (at - held[0]) / 1e6) if len(held) >= 5 else 0.0
        windows[i] = len(held), wait
        held.append(at)
    out = runs.failure_streak(calls, threshold=3, most_calls=100)
    assert out.columns == [*calls.columns, "streak", "opens"]
    assert {r.event_id: r.streak for r in out.collect()} == streaks
    out = runs.rate_window(calls, limit=5, most_calls=100).collect()
    assert len(out) == len(rows)
    assert {r.event_id: (r.in_window, round(r.wait_seconds, 6)) for r in out} == {i: (n, round(w, 6)) for i, (n, w) in windows.items()}
    sizes = runs.time_chunks(calls, F.unix_seconds("ts"), 3600, 100).groupBy("_who", "chunk").count()
    sizes = sorted(r["count"] for r in sizes.collect())
    assert sizes[-1] <= 2 * max(100, sizes[len(sizes) // 2])


def test_leads_without_site_stay_and_spread(spark):
    leads = spark.createDataFrame([(1, "https://a.com"), (2, None), (3, None), (4, "nowhere.org")], "lead long, company_website string")
    pages = spark.createDataFrame([(7, "http://a.com/x"), (5, "https://www.a.com"), (6, None)], "page_id long, url string")
    out = {r.lead: (r.pages, r.first_page) for r in urls.pages_per_lead(leads, pages).collect()}
    assert out == {1: (2, 5), 2: (0, None), 3: (0, None), 4: (0, None)}


def test_social_links_name_their_platform(spark):
    text = "see https://linkedin.com/in/a and www.facebook.com/b"
    links = spark.createDataFrame([(text,)], "t string").select(social_links(F.col("t")).alias("x")).first().x
    assert {(r.platform, r.url) for r in links} == {("linkedin", "https://linkedin.com/in/a"), ("facebook", "www.facebook.com/b")}


def test_rounding_follows_the_double(spark):
    ms = [0, 5, 15, 25, 35, 45, 55, 65, 125, 375, 999, 1005, 1115, 298165, 272225, 123456785, *range(995, 4000, 10)]
    rows = spark.createDataFrame([(m,) for m in ms], "ms long").select("ms", seconds_of(F.col("ms")).alias("s")).collect()
    assert [(r.ms, r.s) for r in rows] == [(m, round(m / 1000, 2) if m else None) for m in ms]
    pairs = [(a, b) for b in (0, 7, 16, 80, 400, 2000) for a in range(0, b + 1, max(1, b // 97))]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == [round(a / b * 100, 1) if b else 0.0 for a, b in pairs]


def test_leads_need_an_id(spark):
    lead = spark.createDataFrame([("A", "B", "x.com", None)], "first_name string, last_name string, company_website string, linkedin string")
    with pytest.raises(ValueError):
        leads.accepted(lead, F.current_timestamp())
    two = lead.unionAll(lead).withColumn("request_id", F.monotonically_increasing_id().cast("string"))
    assert leads.accepted(two, F.current_timestamp()).select("request_id").distinct().count() == 2
