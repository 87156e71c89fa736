"""Composed analysis, reports, their files and streams on small cases."""

import json
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from sitewise import session
from sitewise.operators import content, discovery, errors, reports
from sitewise.plans import load_all
from sitewise.plans.analysis import analyze_websites
from sitewise.plans.registry import QUERIES
from sitewise.session import shared_dir
from sitewise.sources import reports as files
from sitewise.streaming import intake
from sitewise.streaming.runner import work_paths

load_all()
SF = "/root/testdata/sf0.001"
LEAD = "request_id string, timestamp string, first_name string, last_name string, company_website string, linkedin string"
RESULT = "request_id string, url string, status string, reason string, human_readable_error string, content string, format string"
FETCH = "request_id string, url string, http_status int, error_kind string, html string"
CRAWL = "request_id string, pos int, url string, content string, status string, has_content boolean"


def test_results_keep_their_place_and_lose_none(spark):
    urls = spark.createDataFrame([("a", i, f"u{i}") for i in range(3)] + [("b", 0, "v0")], "request_id string, pos long, url string")
    given = [("a", 0, None), ("a", 1, "named"), ("b", 0, None), ("b", 1, None), ("b", 2, "beyond"), ("c", 0, None)]
    out = content.zip_results(urls, spark.createDataFrame(given, "request_id string, pos long, url string"))
    want = [("a", 0, "u0"), ("a", 1, "named"), ("b", 0, "v0"), ("b", 1, "unknown"), ("b", 2, "beyond"), ("c", 0, "unknown")]
    assert sorted((r.request_id, r.pos, r.url) for r in out.collect()) == want


def now():
    return F.lit("2024-03-01 10:20:30").cast("timestamp")


def results(spark, rows):
    full = [(r, u, s, why, None, "" if s == "error" else "text", None, i) for i, (r, u, s, why) in enumerate(rows)]
    return spark.createDataFrame(full, RESULT + ", pos long")


def test_second_fetch_only_where_all_were_refused(spark):
    paid = ("error", "http_402")
    rows = [("all", "https://a.com/", *paid), ("all", "https://a.com/x/y", *paid), ("all", "https://a.com/about", *paid)]
    rows += [("some", "https://b.com/", *paid), ("some", "https://b.com/about", "success", None)]
    rows += [("none", "https://c.com/x/y", *paid), ("other", "https://d.com/", *paid), ("other", "https://d.com/about", "error", "http_500")]
    rows += [("late", "https://e.com/", *paid), ("unfetched", "https://f.com/", *paid)]
    plain = [(r, u, 200, None, "<h1>Read</h1>") for r, u, *_ in rows if r not in ("late", "unfetched")]
    plain = [p if p[1] != "https://a.com/about" else (*p[:2], 404, None, None) for p in plain] + [("late", "https://e.com/", None, "timeout", None)]
    out = content.refetched(results(spark, rows), spark.createDataFrame(plain, FETCH))
    got = {(r.request_id, r.url): (r.status, r.reason) for r in out.collect()}
    want = {(r, u): (s, why) for r, u, s, why in rows}
    want |= {("all", "https://a.com/"): ("success", None), ("all", "https://a.com/about"): ("error", "http_404"), ("late", "https://e.com/"): ("error", "timeout")}
    assert got == want
    text = out.where("url = 'https://a.com/'").first()
    assert "Read" in text.content and text.format == "markdown" and text.pos == 0


def test_only_what_replaces_a_page_is_converted(spark):
    rows = [("a", "https://a.com/", "error", "http_402")]
    plain = [("a", "https://a.com/", 200, None, "<h1>Read</h1>"), ("b", "https://b.com/", 200, None, "<h1>Left</h1>")]
    out = content.refetched(results(spark, rows), spark.createDataFrame(plain, FETCH))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    converted = [i for i, line in enumerate(plan) if "<script" in line]
    join = min(i for i, line in enumerate(plan) if "Join LeftOuter" in line and "url" in line)
    assert converted and max(converted) < join
    assert [(r.status, "Read" in r.content) for r in out.collect()] == [("success", True)]


def test_crawl_pages_are_made_once(spark):
    made_rows = spark.sparkContext.accumulator(0)

    def seen(i):
        made_rows.add(1)
        return ("r1", i, f"https://a.com/about/{i}", "text", "success", True)

    crawl = spark.createDataFrame(spark.sparkContext.parallelize(range(20), 2).map(seen), CRAWL)
    leads = spark.createDataFrame([("r1", "t", "Ann", "Bell", "https://a.com", None)], LEAD)
    jobs = spark.createDataFrame([("r1", "success", None)], "request_id string, crawl_status string, crawl_reason string")
    a = analyze_websites(leads, jobs, crawl, spark.createDataFrame([], RESULT))
    assert a["pages"].where("source = 0").count() == 7 and a["urls"].count() == 20
    assert made_rows.value == 20


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_urls_of_a_crawl_are_cleaned_once(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = optimized(df)
        return session.stored(df, name)

    monkeypatch.setattr(discovery, "stored", kept)
    jobs = [("r1", "https://a.com", "success", None), ("r2", "x:y", "success", None), ("r3", None, "error", "http_402"), ("r4", "d.com", "timeout", None)]
    jobs = session.stored(spark.createDataFrame(jobs, "request_id string, website string, crawl_status string, crawl_reason string"), "jobs")
    rows = [("r1", 0, "a.com/about#"), ("r1", 1, "https://www.a.com/team"), ("r1", 2, "https://b.com"), ("r1", 3, None), ("r1", 4, "https://a.com/about/"), ("r9", 0, "a.com")]
    rows = session.stored(spark.createDataFrame(rows, "request_id string, pos int, url string"), "rows")
    headers, urls = discovery.discover(jobs, rows)
    mark = "https?://[^/?#]+/(?:"  # of one step of the cleaning
    assert {name: plan.count(mark) for name, plan in plans.items()} == {"routed": 1, "crawled": 1}
    assert mark not in optimized(headers) and mark not in optimized(urls)
    assert sorted(map(tuple, urls.collect())) == [("r1", 0, "https://a.com/about"), ("r1", 1, "https://www.a.com/team"), ("r4", 0, "https://d.com")]
    assert {r.request_id: (r.website, r.route) for r in headers.collect()} == {
        "r1": ("https://a.com", "crawl"), "r2": ("https://x:y", "crawl"), "r3": (None, "invalid"), "r4": ("https://d.com", "site_only")
    }


def test_report_files_are_parsed_once(spark):
    plan = QUERIES["report_roundtrip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1


def test_codes_of_trees(spark):
    deep = {"status": "success", "reason": "hidden"}
    for i in range(12):
        deep = {"status": "error" if i % 2 else None, "reason": f"r{i}", "results": [deep, "no object", {"reason": ""}, {"results": []}]}
    trees = [("a", json.dumps([deep, deep])), ("b", json.dumps({"reason": "alone"})), ("c", "no json"), ("d", None), ("e", "[]"), ("f", "[{}, 1]")]
    got = {tuple(r) for r in errors.distinct_codes(spark.createDataFrame(trees, "request_id string, results string")).collect()}
    assert got == {("a", f"r{i}") for i in range(12)} | {("b", "alone")}


def test_codes_come_in_report_order(spark):
    pages = [("a", (1, 5), "http_429"), ("a", (0, 200000), "http_500"), ("a", (1, 100001), "http_429"), ("a", (1, 6), None)]
    frame = spark.createDataFrame(pages, "request_id string, ord struct<source:int,rank:bigint>, reason string").withColumn("status", F.lit("error"))
    heads = spark.createDataFrame([("a", "timeout", "request_timeout"), ("b", "success", "x")], "request_id string, status string, reason string")
    out = errors.report_codes(errors.code_rows(heads, frame)).collect()
    assert [(r.request_id, r.codes) for r in out] == [("a", ["request_timeout", "http_500", "http_429", "http_429"])]


@pytest.fixture(scope="module")
def made(spark):
    leads = [
        ("r1", "t", "Ann", "Bell", "https://a.com", None, None),
        ("r2", "t", "", "Bell", "javascript:x", "linkedin.com/in/x", None),
        ("r3", "t", "Al", None, None, None, "stopped"),
        ("r4", "t", "Cy", "Dee", "https://d.com", None, "stopped"),
    ]
    frame = spark.createDataFrame(leads, LEAD + ", error_message string")
    jobs = spark.createDataFrame([("r1", "success", None), ("r4", "error", "http_429")], "request_id string, crawl_status string, crawl_reason string")
    crawl = [("r1", 0, "https://a.com/about", "About us", "success", True), ("r1", 1, "https://a.com/team", "", "no_content", True), ("r1", 2, "https://a.com/blog", "x", "success", False)]
    answers = [("r1", "https://a.com/blog", "error", "http_500", None, None, None), ("r4", "https://d.com", "error", "http_402", None, None, None)]
    fetched = [("r4", "https://d.com", 200, None, "<p>plain page</p>")]
    a = analyze_websites(frame, jobs, spark.createDataFrame(crawl, CRAWL), spark.createDataFrame(answers, RESULT), spark.createDataFrame(fetched, FETCH))
    return reports.build_reports(frame, a, reports.step_log(frame, a, now()), now()), frame, a


def test_reports_of_whole_failed_and_partial_runs(made):
    got = {r.request_id: r for r in made[0].collect()}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    one = got["r1"].website_analysis
    assert {p.url: p.status for p in one.scraped_content} == {"https://a.com/about": None, "https://a.com/team": "no_content", "https://a.com/blog": "error"}
    assert one.statistics.asDict() == {"total_discovered": 3, "total_filtered": 3, "total_scraped": 1, "scrape_failures": 2}
    assert [s.step for s in got["r1"]._processing_log] == ["url_discovery", "url_filtering", "content_scraping", "website_analysis"]
    assert got["r1"]["_metadata"].error_summary.error_codes == ["unknown", "http_500"] and got["r1"].error is None
    assert got["r2"].website_analysis.error == "Invalid URL" and got["r2"].linkedin_analysis.url == "linkedin.com/in/x"
    assert [(s.step, s.status) for s in got["r2"]._processing_log] == [("linkedin_analysis", "not_implemented"), ("website_analysis", "error")]
    assert got["r3"].error.message == "stopped" and got["r3"].website_analysis.scraped_content == [] and got["r3"]._processing_log == []
    four = got["r4"]
    assert four.error.message == "stopped" and four.website_analysis.discovery_reason == "http_429"
    assert [(p.url, p.content, p.status) for p in four.website_analysis.scraped_content] == [("https://d.com", "plain page", None)]
    assert four["_metadata"].processing.statistics.status_counts == {"error": 1, "success": 3}


def test_report_plan_is_one_aggregate(made):
    _, leads, a = made
    began = time.time()
    plan = reports.build_reports(leads, a, reports.step_log(leads, a, now()), now())._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 5
    assert plan.count("Exchange ") <= 10


def test_report_files_round_trip(spark, made):
    path, _ = work_paths(spark, "files")
    files.write_reports(made[0], path)
    files.write_reports(made[0], path)
    spark.sql("select '{broken' as value").write.mode("append").text(f"{path}/report_date=2024-03-01")
    back = files.read_reports(spark, path)
    assert [r._corrupt for r in back.select("request_id", "_corrupt").collect() if r.request_id is None] == ["{broken"]
    good = back.where("_corrupt is null").drop("_corrupt", "report_date")
    assert sorted(good.collect(), key=str) == sorted(made[0].collect(), key=str)
    assert '"error":null' in spark.read.text(path).where("value like '%\"r1\"%'").first().value
    # another day stays when one is written again
    later = made[0].withColumn("_metadata", F.col("_metadata").withField("saved_at", F.lit("2024-03-02T00:00:00+00:00")))
    files.write_reports(later, path)
    assert len(files.read_reports(spark, path).select("request_id").where("request_id is not null").collect()) == 8


def test_a_file_at_the_limit_stays(spark, made):
    path, _ = work_paths(spark, "limit")
    files.write_reports(made[0], path)
    found = files.report_files(spark, path, "*.json")
    n = found.count()
    at = found.first().modified
    one = found.where(F.col("modified") == F.lit(at))
    limit = F.lit(at) + F.make_interval(days=F.lit(7))
    assert n and reports.expired(one, limit, 7).count() == 0
    assert reports.expired(one, limit + F.make_interval(secs=F.lit(1)), 7).count() == one.count()


def test_a_replayed_batch_leaves_one_copy(spark, made):
    path = f"{shared_dir(spark)}/replay"
    save = intake.saved_batch(lambda batch: made[0].join(batch.select("request_id"), "request_id", "left_semi"), path)
    for batch_id in (0, 1, 1):
        save(made[1].where(f"request_id = 'r{batch_id + 1}'"), batch_id)
    assert sorted(r.request_id for r in spark.read.schema(reports.schemas.REPORT).json(path).collect()) == ["r1", "r2"]


def test_tasks_of_a_batch_dont_grow_with_it(spark, monkeypatch):
    name, path, seen = "spark.sql.shuffle.partitions", f"{shared_dir(spark)}/sized", []
    monkeypatch.setattr(intake, "LEADS_PER_PARTITION", 10)
    usual = spark.conf.get(name)

    def build(leads):
        seen.append((leads.sparkSession.conf.get(name), leads.groupBy("request_id").count().rdd.getNumPartitions()))
        return leads

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the session of a stream
    try:
        for batch_id, n in enumerate((1000, 5)):
            intake.saved_batch(build, path)(spark.range(n).select(F.col("id").cast("string").alias("request_id")), batch_id)
            assert spark.conf.get(name) == usual
        with pytest.raises(ZeroDivisionError):
            intake.saved_batch(lambda leads: 1 / 0, path)(spark.range(1000), 2)
        assert spark.conf.get(name) == usual
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen == [("100", 100), (usual, int(usual))]
    assert spark.read.json(path).groupBy("batch").count().orderBy("batch").collect() == [(0, 1000), (1, 5)]


def test_only_the_reports_grow_with_a_batch(spark, monkeypatch):
    monkeypatch.setattr(intake, "LEADS_PER_SLICE", 250, raising=False)
    root, folder = shared_dir(spark).removeprefix("file://"), f"{shared_dir(spark)}/sliced"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
    tables = lambda: {str(p.parent) for p in pathlib.Path(root).rglob("*.parquet")}
    usual, before, files_before, seen = session_settings(spark), tables(), shuffled(), []

    def build(leads):
        once = session.stored(leads.groupBy("request_id").count().withColumn("text", F.repeat(F.lit("a report "), 1000)), "urls")
        again = session.stored(once.where("request_id % 2 = 0"), "urls")
        seen.append(once.count())
        return once.join(again.select("request_id", F.lit("even").alias("kind")), "request_id", "left")

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the session of a stream
    try:
        save = intake.saved_batch(build, folder)
        for batch_id, n in ((0, 1000), (0, 1000), (1, 10), (2, 0)):
            save(spark.range(n).select(F.col("id").cast("string").alias("request_id")), batch_id)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) == 10 and sum(seen) == 2010 and max(seen) < 350
    made = sorted(p.rsplit("/", 1)[1] for p in tables() - before)
    assert made == ["leads-1", "urls-1", "urls-2"] and shuffled() <= files_before and session_settings(spark) == usual
    rows = spark.read.schema("request_id string, count long, kind string, text string, batch int").json(folder)
    found = rows.groupBy("batch").agg(F.count("*"), F.countDistinct("request_id"), F.count("kind"), F.sum("count"), F.sum(F.length("text")))
    assert sorted(map(tuple, found.collect())) == [(0, 1000, 1000, 500, 1000, 9_000_000), (1, 10, 10, 5, 10, 90_000)]
    sizes = [p.stat().st_size for p in pathlib.Path(root, "sliced").rglob("part-*")]
    assert sum(sizes) < 9_000_000 / 20


def session_settings(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    return [spark.conf.get(n, "false") for n in names]


def test_a_stored_file_has_a_bound_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_FILE", 100)
    table = session.stored(spark.range(0, 1000, 1, 1).withColumn("url", F.lit("https://a.com/about")), "urls")
    assert len(table.inputFiles()) == 10 and table.distinct().count() == 1000


def test_stream_equals_its_batch_twin(spark):
    from sitewise.plans import report_queries as q
    from sitewise.plans.stream_queries import KEY, _signed

    events = spark.read.parquet(f"{SF}/events.parquet")
    twice = _signed(events.unionAll(events), "ts")
    leads = intake.intake_once(twice, KEY, now())
    assert leads.count() == leads.select("request_id").distinct().count()
    twin = q.streamed_digest(q.streamed_reports(spark, leads))
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, QUERIES["stream_reports"](spark, SF).collect()))


@pytest.mark.parametrize(
    "name",
    ["same_site_filter", "url_scores", "top_urls_per_site", "runner_up_urls", "filter_stats", "filter_reason_map", "discovery_urls", "discovery_routing"],
)
def test_url_plans_compile_whole(spark, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
