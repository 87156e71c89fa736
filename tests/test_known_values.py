"""Values known beforehand, written out: nothing here is taken from the library's tables."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from sitewise.functions import events as V
from sitewise.functions.errors import error_summary
from sitewise.functions.text import capitalised_letters, format_bytes
from sitewise.functions.urls import safe_url
from sitewise.operators import discovery, errors, leads, ranking, runs
from sitewise.sources.leads import parsed_leads, read_leads
from sitewise.streaming.runner import work_paths

BEST = [
    ("about-us", "contains_about, about_us_page, shallow_url, short_url"),
    ("leadership", "contains_leadership, leadership_page, shallow_url, short_url"),
    ("our-team", "contains_team, team_page, shallow_url, short_url"),
    ("case-studies", "contains_case-studies, case_studies, shallow_url, short_url"),
    ("portfolio", "contains_portfolio, portfolio, shallow_url, short_url"),
    ("services", "contains_services, services, shallow_url, short_url"),
    ("solutions", "contains_solutions, solutions, shallow_url, short_url"),
]


def test_best_seven_of_a_site(spark):
    sites = spark.createDataFrame([("r", "https://openai.com")], "request_id string, website string")
    urls = discovery.candidate_urls(sites)
    assert urls.count() == 34
    kept = ranking.ranked_urls(urls).where("kept").orderBy("rank").collect()
    assert [(r.url, r.reason) for r in kept] == [(f"https://openai.com/{p}", why) for p, why in BEST]


def test_minimal_site(spark):
    sites = spark.createDataFrame([("r", "https://example.com")], "request_id string, website string")
    kept = ranking.ranked_urls(discovery.candidate_urls(sites)).where("kept").collect()
    assert [(r.url, r.reason, r.score) for r in kept] == [("https://example.com", "shallow_url, short_url", 3)]


JANE = {"first_name": "Jane", "last_name": "Smith"}
SITE = {"company_website": "https://example.com"}
REQUESTS = [
    ({**JANE, **SITE, "linkedin": "https://linkedin.com/in/janesmith"}, ""),
    ({**JANE, **SITE}, ""),
    ({**JANE, "linkedin": "linkedin.com/in/alicej"}, ""),
    ({**JANE, **SITE, "linkedin": None}, ""),
    ({**JANE, "company_website": "example.com"}, ""),
    ({"first_name": "  Jane  ", "last_name": "  Smith  ", **SITE}, ""),
    ({**JANE, **SITE, "unknown": [1, {"a": 2}]}, ""),
    ({"first_name": "A" * 100, "last_name": "Smith", **SITE}, ""),
    (JANE, "source: none given"),
    ({**JANE, "company_website": "", "linkedin": ""}, "source: none given"),
    ({"last_name": "Smith", **SITE}, "first_name: missing"),
    ({"first_name": "Jane", **SITE}, "last_name: missing"),
    ({"first_name": "", "last_name": "Smith", **SITE}, "first_name: too short"),
    ({"first_name": "Jane", "last_name": "   ", **SITE}, "last_name: blank"),
    ({"first_name": "A" * 101, "last_name": "Smith", **SITE}, "first_name: too long"),
    ({**JANE, "company_website": "https://example.com/" + "a" * 500}, "company_website: too long"),
    ({"first_name": 7, "last_name": None, **SITE}, "first_name: no text"),
    ({**JANE, "company_website": {"url": "a.com"}}, "company_website: no text"),
    ([JANE], "body: no object"),
    ("Jane", "body: no object"),
    (None, "body: no object"),
]


def test_request_bodies(spark):
    rows = [(i, json.dumps(body)) for i, (body, _) in enumerate(REQUESTS)]
    rows += [(len(rows), '{"first_name": "Jane", '), (len(rows) + 1, ""), (len(rows) + 2, None)]
    found = leads.requested(parsed_leads(spark.createDataFrame(rows, "i int, value string"))).orderBy("i").collect()
    assert [", ".join(r.errors) for r in found] == [why for _, why in REQUESTS] + ["body: no object"] * 3
    assert (found[5].first_name, found[5].last_name) == ("Jane", "Smith")


def test_request_files(spark):
    path, _ = work_paths(spark, "bodies")
    lines = [json.dumps({**JANE, **SITE}), "", "   ", "{", json.dumps({**JANE, "linkedin": "é\n"})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    found = leads.requested(read_leads(spark, path))
    assert sorted((r.linkedin or "", ",".join(r.errors)) for r in found.collect()) == [("", ""), ("", "body: no object"), ("é", "")]
    empty, _ = work_paths(spark, "bodies")
    spark.createDataFrame([], "value string").write.text(empty)
    assert leads.requested(read_leads(spark, empty)).count() == 0


def test_safe_urls(spark):
    known = {"": None, "   ": None, "javascript:alert('xss')": None, None: None, "example.com": "https://example.com", "http://example.com": "http://example.com"}
    rows = spark.createDataFrame([(u,) for u in [*known, "not-a-url"]], "u string").select("u", safe_url(F.col("u")).alias("s")).collect()
    found = {r.u: r.s for r in rows}
    assert found.pop("not-a-url") is not None
    assert found == known


def test_retryable(spark):
    cases = [(429, None, True), (500, None, True), (503, None, True), (400, None, False), (404, None, False), (200, None, False)]
    cases += [(0, "timeout", True), (0, "connect", True), (0, "parse", False), (None, None, False)]
    rows = spark.createDataFrame(cases, "http int, kind string, want boolean")
    found = rows.select("want", V.is_retryable(F.col("http"), F.col("kind")).alias("got")).collect()
    assert [r.got for r in found] == [r.want for r in found]


@pytest.mark.parametrize("key", ["test-secret-key", None])
def test_signatures(spark, key):
    payload = b'{"test": "data"}'
    right = hmac.new(b"test-secret-key", payload, hashlib.sha256).hexdigest()
    given = ["s=" + right, "s=wrong", right, None, ""]
    rows = spark.createDataFrame([(payload, s) for s in given], "payload binary, signature string")
    found = [r.ok for r in rows.select(V.is_authentic(F.col("payload"), F.col("signature"), key).alias("ok")).collect()]
    assert found == ([True] * 5 if key is None else [True, False, False, False, False])


def test_names(spark):
    rows = spark.createDataFrame([("Jean-Claude",), ("José",), ("Mary Jane",), ("",), (None,)], "n string")
    found = [r.x for r in rows.select(capitalised_letters(F.col("n")).alias("x")).collect()]
    assert found == ["JeanClaude", "Jos", "MaryJane", "", ""]


@pytest.mark.parametrize(
    "steps, want",
    [
        ([(1500, "success"), (200, "success"), (3000, "success")], (4700, 4.7, 3, 100.0, {"success": 3})),
        ([(6607, "error"), (0, "success"), (649, "success"), (7257, "success")], (14513, 14.51, 4, 75.0, {"success": 3, "error": 1})),
    ],
)
def test_step_statistics(spark, steps, want):
    log = spark.createDataFrame([("r", s, ms, None) for ms, s in steps], "request_id string, status string, duration_ms long, api_calls long")
    r = runs.step_stats(log).first()
    assert (r.total_duration_ms, r.total_duration_seconds, r.total_steps, r.success_rate, r.status_counts) == want


def test_summary_of_one_refusal(spark):
    s = spark.sql("select array('http_429') as c").select(error_summary(F.col("c")).alias("s")).first().s
    assert (s.has_errors, s.total_errors, s.error_codes, s.categories) == (True, 1, ["http_429"], {"rate_limit": ["http_429"]})
    assert (s.has_payment_issues, s.has_rate_limit_issues, s.max_severity, s.max_priority) == (False, True, "medium", 2)
    assert s.recommended_actions == ["wait_and_retry"]
    assert s.user_message.startswith("Some operations were rate limited or timed out.")


def test_sizes(spark):
    known = {0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1029: "1.00 KB", 1536: "1.50 KB", 1048575: "1024.00 KB", 1 << 20: "1.00 MB",
             5 << 30: "5.00 GB", 5 << 40: "5.00 TB", 3 << 50: "3.00 PB", 2000 << 50: "2000.00 PB", None: None}
    rows = spark.createDataFrame([(n,) for n in known], "n long").select("n", format_bytes(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == known


def test_enhanced_log(spark):
    rows = [(1, "error", "http_429"), (2, "success", "http_429"), (3, "error", ""), (4, None, "odd"), (5, "skipped", None)]
    log = spark.createDataFrame(rows, "id int, status string, error_code string").withColumns({c: F.lit("own") for c in ("message", "title", "code", "a.b")})
    out = errors.enhanced_log(log).orderBy("id").collect()
    assert [r.error_code for r in out] == ["http_429", None, None, "odd", None]
    assert out[3].human_readable_error == "Unknown error: odd" and out[3].suggested_action is None
    assert out[0].suggested_action.code == "wait_and_retry" and out[0].human_readable_error.endswith(out[0].suggested_action.description + ".")
    assert [(r.human_readable_error, r.suggested_action) for r in (out[1], out[2], out[4])] == [(None, None)] * 3
    assert {r.title for r in out} == {"own"}
    assert errors.enhanced_log(log.limit(0)).count() == 0
