"""Schemas of the inputs and of the report."""

LEAD_IN = (
    "first_name string, last_name string, company_website string, linkedin string"
)

LEAD = f"request_id string, timestamp string, {LEAD_IN}"

ENVELOPE = f"name string, data struct<{LEAD.replace(' string', ': string')}>, id string, ts double"

CRAWL_JOB = (
    "success boolean, status string, id string, completed int, total int, "
    "data array<struct<url: string, markdown: string, html: string, "
    "metadata: struct<sourceURL: string>>>"
)

SCRAPE_BODY = (
    "success boolean, data struct<markdown: string, html: string, text: string>"
)

LOG_ENTRY = (
    "step: string, duration_ms: bigint, status: string, timestamp: string, "
    "urls_found: bigint, input_urls: bigint, output_urls: bigint, "
    "urls_from_crawl: bigint, urls_scraped_separately: bigint, "
    "successful_scrapes: bigint, failed_scrapes: bigint, api_calls: bigint"
)

ERROR_SUMMARY = (
    "has_errors: boolean, total_errors: int, error_codes: array<string>, "
    "categories: map<string, array<string>>, has_payment_issues: boolean, "
    "payment_errors: array<string>, has_rate_limit_issues: boolean, "
    "rate_limit_errors: array<string>, max_severity: string, max_priority: int, "
    "recommended_actions: array<string>, user_message: string"
)

REPORT = f"""
request_id string,
timestamp string,
input_data struct<first_name: string, last_name: string,
    company_website: string, linkedin: string>,
linkedin_analysis struct<status: string, url: string, implementation_plan: string>,
website_analysis struct<
    discovered_urls: array<string>,
    filtered_urls: array<string>,
    scraped_content: array<struct<url: string, content: string, status: string,
        reason: string, human_readable_error: string>>,
    filter_reasons: map<string, string>,
    discovery_status: string,
    discovery_reason: string,
    statistics: struct<total_discovered: bigint, total_filtered: bigint,
        total_scraped: bigint, scrape_failures: bigint>,
    error: string>,
_processing_log array<struct<{LOG_ENTRY}>>,
_metadata struct<
    filename: string,
    person_name: string,
    saved_at: string,
    version: string,
    processing: struct<started_at: string, completed_at: string,
        duration_ms: bigint, duration_seconds: double,
        steps: array<struct<{LOG_ENTRY}>>,
        statistics: struct<total_duration_ms: bigint, total_duration_seconds: double,
            total_steps: bigint, status_counts: map<string, bigint>,
            total_api_calls: bigint, success_rate: double>>,
    resources: struct<content_bytes_scraped: bigint, urls_discovered: bigint,
        urls_filtered: bigint, urls_scraped: bigint, scrape_success_rate: double>,
    error_summary: struct<{ERROR_SUMMARY}>>,
error struct<message: string, type: string, timestamp: string>
"""
