"""Rule tables, path lists and the error catalogue.

The constants below must equal the known ones for results to be right.
"""

import json

from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------

REGISTRATION_EVENT = "user.registration.requested"
REPORT_VERSION = "1.1.0"

URLS_PER_SITE = 50
URLS_KEPT = 7
RUNNER_UPS = 5
MAX_RETRIES = 3
BASE_DELAY_SECONDS = 1.0
MAX_DELAY_SECONDS = 60
REQUESTS_PER_MINUTE = 30
CRAWL_MAX_WAIT_SECONDS = 300
CIRCUIT_FAILURES = 5
CIRCUIT_RECOVERY_SECONDS = 60

VALUABLE_PATHS = (
    "about,our-approach,team,leadership,services,solutions,case-studies,customers,"
    "blog,investors,culture,portfolio,clients,work,projects"
)

EXCLUDED_PATHS = (
    "privacy,terms,cookie,careers,contact,login,signup,register,press-kit,media-kit,"
    "legal,disclaimer,accessibility,sitemap"
)

# (path pattern, points, reason); only the first match counts
HIGH_VALUE_PATTERNS = [
    (r"/about[-_]?us", 15, "about_us_page"),
    (r"/our[-_]?team", 15, "team_page"),
    (r"/leadership", 15, "leadership_page"),
    (r"/case[-_]?stud", 12, "case_studies"),
    (r"/portfolio", 12, "portfolio"),
    (r"/services?", 10, "services"),
    (r"/solutions?", 10, "solutions"),
    (r"/products?", 10, "products"),
    (r"/customers?", 10, "customers"),
    (r"/clients?", 10, "clients"),
    (r"/testimonials?", 8, "testimonials"),
    (r"/mission", 8, "mission"),
    (r"/values?", 8, "values"),
    (r"/culture", 8, "culture"),
    (r"/blog/", 5, "blog_post"),
    (r"/insights?/", 5, "insights"),
    (r"/20\p{Nd}{2}/", 3, "dated_content"),
]

# (path pattern, points, reason); every match counts
LOW_VALUE_PATTERNS = [
    (r"/tag/", -5, "tag_page"),
    (r"/category/", -5, "category_page"),
    (r"/page/\p{Nd}+", -5, "pagination"),
    (r"/search", -10, "search_page"),
    (r"/login", -10, "login_page"),
    (r"/signup", -10, "signup_page"),
    (r"/register", -10, "register_page"),
    (r"/cart", -10, "cart_page"),
    (r"/checkout", -10, "checkout_page"),
    (r"\.pdf\z", -3, "pdf_file"),
    (r"\.(?:jpg|jpeg|png|gif|svg)\z", -10, "image_file"),
    (r"\.(?:css|js)\z", -20, "asset_file"),
    (r"/wp-", -5, "wordpress_internal"),
    (r"/feed", -10, "feed_url"),
    (r"/rss", -10, "rss_url"),
]

HOMEPAGE_PATHS = ["/", "/index", "/index.html", "/home"]

CATEGORY_KEYWORDS = [
    ("company_info", ["about", "mission", "vision", "values", "culture", "history"]),
    ("team", ["team", "leadership", "executive", "founder", "board", "advisor"]),
    ("offerings", ["service", "solution", "product", "offering", "feature"]),
    (
        "evidence",
        ["case", "study", "portfolio", "work", "project", "client", "customer"],
    ),
    ("content", ["blog", "article", "post", "news", "insight", "resource"]),
    ("contact", ["contact", "location", "office"]),
    ("careers", ["career", "job", "hiring", "recruit"]),
    ("legal", ["privacy", "terms", "legal", "cookie", "gdpr"]),
    ("technical", ["api", "docs", "documentation", "developer"]),
]

VALUABLE_DISCOVERY_WORDS = [
    "about", "team", "leadership", "executive",
    "service", "solution", "product", "offering",
    "case", "study", "portfolio", "work", "project",
    "client", "customer", "testimonial", "review",
    "mission", "vision", "value", "culture",
    "investor", "relation", "financial",
    "blog", "insight", "resource", "whitepaper",
]

SIMPLE_HOSTS = ["example.com", "example.org", "example.net", "httpbin.org"]
SIMPLE_PATHS = ["index.html", "about", "contact", "home"]

MINIMAL_HOST = "example.com"

CANDIDATE_PATHS = [
    "", "/about", "/about-us", "/our-story", "/mission",
    "/team", "/leadership", "/our-team",
    "/services", "/solutions", "/products", "/what-we-do",
    "/case-studies", "/portfolio", "/our-work",
    "/clients", "/customers", "/testimonials",
    "/blog", "/news", "/insights", "/resources",
    "/contact", "/contact-us", "/careers", "/jobs",
    "/investors", "/investor-relations", "/press", "/media",
    "/index.html", "/about.html", "/services.html", "/contact.html",
]

SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap", "/robots.txt"]

SOCIAL_PLATFORMS = ["linkedin", "twitter", "facebook", "instagram", "github"]

PAYMENT_CODES = ["http_402", "http_401", "http_403"]
RATE_LIMIT_CODES = ["http_429", "http_408", "request_timeout"]

PAYMENT_MESSAGE = (
    "Some operations failed due to API credit exhaustion or authentication issues. "
    "Please check your API credits and key configuration."
)
RATE_LIMIT_MESSAGE = (
    "Some operations were rate limited or timed out. The API may be experiencing high "
    "load. Please wait and retry."
)
SERVER_MESSAGE = (
    "Some operations failed due to server issues. The API service may be experiencing "
    "technical difficulties."
)
CONFIGURATION_MESSAGE = (
    "Some operations were skipped due to missing configuration. Please check your API "
    "key and settings."
)
OTHER_AREAS_PREFIX = "Some operations encountered errors in the following areas: "

LINKEDIN_PLAN = "See README.md for LinkedIn integration plan"

# (code, message, category, action, severity)
ERROR_CATALOG = [
    ("http_402", "API credits exhausted. Please add credits to your Firecrawl account to continue web scraping.", "payment", "add_credits", "high"),
    ("http_429", "Rate limit exceeded. The API is temporarily throttling requests to prevent overload.", "rate_limit", "wait_and_retry", "medium"),
    ("http_408", "Request timeout. The server took too long to respond, possibly due to high load or rate limiting.", "timeout", "wait_and_retry", "medium"),
    ("http_500", "Internal server error. The API service is experiencing technical difficulties.", "server_error", "contact_support", "high"),
    ("http_502", "Bad gateway. The API service is temporarily unavailable.", "server_error", "wait_and_retry", "medium"),
    ("http_503", "Service unavailable. The API is temporarily down for maintenance.", "server_error", "wait_and_retry", "medium"),
    ("http_504", "Gateway timeout. The API service is not responding.", "server_error", "wait_and_retry", "medium"),
    ("http_401", "Authentication failed. Check your API key configuration.", "authentication", "check_api_key", "high"),
    ("http_403", "Access forbidden. Your API key may lack required permissions.", "authorization", "check_permissions", "high"),
    ("http_404", "URL not found. The requested resource could not be located.", "not_found", "check_url", "low"),
    ("circuit_breaker_open", "Circuit breaker activated due to repeated API failures. Service is temporarily paused to prevent further errors.", "circuit_breaker", "wait_and_retry", "high"),
    ("request_timeout", "Request timeout after multiple retries. The service may be overloaded or experiencing issues.", "timeout", "wait_and_retry", "medium"),
    ("http_error", "Network or HTTP communication error occurred during the request.", "network", "check_connection", "medium"),
    ("no_api_key", "No API key provided. Running in fallback mode with limited functionality.", "configuration", "add_api_key", "low"),
    ("invalid_url", "The provided URL is invalid or malformed.", "validation", "check_url", "low"),
    ("skipped", "Operation skipped due to missing configuration or API key.", "configuration", "check_configuration", "low"),
    ("crawl_failed", "Crawl job failed to complete. The website may be inaccessible or have restrictions.", "crawl_error", "check_url", "medium"),
    ("crawl_timeout", "Crawl job timed out. The website may be very large or slow to respond.", "timeout", "wait_and_retry", "medium"),
    ("no_job_id", "Failed to start crawl job. API may be experiencing issues.", "api_error", "contact_support", "high"),
]

# (action, title, description, url)
ACTION_GUIDANCE = [
    ("add_credits", "Add API Credits", "Purchase additional API credits from your Firecrawl dashboard", "https://firecrawl.dev/dashboard"),
    ("wait_and_retry", "Wait and Retry", "Wait a few minutes before trying again to allow the service to recover", None),
    ("contact_support", "Contact Support", "Reach out to API support if the issue persists", "https://firecrawl.dev/support"),
    ("check_api_key", "Check API Key", "Verify your API key is correct in the .env file", None),
    ("check_permissions", "Check Permissions", "Ensure your API key has the required permissions for this operation", None),
    ("check_url", "Check URL", "Verify the URL is correct, accessible, and properly formatted", None),
    ("add_api_key", "Add API Key", "Add your Firecrawl API key to the .env file for full functionality", "https://firecrawl.dev/dashboard"),
    ("check_configuration", "Check Configuration", "Verify all required configuration settings are properly set", None),
    ("check_connection", "Check Connection", "Verify your internet connection and network settings", None),
]

# (severity, priority, description)
SEVERITIES = [
    ("low", 1, "Minor issue, operation can continue"),
    ("medium", 2, "Significant issue, some functionality affected"),
    ("high", 3, "Critical issue, major functionality impacted"),
]

# ---- end of fixed values ----------------------------------------------------


def comma_list(col):
    """Comma-separated setting -> trimmed, non-empty words."""
    from sitewise.functions.text import strip

    return F.filter(
        F.transform(F.split(col, ",", -1), strip), lambda word: word != ""
    )


def words_of(setting):
    """The same for a plan-time string."""
    return [word.strip() for word in setting.split(",") if word.strip()]


def literal_rows(spark, rows, ddl):
    """Small fixed table as a local relation."""
    names = [field.split()[0] for field in ddl.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    schema = "array<struct<" + ddl.replace(" ", ": ").replace(",: ", ", ") + ">>"
    return spark.sql(
        "select inline(from_json(:rows, :schema))", args={"rows": text, "schema": schema}
    )


def error_catalog(spark):
    ddl = "code string, message string, category string, action string, severity string"
    return literal_rows(spark, ERROR_CATALOG, ddl)


def action_guidance(spark):
    ddl = "action string, title string, description string, url string"
    return literal_rows(spark, ACTION_GUIDANCE, ddl)


def severities(spark):
    return literal_rows(
        spark, SEVERITIES, "severity string, priority int, description string"
    )
