"""URL normalisation, parts, predicates and keys over string columns."""

from functools import reduce

from pyspark.sql import functions as F

from sitewise.dims import (
    CATEGORY_KEYWORDS,
    SIMPLE_HOSTS,
    SIMPLE_PATHS,
    VALUABLE_DISCOVERY_WORDS,
)
from sitewise.functions.text import strip

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"


def _parse_ready(url):
    # leading controls and spaces, and any tab or line break, are not URL text
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]+", "")


#: A whole host part without brackets, or with a bracketed IPv6 or versioned address.
_HOST = (
    r"(?:[^/?#\[\]]*|(?:[^/?#]*@)?\[(?:[vV][0-9A-Fa-f]+\.[^/?#@]+"
    r"|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:\.[0-9]+)*(?:%[^\]/?#@]+)?)\](?::[^/?#@]*)?)(?![^/?#])"
)


def netloc(url):
    """Host part with port and user info, '' when absent."""
    return F.regexp_extract(_parse_ready(url), rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def path(url):
    """Path without parameters, query and fragment."""
    whole = F.regexp_extract(
        _parse_ready(url), rf"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.regexp_replace(whole, r";[^/]*\z", "")


def origin(url):
    """scheme://host of an http(s) URL."""
    scheme = F.lower(F.regexp_extract(_parse_ready(url), rf"^({_SCHEME})", 1))
    return F.concat(scheme, F.lit("//"), netloc(url))


def safe_url(url):
    """Canonical URL, or null when it cannot be one.

    One chain in which each step reads the one before once, so that plans stay small.
    """
    # what names another scheme stays without one and fits the last pattern nowhere
    text = F.regexp_replace(strip(url), r"^(?!https?://|(?i:javascript|data|file|ftp):)", "https://")
    text = F.regexp_replace(text, r"[\t\r\n]+", "")
    # a delimiter with nothing behind it is dropped: fragment, query, parameters
    text = F.regexp_replace(text, r"(?s)^([^#]*)#\z", "$1")
    text = F.regexp_replace(text, r"(?s)^([^?#]*)\?(#|\z)", "$1$2")
    text = F.regexp_replace(
        text, r"(?s)^(https?://[^/?#]+/(?:[^?#]*/)?[^/;?#]*);([?#]|\z)", "$1$2"
    )
    return F.regexp_substr(text, F.lit(rf"(?s)^https?://(?=[^/?#]){_HOST}.*"))


def is_valid_url(url):
    """True for http(s) with a host; false, never null, otherwise."""
    return F.coalesce(_parse_ready(url).rlike(rf"(?i)^https?://(?=[^/?#])(?-i){_HOST}"), F.lit(False))


def domain(url):
    """Lower-case host part, '' when absent, null when malformed."""
    fits = _parse_ready(url).rlike(rf"^(?:{_SCHEME})?//{_HOST}|^(?!(?:{_SCHEME})?//)")
    return F.when(fits, F.lower(netloc(url)))


def site_key(url):
    """Domain without 'www.', null when empty or malformed: the equi-join key for one site."""
    host = F.regexp_extract(_parse_ready(url), rf"^(?:{_SCHEME})?//({_HOST})", 1)
    return F.replace(F.nullif(F.lower(host), F.lit("")), F.lit("www."), F.lit(""))


def is_same_domain(left, right):
    return F.coalesce(site_key(left) == site_key(right), F.lit(False))


def first_seen_key(url):
    """Key under which discovered URLs count as the same page."""
    return F.split_part(F.regexp_replace(url, r"/+\z", ""), F.lit("#"), F.lit(1))


def similar_key(url):
    """Looser key: case, trailing slash, scheme, query and fragment ignored."""
    text = F.regexp_replace(F.lower(url), r"/+\z", "")
    text = F.replace(text, F.lit("https://"), F.lit("http://"))
    return F.regexp_extract(text, r"(?s)^([^?#]*)", 1)


def _contains_any(text, words):
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_valuable_discovery_url(url):
    lower_path = F.lower(path(F.lower(url)))
    return _contains_any(lower_path, VALUABLE_DISCOVERY_WORDS) | lower_path.rlike(
        r"/20\p{Nd}{2}/"
    )


def is_simple_scrape_url(url):
    bare = F.regexp_replace(F.lower(path(url)), r"^/+|(?<!/)/++\z", "")
    return F.lower(netloc(url)).isin(SIMPLE_HOSTS) | bare.isin([""] + SIMPLE_PATHS)


def url_category(url):
    """First keyword group found in the path, else 'other'."""
    lower_path = F.lower(path(F.lower(url)))
    out = None
    for name, words in CATEGORY_KEYWORDS:
        hit = _contains_any(lower_path, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("other")
