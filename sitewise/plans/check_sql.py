"""DuckDB text for the check SQL: the rules once more, in RE2 and plain SQL."""

from sitewise import dims

# Unicode whitespace, as in functions.text but for RE2
WS_LINE = (
    r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = r"\n" + WS_LINE

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"


def text(value):
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if any(ord(c) < 32 for c in value):
        parts, run = [], ""
        for c in value:
            if ord(c) < 32:
                parts += [text(run)] if run else []
                parts.append(f"chr({ord(c)})")
                run = ""
            else:
                run += c
        parts += [text(run)] if run else []
        return "(" + " || ".join(parts) + ")"
    return "'" + value.replace("'", "''") + "'"


def values(rows):
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def sub(expr, pattern, replacement="", flags="g"):
    return f"regexp_replace({expr}, {text(pattern)}, {text(replacement)}, '{flags}')"


def extract(expr, pattern, group=0):
    return f"regexp_extract({expr}, {text(pattern)}, {group})"


def extract_all(expr, pattern, group=0):
    return f"regexp_extract_all({expr}, {text(pattern)}, {group})"


def matches(expr, pattern):
    return f"regexp_matches({expr}, {text(pattern)})"


def strip(expr):
    return sub(expr, rf"^[{WS}]+|[{WS}]+\z")


def ready(expr):
    return sub(expr, r"^[\x00-\x20]+|[\t\r\n]+")


def netloc(expr):
    return extract(ready(expr), rf"^(?:{SCHEME})?//([^/?#]*)", 1)


def path(expr):
    whole = extract(ready(expr), rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)
    return sub(whole, r";[^/]*\z")


def origin(expr):
    scheme = extract(ready(expr), rf"^({SCHEME})", 1)
    return f"(lower({scheme}) || '//' || {netloc(expr)})"


def bad_brackets(host):
    good = (
        r"^\[(?:[vV][0-9A-Fa-f]+\..+|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*"
        r"(?:\.[0-9]+)*(?:%[^\]]+)?)\](?::.*)?\z"
    )
    bare = sub(host, r"^.*@", "", "")
    return f"((contains({host}, '[') OR contains({host}, ']')) AND NOT {matches(bare, good)})"


def safe_url(expr):
    raw = strip(expr)
    schemed = (
        f"CASE WHEN {matches(raw, '^https?://')} THEN {raw} ELSE 'https://' || {raw} END"
    )
    url = sub(f"({schemed})", r"[\t\r\n]+")
    host = extract(url, r"^https?://([^/?#]*)", 1)
    out = sub(url, r"(?s)^([^#]*)#\z", r"\1", "")
    out = sub(out, r"(?s)^([^?#]*)\?(#|\z)", r"\1\2", "")
    out = sub(
        out, r"(?s)^(https?://[^/?#]+/(?:[^?#]*/)?[^/;?#]*);([?#]|\z)", r"\1\2", ""
    )
    denied = matches(raw, r"(?i)^(?:javascript|data|file|ftp):")
    return (
        f"CASE WHEN {raw} <> '' AND NOT {denied} AND {host} <> '' "
        f"AND NOT {bad_brackets(host)} THEN {out} END"
    )


def domain(expr):
    host = netloc(expr)
    return f"CASE WHEN NOT {bad_brackets(host)} THEN lower({host}) END"


def site_key(expr):
    return f"replace(nullif({domain(expr)}, ''), 'www.', '')"


def first_seen_key(expr):
    return f"split_part(rtrim({expr}, '/'), '#', 1)"


def similar_key(expr):
    bare = f"replace(rtrim(lower({expr}), '/'), 'https://', 'http://')"
    return extract(bare, r"(?s)^([^?#]*)", 1)


def word_list(words):
    return "[" + ", ".join(text(w) for w in words) + "]"


def score_columns(url, base):
    """'score' and 'reason' select items over a table that has a column p (path)."""
    valuable = word_list(dims.words_of(dims.VALUABLE_PATHS))
    excluded = word_list(dims.words_of(dims.EXCLUDED_PATHS))
    word = f"list_filter({valuable}, lambda w: contains(p, w))[1]"
    bad = f"list_filter({excluded}, lambda w: contains(p, w))"
    high_why = "CASE " + " ".join(
        f"WHEN {matches('p', r)} THEN {text(why)}" for r, _, why in dims.HIGH_VALUE_PATTERNS
    ) + " END"
    high = "CASE " + " ".join(
        f"WHEN {matches('p', r)} THEN {n}" for r, n, _ in dims.HIGH_VALUE_PATTERNS
    ) + " ELSE 0 END"
    low_why = ", ".join(
        f"CASE WHEN {matches('p', r)} THEN {text(why)} END"
        for r, _, why in dims.LOW_VALUE_PATTERNS
    )
    low = " + ".join(
        f"CASE WHEN {matches('p', r)} THEN {n} ELSE 0 END"
        for r, n, _ in dims.LOW_VALUE_PATTERNS
    )
    depth = "length(p) - length(replace(p, '/', ''))"
    home = f"p IN ({', '.join(text(x) for x in dims.HOMEPAGE_PATHS)})"
    foreign = f"NOT coalesce({site_key(url)} = {site_key(base)}, false)"
    score = (
        f"CASE WHEN {word} IS NOT NULL THEN 10 ELSE 0 END - 10 * len({bad}) + {high} + {low} "
        f"+ CASE WHEN {depth} > 4 THEN -2 WHEN {depth} <= 2 THEN 2 ELSE 0 END "
        f"+ CASE WHEN length({url}) > 150 THEN -3 WHEN length({url}) < 50 THEN 1 ELSE 0 END "
        f"+ CASE WHEN {home} THEN 5 ELSE 0 END"
    )
    reasons = (
        f"list_filter(list_concat(['contains_' || {word}], "
        f"list_transform({bad}, lambda w: 'excluded_' || w), [{high_why}], [{low_why}], "
        f"[CASE WHEN {depth} > 4 THEN 'deep_url' WHEN {depth} <= 2 THEN 'shallow_url' END, "
        f"CASE WHEN length({url}) > 150 THEN 'very_long_url' WHEN length({url}) < 50 "
        f"THEN 'short_url' END, CASE WHEN {home} THEN 'homepage' END]), "
        f"lambda r: r IS NOT NULL)"
    )
    return (
        f"CASE WHEN {foreign} THEN -100 ELSE {score} END::BIGINT AS score, "
        f"CASE WHEN {foreign} THEN 'different_domain' WHEN len({reasons}) = 0 "
        f"THEN 'no_special_markers' ELSE array_to_string({reasons}, ', ') END AS reason"
    )


def drop_code(expr):
    out = sub(expr, r"(?is)<script[^>]*>.*?</script>")
    return sub(out, r"(?is)<style[^>]*>.*?</style>")


def link_targets(expr):
    anchor = r"(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>.*?</a>"
    return extract_all(drop_code(expr), anchor, 1)


def resolve(page, link):
    folder = sub(path(page), r"[^/]*\z", "", "")
    folder = f"CASE WHEN {folder} = '' THEN '/' ELSE {folder} END"
    scheme = extract(origin(page), "^([a-z]+:)", 1)
    return (
        f"CASE WHEN {matches(link, '^' + SCHEME)} THEN {link} "
        f"WHEN starts_with({link}, '//') THEN {scheme} || {link} "
        f"WHEN starts_with({link}, '/') THEN {origin(page)} || {link} "
        f"WHEN {link} = '' THEN {page} "
        f"WHEN {matches(link, '^[#?]')} THEN {origin(page)} || {path(page)} || {link} "
        f"ELSE {origin(page)} || ({folder}) || {link} END"
    )


# entities that the test pages and the literal rows use
ENTITIES = {
    "amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "copy;": "©", "copy": "©",
    "middot;": "·", "nbsp;": "\xa0", "euro;": "€", "hellip;": "…", "eacute;": "é",
}


def unescape(expr):
    body = extract("x", r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
    cases = " ".join(
        f"WHEN b = {text(name)} THEN {text(out)} || substr(x, length(b) + 1)"
        for name, out in ENTITIES.items()
    )
    numeric = (
        f"WHEN {matches('b', '^#[0-9]+')} THEN "
        f"chr({extract('b', '[0-9]+')}::INT) || substr(x, length(b) + 1) "
        f"WHEN {matches('b', '^#[xX]')} THEN "
        f"chr(('0x' || {extract('b', '^#[xX]([0-9a-fA-F]+)', 1)})::INT) || substr(x, length(b) + 1)"
    )
    piece = f"CASE {cases} {numeric} ELSE '&' || x END".replace("b = ", f"{body} = ")
    piece = piece.replace("length(b)", f"length({body})").replace(
        "regexp_matches(b,", f"regexp_matches({body},"
    ).replace("regexp_extract(b,", f"regexp_extract({body},")
    return (
        f"array_to_string(list_transform(string_split({expr}, '&'), "
        f"lambda x, i: CASE WHEN i = 1 THEN x ELSE {piece} END), '')"
    )


def finish_html(expr):
    out = unescape(sub(expr, r"<[^>]+>"))
    out = sub(out, rf"\n[{WS}]*\n[{WS}]*\n", "\n\n")
    return strip(sub(out, " +", " "))


def html_to_markdown(expr):
    out = drop_code(expr)
    for pattern, replacement in [
        (r"<h1[^>]*>(.*?)</h1>", "# \\1\n"),
        (r"<h2[^>]*>(.*?)</h2>", "## \\1\n"),
        (r"<h3[^>]*>(.*?)</h3>", "### \\1\n"),
        (r"<h[4-6][^>]*>(.*?)</h[4-6]>", "#### \\1\n"),
        (r"<p[^>]*>(.*?)</p>", "\\1\n\n"),
        (r"<br[^>]*>", "\n"),
        (r"<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[\\2](\\1)"),
    ]:
        out = sub(out, "(?is)" + pattern, replacement)
    return finish_html(out)


def html_to_text(expr):
    out = drop_code(expr)
    for pattern in (r"<br[^>]*>", r"<p[^>]*>", r"</p>"):
        out = sub(out, "(?is)" + pattern, "\n")
    return finish_html(out)


def clean_text(expr):
    return strip(sub(sub(expr, rf"[{WS}]+", " "), r"[\x00-\x1f\x{7f}-\x{9f}]"))


def clean_markdown(expr):
    out = sub(expr, r"\n{3,}", "\n\n")
    out = sub(out, r" {2,}", " ")
    out = sub(out, r"\[([^\]]+)\]\(\)", r"\1")
    out = sub(out, rf"(?m)^#{{1,6}}[{WS}]*$")
    out = sub(out, r"(---+\n){2,}", "---\n")
    out = sub(out, rf"(?m)^[*\-][{WS}]*$")
    line = sub("x", rf"[{WS_LINE}]+\z", "", "")
    out = (
        f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: {line}), chr(10))"
    )
    return strip(out)


def truncate(expr, limit, suffix="..."):
    return (
        f"CASE WHEN length({expr}) <= {limit} THEN {expr} "
        f"ELSE left({expr}, {limit - len(suffix)}) || {text(suffix)} END"
    )


def rounded(expr, digits):
    """To ``digits`` decimals by the exact value of the double, in 128-bit integers."""
    power, one = 10**digits, f"{2**60}::HUGEINT"
    part = f"(((({expr}) - floor({expr})) * pow(2, 60))::HUGEINT * {power})"
    up = f"({part} % {one} > {one} // 2 OR ({part} % {one} = {one} // 2 AND ({part} // {one}) % 2 = 1))"
    return f"((floor({expr})::HUGEINT * {power} + {part} // {one} + {up}::INT)::DOUBLE / {power})"


def percent(part, whole):
    share = rounded(f"{part}::DOUBLE / {whole}::DOUBLE * 100", 1)
    return f"CASE WHEN {whole} > 0 THEN {share} ELSE 0.0 END"


CATALOG = (
    "(VALUES " + values(dims.ERROR_CATALOG) + ") AS c(code, message, category, action, severity)"
)
ACTIONS = (
    "(VALUES " + values(dims.ACTION_GUIDANCE) + ") AS a(action, title, guidance, url)"
)
SEVERITIES = "(VALUES " + values(dims.SEVERITIES) + ") AS s(severity, priority, description)"


def error_text(code):
    return (
        f"coalesce((SELECT c.message || ' ' || a.guidance || '.' FROM {CATALOG} "
        f"JOIN {ACTIONS} ON a.action = c.action WHERE c.code = {code}), "
        f"'Unknown error: ' || {code})"
    )


def capitalised(expr, limit):
    runs = extract_all(f"coalesce({expr}, '')", "[a-zA-Z]+")
    return (
        f"left(array_to_string(list_transform({runs}, "
        f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ''), {limit})"
    )
