"""Whitespace handling, cleaning, extraction and summaries over text columns."""

from pyspark.sql import functions as F

from sitewise.dims import SOCIAL_PLATFORMS

# Java's \s is ASCII only. This class is the Unicode whitespace set, with the
# four separator controls, written out so that it means the same in any engine.
SPACE_NO_LF = (
    r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = r"\n" + SPACE_NO_LF


def strip(col):
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]++\z", "")


def non_blank(col):
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def clean_text(col):
    """Whitespace runs to one space, control characters out, ends stripped.

    A lone space is left alone, and after the first step spaces are the only blanks.
    """
    other = SPACE.replace(r"\x1c-\x20", r"\x1c-\x1f")
    one_line = F.regexp_replace(col, rf"[{other}][{SPACE}]*|\x20[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(one_line, r"[\x00-\x1f\x{7f}-\x{9f}]", ""))


def clean_markdown(col):
    """Tidy markdown: blank runs, empty links, headers, rules and bullets."""
    text = F.regexp_replace(col, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r" {2,}", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\(\)", "$1")
    text = F.regexp_replace(text, rf"(?md)^#{{1,6}}[{SPACE}]*$", "")
    # possessive: the group loop stays iterative on long runs of rules
    text = F.regexp_replace(text, r"(?:---+\n){2,}+", "---\n")
    text = F.regexp_replace(text, rf"(?md)^[*\-][{SPACE}]*$", "")
    text = F.regexp_replace(
        text, rf"(?<![{SPACE_NO_LF}])[{SPACE_NO_LF}]++(?=\n|\z)", ""
    )
    return strip(text)


def truncate(col, limit=1000, suffix="..."):
    """Text of at most ``limit`` characters, the suffix included."""
    cut = F.concat(F.left(col, F.lit(limit - len(suffix))), F.lit(suffix))
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def _find_all(col, pattern, group=0):
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def emails(col):
    """Distinct e-mail addresses, sorted."""
    pattern = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
    return F.array_sort(F.array_distinct(_find_all(col, pattern)))


def phone_numbers(col):
    """Distinct phone numbers in the compact US form, sorted."""
    pattern = r"(?U)\b(?:\+?1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b"
    return F.array_sort(F.array_distinct(_find_all(col, pattern)))


def social_links(col):
    """Array of (platform, url), platform by platform, duplicates kept."""
    tail = rf"[^{SPACE}<>\"{{}}|\\^`\[\]]+"
    found = []
    for platform in SOCIAL_PLATFORMS:
        pattern = rf"(?iu)(?:https?://)?(?:www\.)?{platform}\.com/{tail}"
        found.append(F.transform(_find_all(col, pattern), _named(platform)))
    return F.concat(*found)


def _named(platform):
    return lambda url: F.struct(F.lit(platform).alias("platform"), url.alias("url"))


def key_sections(col, limit=10):
    """First header texts of level one to three."""
    headers = _find_all(col, rf"(?md)^#{{1,3}}[{SPACE}]+(.+)$", 1)
    return F.slice(headers, 1, limit)


def company_descriptions(col, limit=3):
    """First company description phrases, or null when there is none."""
    found = F.concat(
        _find_all(col, rf"(?iu)(?:We are|Our company is|We're)[{SPACE}]+([^.]+\.)", 1),
        _find_all(col, rf"(?iu)(?:Our mission is|Mission:)[{SPACE}]+([^.]+\.)", 1),
        _find_all(
            col, rf"(?iu)(?:Founded in|Established in)[{SPACE}]+(\p{{Nd}}{{4}}[^.]*\.)", 1
        ),
    )
    return F.when(F.size(found) > 0, F.slice(found, 1, limit))


def key_information(content, url):
    """All extracted fields of one page as a struct."""
    text = F.coalesce(content, F.lit(""))
    return F.struct(
        url.alias("url"),
        emails(text).alias("emails"),
        phone_numbers(text).alias("phone_numbers"),
        social_links(text).alias("social_links"),
        key_sections(text).alias("key_sections"),
        company_descriptions(text).alias("company_descriptions"),
    )


def content_summary(col, limit=500):
    """First substantial line after the first header mark, else the opening text."""
    after_mark = F.substring(col, F.locate("#", col) + 1, F.length(col))
    lines = F.transform(F.split(after_mark, r"[#\n]", -1), strip)
    substantial = F.get(F.filter(lines, lambda line: F.length(line) > 50), F.lit(0))
    opening = F.regexp_replace(col, r"^[#*\- \n]+", "")
    return (
        F.when(F.coalesce(col, F.lit("")) == "", F.lit("No content available"))
        .when(
            col.contains("#") & substantial.isNotNull(), truncate(substantial, limit)
        )
        .otherwise(truncate(opening, limit))
    )


def capitalised_letters(col, limit=15):
    """ASCII letter runs, each capitalised, joined and cut: safe in a file name."""
    runs = _find_all(F.coalesce(col, F.lit("")), r"[a-zA-Z]+")
    words = F.transform(
        runs,
        lambda w: F.concat(
            F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))
        ),
    )
    return F.left(F.array_join(words, ""), F.lit(limit))


def format_bytes(col):
    """Human readable size with two decimals, B to PB."""
    value = col.cast("double")
    out = None
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        scaled = value / float(1024**power)
        shown = F.format_string(f"%.2f {unit}", F.bround(scaled, 2))
        small = scaled < 1024.0
        out = F.when(small, shown) if out is None else out.when(small, shown)
    top = F.format_string("%.2f PB", F.bround(value / float(1024**5), 2))
    return F.when(value.isNotNull(), out.otherwise(top))
