"""HTML to markdown, HTML to text and entity decoding over string columns."""

import html.entities
import json

from pyspark.sql import functions as F

from sitewise.functions.text import SPACE, strip

_FLAGS = "(?isu)"


def _named_entities():
    """The standard HTML5 names, grouped by first letter for short lookups."""
    grouped = {}
    for name, text in html.entities.html5.items():
        grouped.setdefault(name[0], {})[name] = text
    return grouped


def _bare_names():
    """Names that are also valid without the closing semicolon, longest first."""
    bare = [n for n in html.entities.html5 if not n.endswith(";")]
    return sorted(bare, key=lambda n: (-len(n), n))


def _cp1252_controls():
    """Numbers 128..159 mean the Windows-1252 character where there is one."""
    out = {"0": "�", "13": "\r"}
    for number in range(0x80, 0xA0):
        try:
            out[str(number)] = bytes([number]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(number)] = chr(number)
    return out


_BODY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _decode_number(body):
    """Text for '#123;' or '#x7b;'."""
    is_hex = body.rlike("^#[xX]")
    digits = F.regexp_extract(body, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    padded = F.when(digits == "", "0").otherwise(digits)
    fits = F.length(padded) <= F.when(is_hex, 6).otherwise(7)
    code = F.when(
        fits,
        F.when(is_hex, F.conv(padded, 16, 10)).otherwise(F.conv(padded, 10, 10)),
    ).cast("int")
    controls = F.from_json(F.lit(json.dumps(_cp1252_controls())), "map<string,string>")
    special = F.try_element_at(controls, code.cast("string"))
    surrogate_or_beyond = (
        code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    )
    dropped = (
        code.between(0x1, 0x8)
        | code.between(0xE, 0x1F)
        | code.between(0x7F, 0x9F)
        | code.between(0xFDD0, 0xFDEF)
        | (code == 0xB)
        | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(special.isNotNull(), special)
        .when(surrogate_or_beyond, F.lit("�"))
        .when(dropped, F.lit(""))
        .otherwise(char)
    )


def unescape(col):
    """Decode HTML entities in one pass, so '&amp;lt;' becomes '&lt;'.

    The text is cut at '&'; every piece but the first begins with a possible
    reference. All of it stays built-in expressions.
    """
    names = F.from_json(
        F.lit(json.dumps(_named_entities())), "map<string,map<string,string>>"
    )
    bare_pattern = "^(" + "|".join(_bare_names()) + ")"

    def lookup(name):
        return F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name)

    def decode_piece(piece):
        body = F.regexp_extract(piece, _BODY, 1)
        rest = F.substring(piece, F.length(body) + 1, F.length(piece))
        prefix = F.regexp_extract(body, bare_pattern, 1)
        tail = F.substring(body, F.length(prefix) + 1, F.length(body))
        return (
            F.when(body == "", F.concat(F.lit("&"), piece))
            .when(body.startswith("#"), F.concat(_decode_number(body), rest))
            .when(lookup(body).isNotNull(), F.concat(lookup(body), rest))
            .when(prefix != "", F.concat(lookup(prefix), tail, rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(col, "&", -1)
    decoded = F.transform(
        pieces, lambda piece, i: F.when(i == 0, piece).otherwise(decode_piece(piece))
    )
    return F.when(col.contains("&"), F.array_join(decoded, "")).otherwise(col)


def _drop_code(col):
    col = F.regexp_replace(col, rf"{_FLAGS}<script[^>]*>.*?</script>", "")
    return F.regexp_replace(col, rf"{_FLAGS}<style[^>]*>.*?</style>", "")


def _finish(col):
    text = unescape(F.regexp_replace(col, r"<[^>]+>", ""))
    text = F.regexp_replace(text, rf"\n[{SPACE}]*\n[{SPACE}]*\n", "\n\n")
    return strip(F.regexp_replace(text, r" +", " "))


def html_to_markdown(col):
    """Headers, paragraphs, breaks and links as markdown; other tags dropped."""
    text = _drop_code(col)
    rewrites = [
        (r"<h1[^>]*>(.*?)</h1>", "# $1\n"),
        (r"<h2[^>]*>(.*?)</h2>", "## $1\n"),
        (r"<h3[^>]*>(.*?)</h3>", "### $1\n"),
        (r"<h[4-6][^>]*>(.*?)</h[4-6]>", "#### $1\n"),
        (r"<p[^>]*>(.*?)</p>", "$1\n\n"),
        (r"<br[^>]*>", "\n"),
        (r"<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"),
    ]
    for pattern, replacement in rewrites:
        text = F.regexp_replace(text, _FLAGS + pattern, replacement)
    return _finish(text)


def html_to_text(col):
    """Plain text; breaks and paragraph ends become line feeds."""
    text = _drop_code(col)
    for pattern in (r"<br[^>]*>", r"<p[^>]*>", r"</p>"):
        text = F.regexp_replace(text, _FLAGS + pattern, "\n")
    return _finish(text)


def link_targets(col):
    """Link targets of the anchors, in page order (same anchor rule as markdown)."""
    anchor = rf"{_FLAGS}<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>.*?</a>"
    return F.regexp_extract_all(_drop_code(col), F.lit(anchor), F.lit(1))
