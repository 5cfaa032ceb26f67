"""Text functions: HTML, quotes, numbers, windows, packing, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no article text, and elements that end a line.
DROPPED = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg"]
BLOCKS = ["p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    """Named references, the ampersand last."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts or navigation, a line for each block, single blanks."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" *\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(out, r"^\n+|\n+$", ""))


def element(html: Column, tag: str) -> Column:
    """The inside of the first such element, or null."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta element of that name or property, in either order of attributes."""
    one = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def json_ld(html: Column, field: str) -> Column:
    """A field of the first JSON-LD node that has it: a block itself, then all nodes of its @graph."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))

    def inside(b: Column) -> Column:
        nodes = F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))
        return F.concat(F.array(F.get_json_object(b, f"$.{field}")), F.transform(nodes, lambda n: F.get_json_object(n, f"$.{field}")))

    got = F.flatten(F.transform(blocks, inside))
    return F.try_element_at(F.filter(got, lambda x: x.isNotNull()), F.lit(1))


def article_body(html: Column, least: int = 200, most: int = 200_000) -> Column:
    """JSON-LD body if long enough, else the article element's text, else the page's; at most `most` characters."""
    ld = json_ld(html, "articleBody")
    return F.substring(F.coalesce(F.when(F.length(ld) >= least, ld), strip_html(element(html, "article")), strip_html(html)), 1, most)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; the query stays."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def public_url(url: Column) -> Column:
    """May the address be fetched: http(s), no credentials, no control characters, no private host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    a, b = F.regexp_extract(host, r"^([0-9]+)\.", 1).try_cast("int"), F.regexp_extract(host, r"^[0-9]+\.([0-9]+)\.", 1).try_cast("int")
    numeric = host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    private = numeric & (a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))
    named = (host == "localhost") | host.endswith(".localhost") | host.endswith(".internal") | host.endswith(".local") | host.startswith("[")
    ok = (F.length(url) <= 2048) & ~url.rlike(r"[\x00-\x1f\x7f]") & url.rlike(r"(?i)^https?://[^/]") & ~url.rlike(r"^[A-Za-z]+://[^/]*@")
    return ok & ~F.coalesce(private, F.lit(False)) & ~named & host.contains(".")


def number_tokens(text: Column) -> Column:
    """Numbers as written, without thousands commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def quote_at(text: Column, quote: Column, around: int = 80) -> Column:
    """struct(found, offset from 0, context) of the first place of a quote."""
    at = F.instr(text, quote) if isinstance(quote, str) else F.locate("", text) * 0 + F.position(quote, text)
    start = F.greatest(at - around, F.lit(1))
    return F.struct((at > 0).alias("found"), F.when(at > 0, at - 1).alias("offset"), F.when(at > 0, F.substring(text, start, at - start + F.length(quote) + around)).alias("context"))


def windows(text: Column, limit: int = 28_000, overlap: int = 500) -> Column:
    """Windows of `limit` characters that overlap; a last short one stands even inside the overlap."""
    stride = limit - overlap
    n = F.greatest(F.ceil(F.length(text) / stride), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * stride).alias("start"), F.substring(text, i * stride + 1, F.lit(limit)).alias("text")))


def normalised(text: Column) -> Column:
    """Lower case without white space, for keys."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def column_number(letters: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """The inverse of column_number, for up to three letters."""
    n = number - 1
    letter = lambda x: F.char(F.pmod(x, F.lit(26)) + 65)
    return F.concat(F.when(n >= 702, letter(F.floor((n - 702) / 676))).otherwise(""), F.when(n >= 26, letter(F.floor((n - 26) / 26))).otherwise(""), letter(n))
