"""Web content: html to text and markdown, event streams, limits."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_BYTES = 5 << 20
_SKIPPED = frozenset(("script", "style", "meta", "link", "noscript", "template", "head"))
_BLOCKS = frozenset(("p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "table", "tr", "blockquote", "pre", "form", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr", "dl", "dt", "dd"))
_VOID = frozenset(("meta", "link", "br", "hr", "img", "input"))


class _Reader(HTMLParser):
    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.markdown = markdown
        self.hrefs: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED and tag not in _VOID:
            self.skip += 1
        if self.skip:
            return
        if tag in _BLOCKS:
            self.out.append("\n" if tag in ("li", "br", "tr", "dt", "dd") else "\n\n")
        if not self.markdown:
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href"))
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in _SKIPPED and tag not in _VOID:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if self.markdown:
            if tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("_")
            elif tag == "code":
                self.out.append("`")
            elif tag == "a" and self.hrefs:
                self.out.append(f"]({self.hrefs.pop() or ''})")
        if tag in _BLOCKS and tag not in ("br", "hr"):
            self.out.append("\n" if tag in ("li", "tr", "dt", "dd") else "\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _read(html: str | None, markdown: bool) -> str | None:
    if html is None:
        return None
    reader = _Reader(markdown)
    reader.feed(html)
    reader.close()
    lines = [" ".join(line.split()) for line in "".join(reader.out).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def _as_text(html: str | None) -> str | None:
    return _read(html, False)


def _as_markdown(html: str | None) -> str | None:
    return _read(html, True)


# Row by row, not over Arrow: a worker then holds some rows, and not as many pages and results as an Arrow batch has rows.
def html_to_text(html: Column) -> Column:
    """Visible text by blocks; scripts, styles and the head are left out, links lose their targets."""
    return F.udf(_as_text, StringType(), useArrow=False)(html)


def html_to_markdown(html: Column) -> Column:
    return F.udf(_as_markdown, StringType(), useArrow=False)(html)


def html_words(html: Column) -> Column:
    """Visible text in one line, by SQL functions only: scripts, styles, comments and the head go, tags become spaces,
    the five basic entities are resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of links, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"<a\b[^>]*?\bhref=\"([^\"]*)\""), 1))


def first_event_text(stream: Column) -> Column:
    """Text of the first `data:` line of an event stream that has some (result.content[].text)."""
    data = F.filter(F.split(stream, "\r?\n"), lambda line: line.startswith("data:"))
    parsed = F.transform(data, lambda line: F.get(F.from_json(F.substr(line, F.lit(6)), "result struct<content:array<struct<text:string>>>")["result"]["content"]["text"], F.lit(0)))
    return F.get(F.filter(parsed, lambda t: t.isNotNull() & (t != "")), F.lit(0))


def route(mime: Column, size: Column) -> Column:
    """What is done with a fetched body: rejected when too large, image, html, text or binary."""
    kind = F.when(mime.rlike("(?i)^image/") & ~mime.rlike("(?i)svg"), "image").when(mime.rlike("(?i)html"), "html").when(mime.rlike("(?i)^text/|json|xml|javascript|svg"), "text").otherwise("binary")
    return F.when(size > MAX_BYTES, "rejected").otherwise(kind)


def between_marks(text: Column, start: str, end: str) -> Column:
    """JSON between two marks, as a variant; null if it is none."""
    quoted = lambda s: "\\Q" + s + "\\E"
    return F.try_parse_json(F.nullif(F.regexp_extract(text, "(?s)" + quoted(start) + r"\s*(.*?)\s*" + quoted(end), 1), F.lit("")))


def fenced_json(text: Column, schema: str) -> Column:
    """The first {...} of a reply, without code fences, read by a schema; null if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit("")), schema)


# What is asked for, by the wanted form.
ACCEPT = {
    "markdown": "text/markdown;q=1.0, text/x-markdown;q=0.9, text/plain;q=0.8, text/html;q=0.7, */*;q=0.1",
    "text": "text/plain;q=1.0, text/markdown;q=0.9, text/html;q=0.8, */*;q=0.1",
    "html": "text/html;q=1.0, application/xhtml+xml;q=0.9, text/plain;q=0.8, text/markdown;q=0.7, */*;q=0.1",
}


def accept_header(form: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ACCEPT.items() for x in pair)), form)
