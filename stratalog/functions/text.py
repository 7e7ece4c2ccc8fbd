"""Text functions. Native expressions where Spark has them, Arrow batches where it hasn't."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
_QUERY_TOKEN = re.compile(r"[\w-]+")
_FOLDED = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """The plain analyzer: lower case, runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_fp(text: Column) -> Column:
    """md5 of the lower-cased text with white space collapsed and trimmed."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " ")))


def folded_words(text: str) -> list[str]:
    """The rerank analyzer: full case folding, accents dropped, runs of letters and digits."""
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(ch) != "Mn")
    return _FOLDED.findall(plain)


def folded_tokens(text: Column) -> Column:
    """:func:`folded_words` of a column; null gives null."""

    @F.pandas_udf("array<string>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else folded_words(x))

    return of(text)


def surface_tokens(text: Column) -> Column:
    """Compatibility-normalised, case-folded words."""

    @F.pandas_udf("array<string>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.findall(r"\w+", unicodedata.normalize("NFKC", x).casefold()))

    return of(text)


def query_units(query: str) -> list[list[str]]:
    """The units of a query: a token with a hyphen or underscore is a phrase of its parts; one without letters or digits is an empty phrase."""
    return [[w.lower() for w in re.findall(r"[^\W_]+", t)] for t in _QUERY_TOKEN.findall(query)]


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; two empty ones are equal."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def guarded(text: Column, most: int, halvings: int = 12) -> Column:
    """The text, or as much of its beginning, halved as often as needed, as has distinct words of at most ``most`` bytes together; '' if ``halvings`` don't do."""
    out = None
    for k in range(halvings + 1):
        part = F.left(text, F.floor(F.length(text) / 2**k).cast("int")) if k else text
        size = F.aggregate(F.array_distinct(tokens(part)), F.lit(0), lambda n, w: n + F.octet_length(w))
        out = F.when(size <= most, part) if out is None else out.when(size <= most, part)
    return out.otherwise("")


def slug(text: Column) -> Column:
    """A name that is safe as a file name."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def iso_epoch(text: Column) -> Column:
    """Seconds since the epoch of an ISO-8601 time that names its offset; null otherwise."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def utc_day(text: Column) -> Column:
    """The UTC day of an ISO-8601 time with any offset; null where it isn't one."""
    return F.to_date(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()))


def finite(value: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


class _Reader(HTMLParser):
    BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "dt", "dd", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
    SKIP = {"script", "style", "head", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.kept = self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag == "br" or tag in self.BLOCK:
            self.parts.append("\n")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag == "pre":
            self.kept += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BLOCK:
            self.parts.append("\n")
        if tag == "pre":
            self.kept = max(0, self.kept - 1)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data if self.kept else re.sub(r"\s+", " ", data))


def text_of_html(page: str) -> str:
    """The text of a page: blocks on lines of their own, list items with a dash, preformatted text as it is."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    out = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(reader.parts).replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def html_to_text(page: Column) -> Column:
    """:func:`text_of_html` of a column; null gives null."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else text_of_html(x))

    return of(page)


def unescaped(text: str) -> str:
    return html.unescape(text)
