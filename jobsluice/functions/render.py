"""Escaping for published rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions.clean import collapse, safe_url

# Characters and what they are written as.
LINK_CODES = [(" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"),
              ('"', "%22"), ("|", "%7C")]
MARKUP_CODES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
QUOTE_CODES = [('"', "&quot;"), ("'", "&#x27;")]
MARKDOWN_SPECIALS = r"([|\[\]*_`~#])"


def _swap(col: Column, codes: list[tuple[str, str]]) -> Column:
    for char, code in codes:
        col = F.replace(col, F.lit(char), F.lit(code))
    return col


def xml_escape(text: Column) -> Column:
    return _swap(F.coalesce(text.cast("string"), F.lit("")), MARKUP_CODES + QUOTE_CODES)


def md_escape(text: Column) -> Column:
    """Text that cannot break a markdown table row or add markup."""
    line = collapse(F.coalesce(text.cast("string"), F.lit("")))
    line = F.replace(line, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(_swap(line, MARKUP_CODES), MARKDOWN_SPECIALS, r"\\$1")


def md_url(url: Column) -> Column:
    return _swap(safe_url(url), LINK_CODES)
