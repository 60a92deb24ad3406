"""String cleaning, URL and label expressions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsluice.functions import vocab

BLANKS = " \t\n\r\x0b\x0c\x85 "
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_TOKEN = JSON_STRING + r"(?:\s*:)?|true|[\[\]{}]"
# The first group is empty for the keys of objects.
JSON_VALUE = rf"({JSON_STRING}(?!\s*:)|true)|{JSON_STRING}"
MAX_NESTING = 4


@F.pandas_udf(T.StringType())
def _decode(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else html.unescape(s))


@F.pandas_udf(T.StringType())
def _decode_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else html.unescape(html.unescape(s)))


def unescape_html(text: Column, twice: bool = False) -> Column:
    """HTML entities decoded; the engine has no built-in for the entity table.

    Only values with an ``&`` leave the JVM.
    """
    encoded = F.when(text.contains("&"), text)
    return F.coalesce((_decode_twice if twice else _decode)(encoded), text)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def clean_str(col: Column) -> Column:
    """A string with no surrounding blanks; null becomes empty."""
    return F.coalesce(strip(col), F.lit(""))


def clean_list(items: Column) -> Column:
    """The non-empty items of an array of strings, joined by commas."""
    return F.coalesce(
        F.array_join(F.transform(F.filter(items, lambda x: x != ""), strip), ", "), F.lit(""))


def first_label(record: Column, keys: list[str] = vocab.LABEL_KEYS) -> Column:
    """The first non-empty of a record's label-like fields; fields it lacks are skipped."""
    return F.coalesce(*[F.nullif(strip(record[key]), F.lit("")) for key in keys], F.lit(""))


def join_distinct(*parts: Column) -> Column:
    """Distinct non-empty parts in first-seen order, joined by commas."""
    return join_distinct_array(F.array(*parts))


def join_distinct_array(parts: Column) -> Column:
    cleaned = F.transform(parts, clean_str)
    return F.coalesce(
        F.array_join(F.array_distinct(F.filter(cleaned, lambda x: x != "")), ", "), F.lit(""))


def collapse(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def flatten_json(text: Column, enclosing: int = 0) -> Column:
    """Every string inside a JSON fragment, in document order.

    ``true`` reads as "remote"; numbers, null and false say nothing. Strings
    under more than four containers are left out. ``enclosing`` is how many
    outer brackets the caller added around the fragment.
    """
    limit = MAX_NESTING + enclosing
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    none = F.array().cast("array<string>")

    def change(token: Column) -> Column:
        return (F.when(token.isin("[", "{"), 1).when(token.isin("]", "}"), -1).otherwise(0))

    def is_value(token: Column) -> Column:
        return ~token.isin("[", "{", "]", "}") & ~token.endswith(":")

    def step(acc: Column, token: Column) -> Column:
        kept = is_value(token) & (acc["depth"] <= limit)
        out = F.when(kept, F.concat(acc["out"], F.array(token))).otherwise(acc["out"])
        return F.struct((acc["depth"] + change(token)).alias("depth"), out.alias("out"))

    def is_flat(json: Column) -> Column:
        """Not nested deeper than the limit: so few brackets open, or so many rounds close all."""
        brackets = F.regexp_replace(json, JSON_STRING + r'|[^\[\]{}"]++', "")
        for _ in range(limit):
            brackets = F.regexp_replace(brackets, r"\[\]|\{\}", "")
        return ~json.rlike(r"(?:[\[{][^\[{]*+){%d}" % (limit + 1)) | (brackets == "")

    def literals(json: Column) -> Column:
        # Hardly a record is nested deeper than the limit; others are read token by token.
        return F.when(is_flat(json), F.array_remove(
            F.regexp_extract_all(json, F.lit(JSON_VALUE), F.lit(1)), "")).otherwise(
            F.aggregate(F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0)), start, step,
                        lambda acc: acc["out"]))

    def decoded(json: Column, found: Column) -> Column:
        quoted = F.array_join(found, "")
        said = F.transform(found, lambda x: F.when(x == "true", F.lit('"remote"')).otherwise(x))
        return (
            F.when(F.size(found) == 0, none)
            # With nothing escaped, the strings stand between the quotes as they are.
            .when(~json.contains("\\") & ~F.array_contains(found, "true"), F.split(
                F.substring(quoted, F.lit(2), F.length(quoted) - 2), '""'))
            .otherwise(F.from_json(
                F.concat(F.lit("["), F.array_join(said, ","), F.lit("]")), "array<string>")))

    return F.coalesce(let(text, lambda json: F.when(json != "{}", let(
        literals(json), lambda found: decoded(json, found)))), none)


def _said(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def location_blob(location: Column, loc_extra: Column, country: Column,
                  employment_type: Column) -> Column:
    """Every field that may carry a place, as one text."""
    return F.concat_ws(" | ", _said(location), F.array_remove(loc_extra, ""), _said(country),
                       _said(employment_type))


def cycle_blob(cycle_extra: Column, employment_type: Column) -> Column:
    """Every field outside the title that may carry a work term, as one text."""
    return F.concat_ws(" | ", F.array_remove(cycle_extra, ""), _said(employment_type))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def html_to_text(text: Column, max_chars: int | None = None) -> Column:
    """Visible text of an HTML fragment whose entities may be encoded twice."""
    decoded = unescape_html(clean_str(text), twice=True)
    no_code = F.regexp_replace(decoded, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    plain = collapse(strip_tags(no_code))
    return plain if max_chars is None else F.substring(plain, 1, max_chars)


# --- URLs ----------------------------------------------------------------------

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_HOSTNAME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOSTNAME, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def bare_host(url: Column) -> Column:
    return without_www(authority(url))


def on_domain(host: Column, domains: list[str]) -> Column:
    """Is the host one of the domains or below one of them?"""
    escaped = "|".join(d.replace(".", r"\.") for d in domains)
    return host.rlike(rf"^(?:.*\.)?(?:{escaped})$")


def is_short_link(url: Column) -> Column:
    return on_domain(bare_host(url), vocab.SHORTENER_HOSTS)


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` resolved against the page it was found on."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*/)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    rooted = F.when(href.startswith("/"), href).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href))
    return (
        F.when(href.isNull() | (href == ""), base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, _without_dots(rooted)))
    )


def _without_dots(target: Column) -> Column:
    """A rooted path with its ``.`` and ``..`` segments resolved."""
    tail = F.regexp_extract(target, r"([?#].*)$", 1)
    parts = F.split(F.regexp_extract(target, r"^/([^?#]*)", 1), "/")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (F.when(part == "..", up).when(part == ".", acc)
                .otherwise(F.concat(acc, F.array(part))))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    slash = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/"))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.coalesce(slash, F.lit("")), tail)
    return F.when(target.rlike(r"/\.\.?(?:[/?#]|$)"), resolved).otherwise(target)


def safe_url(url: Column) -> Column:
    """The link if it is http(s) with no control characters, else empty."""
    link = clean_str(url)
    return F.when(
        link.rlike(r"(?i)^https?://") & ~link.rlike(r"[\r\n\t\x00]"), link).otherwise("")


def company_name_guess(url: Column, page_html: Column) -> Column:
    """A display name from the page title, else from its host."""
    title = collapse(unescape_html(
        F.regexp_replace(F.regexp_extract(page_html, vocab.TITLE_TAG, 1), r"<[^>]+>", "")))
    parts = F.transform(F.split(title, r"[|\-–—:]"), strip)
    named = F.filter(parts, lambda p: F.length(p).between(2, 39)
                     & ~p.rlike(vocab.GENERIC_PAGE_TITLE))
    host = F.regexp_replace(
        F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1), r"www\.", "")
    label = F.initcap(F.regexp_replace(F.split_part(host, F.lit("."), F.lit(1)), "-", " "))
    return F.coalesce(F.get(named, 0), label)
