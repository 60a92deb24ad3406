"""Boards that answer HTML or XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.functions.clean import (
    absolute_url, authority, clean_str, collapse, join_distinct, join_distinct_array, strip,
    strip_tags, unescape_html)
from jobsluice.functions.dates import clock_date, short_date
from jobsluice.sources.base import listing, merge_pages, source

# The markup each template puts around a posting.
ICIMS_CARD = r'(?s)<li class="iCIMS_JobCardItem">(.*?)</li>'
ICIMS_LINK = (r'(?s)<a href="([^"]*/jobs/(\d+)/[^"]*)"[^>]*class="iCIMS_Anchor"[^>]*>.*?'
              r'<h3[^>]*>(.*?)</h3>')
ICIMS_PLACE = r'(?s)field-label">(?:Job )?Locations?</span>\s*<span[^>]*>(.*?)</span>'
ICIMS_MORE = r'(?s)Additional Locations</span>.*?<dd[^>]*><span[^>]*>(.*?)</span>'
ICIMS_DATE = r'(?s)Posted Date</(?:dt|span)>\s*(?:<dd[^>]*>)?\s*<span title="([^"]+)"'
ICIMS_COUNTRIES = {"CA": "Canada", "US": "United States", "UK": "UK", "GB": "UK", "IN": "India",
                   "DE": "Germany", "FR": "France", "IE": "Ireland"}
SF_ROW = r'(?s)(?:<tr class="data-row".*?</tr>|<li class="job-tile.*?</li>)'
SF_LINK = r'(?s)<a[^>]*href="([^"]*/job/[^"]*?/(\d+)/?)"[^>]*>(.*?)</a>'
SF_LINK_TILE = r'(?s)<a[^>]*class="jobTitle-link"[^>]*href="([^"]*/(\d+)/?)"[^>]*>(.*?)</a>'
SF_PLACE = r'<span class="jobLocation">\s*([^<]*?)\s*</span>'
SF_PLACE_TILE = r'-section-location-value">\s*([^<]*?)\s*</div>'
SF_DATE = r'class="jobDate[^"]*">\s*([A-Z][a-z]{2,8}\.? \d{1,2}, \d{4})'
SF_SLUG = r"/job/([^/]+)/\d+"
SF_PROVINCE = r"-([A-Z]{2})(?:-[A-Z0-9]{3}-?[A-Z0-9]{3})?$"
JAZZ_ITEM = (r'(?s)<li class="list-group-item">(.*?)</li>\s*'
             r'(?=<li class="list-group-item">|</ul>)')
JAZZ_LINK = r'(?s)<a href="([^"]*/apply/([A-Za-z0-9]+)/[^"]*)"[^>]*>(.*?)</a>'
JAZZ_PLACE = r"""fa-map-marker'?"?></i>\s*([^<]+)"""
PERSONIO_ROW = "position array<struct<id:string,name:string,office:string,employmentType:string>>"


def _blocks(landed: DataFrame, pattern: str, group: int) -> DataFrame:
    found = F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(group))
    return landed.select(*[c for c in landed.columns if c != "body"],
                         F.posexplode(found).alias("pos", "block"))


def _part(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract("block", pattern, group)


def icims_place(code: Column) -> Column:
    """``CA-ON-Ottawa`` as ``Ottawa, ON, Canada``."""
    parts = F.transform(F.split(strip(code), "-", 3), strip)
    country = F.lit(None).cast("string")
    for key, name in ICIMS_COUNTRIES.items():
        country = F.when(F.upper(F.get(parts, 0)) == key, name).otherwise(country)
    rest = F.reverse(F.slice(parts, 2, 2))
    return F.when((F.size(parts) < 2) | country.isNull(), strip(code)).otherwise(
        F.array_join(F.concat(rest, F.array(country)), ", "))


@source("icims")
def icims(landed: DataFrame, as_of: int | Column) -> DataFrame:
    cards = _blocks(landed, ICIMS_CARD, 1).where(F.col("block").rlike(ICIMS_LINK))
    cards = cards.withColumns({
        "_href": unescape_html(_part(ICIMS_LINK)),
        "_name": unescape_html(F.regexp_replace(_part(ICIMS_LINK, 3), r"<[^>]+>", "")),
        # One pass through the entity decoder; bars separate the places.
        "_spots": unescape_html(F.concat_ws("|", _part(ICIMS_PLACE), _part(ICIMS_MORE))),
    })
    host = authority(F.regexp_replace(F.col("token"), "/+$", ""))
    spots = F.filter(F.split("_spots", r"\|"), lambda s: strip(s) != "")
    rows = listing(
        cards,
        title=collapse(F.col("_name")),
        location=join_distinct_array(F.transform(spots, icims_place)),
        url=F.regexp_replace("_href", r"[?&]in_iframe=1", ""),
        uid=F.concat(F.lit("icims:"), host, F.lit(":"), _part(ICIMS_LINK, 2)),
        posted_at=clock_date(_part(ICIMS_DATE)))
    return merge_pages(rows)


def slug_place(path: Column) -> Column:
    """City and province of a ``/job/City-Title-ON-POSTAL/id/`` path."""
    slug = F.try_url_decode(F.replace(F.regexp_extract(path, SF_SLUG, 1), F.lit("+"),
                                      F.lit("%2B")))
    return join_distinct(F.split_part(slug, F.lit("-"), F.lit(1)),
                         F.regexp_extract(slug, SF_PROVINCE, 1))


@source("successfactors")
def successfactors(landed: DataFrame, as_of: int | Column) -> DataFrame:
    rows = _blocks(landed, SF_ROW, 0)
    tile = ~F.col("block").rlike(SF_LINK)

    def link(group: int) -> Column:
        return F.when(tile, _part(SF_LINK_TILE, group)).otherwise(_part(SF_LINK, group))

    spot = F.coalesce(F.nullif(_part(SF_PLACE), F.lit("")), _part(SF_PLACE_TILE))
    rows = rows.where(link(2) != "").withColumns({
        "_path": unescape_html(link(1)),
        "_name": unescape_html(strip_tags(link(3))),
        "_spot": unescape_html(spot),
    })
    site = F.regexp_extract("token", r"^([A-Za-z]+://[^/?#]*)", 1)
    place = F.coalesce(F.nullif(collapse(F.col("_spot")), F.lit("")), slug_place(link(1)))
    found = listing(
        rows,
        title=collapse(F.col("_name")),
        location=clean_str(place),
        url=absolute_url(F.concat(site, F.lit("/")), F.col("_path")),
        uid=F.concat(F.lit("successfactors:"),
                     F.regexp_extract("token", r"^[A-Za-z]+://([^/?#]*)", 1),
                     F.lit(":"), link(2)),
        posted_at=short_date(_part(SF_DATE)))
    return merge_pages(found)


@source("jazzhr")
def jazzhr(landed: DataFrame, as_of: int | Column) -> DataFrame:
    rows = _blocks(landed, JAZZ_ITEM, 1).where(F.col("block").rlike(JAZZ_LINK)).withColumns({
        "_href": unescape_html(_part(JAZZ_LINK)),
        "_name": unescape_html(strip_tags(_part(JAZZ_LINK, 3))),
        "_spot": unescape_html(_part(JAZZ_PLACE)),
    })
    return listing(
        rows,
        title=collapse(F.col("_name")),
        location=collapse(F.col("_spot")),
        url=F.col("_href"),
        uid=F.concat(F.lit("jazzhr:"), F.col("token"), F.lit(":"), _part(JAZZ_LINK, 2)))


@source("personio")
def personio(landed: DataFrame, as_of: int | Column) -> DataFrame:
    found = F.from_xml(F.col("body"), f"struct<{PERSONIO_ROW.replace(' ', ':', 1)}>")["position"]
    rows = landed.select(*[c for c in landed.columns if c != "body"],
                         F.posexplode(found).alias("pos", "job"))
    token, jid = F.col("token"), clean_str(F.col("job.id"))
    return listing(
        rows,
        title=clean_str(F.col("job.name")),
        location=join_distinct(F.col("job.office"), F.col("job.employmentType")),
        url=F.concat(F.lit("https://"), token, F.lit(".jobs.personio.de/job/"), jid),
        uid=F.concat(F.lit("personio:"), token, F.lit(":"), jid),
        employment_type=clean_str(F.col("job.employmentType")))
