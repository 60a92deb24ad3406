"""Queries over careers pages, sitemaps, trackers, detail records and the landing zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsluice.catalog import duck as d
from jobsluice.catalog.boards import K, joined, skey, want
from jobsluice.catalog.expressions import _entities
from jobsluice.catalog.fixtures import (
    AS_OF, DAY, TEXT, duck, fx, landed, listing_view, postings, quote, spread, table)
from jobsluice.catalog.registry import query
from jobsluice.functions import vocab
from jobsluice.session import materialise
from jobsluice.sources import details as detail_pages
from jobsluice.sources import sitemaps, trackers
from jobsluice.sources.careers import page_jsonld, page_links
from jobsluice.operators import state
from jobsluice.settings import Settings
from jobsluice.sources.landing import (
    follow_links, incremental_scan, remember_payloads, resolve_short_links)

C, L = F.col, F.lit


# --- careers pages -----------------------------------------------------------------------

def _job_page(spark, folder, *extra):
    """One page per posting, its JobPosting two levels down in a graph, listed twice."""
    node = F.struct(
        F.array(L("Thing"), L("JobPosting")).alias("@type"), "title",
        F.when(C("k") % 2 == 0, C("url")).alias("url"),
        F.when(C("k") % 3 != 0, F.struct(C("k").alias("value"))).alias("identifier"),
        F.struct(C("company").alias("name")).alias("hiringOrganization"),
        C("employment_type").alias("employmentType"), C("day").alias("datePosted"),
        F.array(F.struct(F.struct(
            C("location").alias("addressLocality"),
            F.struct(L("Canada").alias("name")).alias("addressCountry")).alias("address")))
        .alias("jobLocation"),
        F.when(C("k") % 4 == 0, "telecommute").alias("jobLocationType"),
        F.when(C("k") % 4 == 0, F.struct(C("nation").alias("name")))
        .alias("applicantLocationRequirements"),
        F.concat(L("<p>"), "title", L(" &amp; more</p>")).alias("description"))
    item = F.struct(F.struct(node.alias("item")).alias("itemListElement"))
    doc = F.to_json(F.struct(F.array(item, item).alias("@graph")))
    html = F.concat(L('<html><title>x</title><script type="application/ld+json">'), doc,
                    L("</script><script type='application/ld+json'>{broken</script>"),
                    L("""<script type="application/ld+json">{"@type":"JobPosting","x":NaN}"""),
                    L("</script></html>"))
    return fx(spark, folder).select(
        C("source"), "company", "k", skey("https://careers.acme.com/p/").alias("url"),
        L(AS_OF).alias("fetched_at"), html.alias("html"), *extra)


JOB_PLACE = joined(joined("location", "'Canada'"),
                   "case when k % 4 = 0 then 'Remote' else '' end",
                   "case when k % 4 = 0 then nation else '' end")
JOB_LINK = (f"case when k % 2 = 0 then url else concat('https://careers.acme.com/p/', {K}) end")


@query("page_jsonld", want(
    "html", company="company", source="source",
    uid=f"concat('html:', company, ':', case when k % 3 <> 0 then {K} else "
        f"concat({JOB_LINK}, '#', title) end)",
    location=JOB_PLACE, url=JOB_LINK, posted_at="ts", employment_type="employment_type"))
def page_jsonld_query(spark, folder):
    return listing_view(page_jsonld(_job_page(spark, folder), AS_OF))


_HREF = "case when a[1] like '/%' then concat(root, trim(a[1])) else a[1] end"
_LABEL = "trim(regexp_replace(regexp_replace(" + _entities("a[2]") + \
    ", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("page_links", f"""
    with anchors as (select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root,
        unnest(list_zip(regexp_extract_all(html, {quote(vocab.ANCHOR)}, 1),
          regexp_extract_all(html, {quote(vocab.ANCHOR)}, 2))) as a from pages),
      links as (select page_id, {_HREF} as link, {_LABEL} as label from anchors)
    select concat('html:host:', link) as uid, label as title, link as url,
      cast(page_id as bigint) as page_id
    from links where label <> '' and length(label) <= 200
      and not regexp_matches(label, {quote(vocab.NAV_LABEL)})
    group by page_id, link, label""")
def page_links_query(spark, folder):
    pages = spread(table(spark, folder, "pages"), "page_id").select(
        C("page_id").cast("string").alias("source"), L("host").alias("company"), "url",
        L(AS_OF).alias("fetched_at"), "html")
    return page_links(pages).select("uid", "title", "url",
                                    C("source").cast("bigint").alias("page_id"))


# --- sitemaps ------------------------------------------------------------------------------

FILE_OF = "cast(k // 50 as int)"
ROOT = f"concat('https://careers.s', cast(k // 750 as {TEXT}), '.com/sitemap.xml')"
JOB = f"concat('https://careers.acme.com/', case k % 3 when 0 then 'blog/' else 'jobs/' end, {K})"


def _sitemap_files(spark, folder):
    """Sitemaps of 50 entries; every index names 15 of them and one that is not for jobs."""
    rows = fx(spark, folder)
    file = F.floor(C("k") / 50)
    root = F.concat(L("https://careers.s"), F.floor(C("k") / 750).cast("string"),
                    L(".com/sitemap.xml"))
    child = F.concat(L("https://careers.s"), F.floor(C("k") / 750).cast("string"),
                     L(".com/jobs-"), file.cast("string"), L(".xml"))
    loc = F.concat(L("https://careers.acme.com/"),
                   F.when(C("k") % 3 == 0, "blog/").otherwise("jobs/"), C("k").cast("string"))
    entry = F.concat(L("<url><loc> "), loc, L("</loc><lastmod>"),
                     (L(AS_OF) - C("k") % 40 * DAY).cast("string"), L("</lastmod></url>"))
    head = '<?xml version="1.0"?><{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    children = rows.groupBy(root.alias("sitemap_url"), child.alias("url")).agg(
        F.concat(L(head.format("urlset")), F.array_join(F.array_sort(F.collect_list(entry)), ""),
                 L("</urlset>")).alias("body"))
    index = children.groupBy("sitemap_url").agg(F.concat(
        L(head.format("sitemapindex")), L("<sitemap><loc>https://x.com/news.xml</loc></sitemap>"),
        F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(
            L("<sitemap><loc>"), u, L("</loc></sitemap>"))), ""), L("</sitemapindex>"))
        .alias("body")).withColumn("url", C("sitemap_url"))
    return children.unionByName(index).select(
        C("sitemap_url").alias("source"), L("Acme").alias("company"), "sitemap_url",
        L(AS_OF).cast("bigint").alias("fetched_at"), L(None).cast("string").alias("pattern"), "url", "body")


RECENT = f"(select *, {ROOT} as root, {JOB} as loc, {AS_OF} - k % 40 * {DAY} as modified from fx)"
TOP = f"""select * from {RECENT} r
    where k % 3 <> 0 and modified >= {AS_OF - 21 * DAY}"""


@query("sitemap_entries", duck(f"""
    select root as sitemap_url, loc, cast(modified as bigint) as modified from ({TOP}) t"""))
def sitemap_entries(spark, folder):
    return sitemaps.sitemap_entries(_sitemap_files(spark, folder), AS_OF).select(
        "sitemap_url", "loc", "modified")


@query("sitemap_postings", duck(f"""
    select concat('sitemap:careers.acme.com:/jobs/', {K}) as uid,
      case when k % 2 = 0 then concat(title, ' & Co') else title end as title,
      case when k % 2 = 0 then '' else {JOB_PLACE} end as location,
      case when k % 2 = 0 then loc else {JOB_LINK.replace("concat('https://careers.acme.com/p/', "
                                                          + K + ")", "loc")} end as url,
      cast(case when k % 2 = 0 then modified else ts end as bigint) as posted_at, root as source,
      true as complete
    from ({TOP}) t"""))
def sitemap_postings(spark, folder):
    entries = sitemaps.sitemap_entries(
        materialise(_sitemap_files(spark, folder), "sitemaps"), AS_OF)
    embedded = _job_page(spark, folder, "title")
    plain = F.concat(L('<meta property="og:title" content="'), "title", L(' &amp; Co">'))
    pages = embedded.select(
        F.concat(L("https://careers.acme.com/jobs/"), C("k").cast("string")).alias("url"),
        "fetched_at", F.when(C("k") % 2 == 0, plain).otherwise(C("html")).alias("html"))
    return sitemaps.sitemap_postings(entries, materialise(pages, "pages"), AS_OF).select(
        "uid", "title", "location", "url", "posted_at", "source", "complete")


@query("sitemap_rank", duck(f"""
    select replace(split_part(root, '/', 3), 'www.', '') as host, root as sitemap_url,
      cast(count(*) filter (k % 3 <> 0 and modified >= {AS_OF - 21 * DAY}) as bigint) as recent
    from {RECENT} r group by all"""))
def sitemap_rank(spark, folder):
    return sitemaps.sitemap_rank(_sitemap_files(spark, folder), AS_OF)


# --- trackers ---------------------------------------------------------------------------------

REPO = "acme/list"


def _tracker_json(spark, folder):
    record = F.struct(
        F.when(C("k") % 3 != 0, C("k").cast("string")).alias("id"), "title", "url",
        C("company").alias("company_name"), F.array("location", "nation").alias("locations"),
        F.array("cycle_extra_s", L("TBD")).alias("terms"), (C("k") % 7 != 0).alias("active"),
        F.when(C("k") % 11 == 0, L(False)).alias("is_visible"), C("ts").alias("date_posted"),
        C("day").alias("date_updated"))
    pages = landed(fx(spark, folder), "tracker", REPO, record, "{}")
    return pages.select("source", "company", C("token").alias("repo"), L("main").alias("branch"),
                        F.concat("page_seq", L("/listings.json")).alias("path"), "fetched_at",
                        "body")


TRACKER_TITLE = ("case when cycle_extra_s in ('', 'n/a') then title else "
                 "concat(title, ', ', cycle_extra_s) end")


@query("tracker_json", want(
    "tracker", "k % 7 <> 0 and k % 11 <> 0",
    uid=f"concat('tracker:{REPO}:', case when k % 3 <> 0 then {K} else url end)",
    company="company", title=TRACKER_TITLE, source="'Acme'", posted_at="ts",
    location="case when location = '' then nation else concat(location, ', ', nation) end",
    places="concat(location, ' | ', nation)", terms="concat(cycle_extra_s, ' | TBD')"))
def tracker_json(spark, folder):
    return listing_view(trackers.tracker_json(_tracker_json(spark, folder), AS_OF))


def _readmes(spark, folder):
    """READMEs of 30 postings: a pipe table of the even ones, an HTML table of the odd."""
    rows = fx(spark, folder).withColumn("file", F.floor(C("k") / 30))
    even = C("k") % 2 == 0
    # Every third posting of a table continues the company above it.
    follows = F.floor(C("k") / 2) % 3 == 2
    link = F.concat(L("https://jobs.acme.com/apply/"), C("k").cast("string"))
    title = F.replace("title", L("|"), L("/"))
    pipe = F.concat(
        L("| "), F.when(follows, "↳").otherwise(F.concat(L("**["), "company", L("](https://c.com)**"))),
        L(" | "), title, L(" Job Details / Acme International | "), "location",
        L(" | [![Apply](https://img.shields.io/badge.png)]("), link, L(") | 3d | "),
        "cycle_extra_s", L(" |"))
    html = F.concat(
        L("<tr><td>"), F.when(follows, "&#8627;").otherwise(F.replace("company", L("&"), L("&amp;"))),
        L("</td><td>"), title, L("</td><td>"), "location", L('</td><td><a href="'), link,
        L('">Apply</a> <!-- id:'), C("k").cast("string"), L(" --></td><td>"), "day", L("</td></tr>"))
    head = ("# Jobs\n\n| Company | Role | Location | Application | Age | Term |\n"
            "|---|---|---|---|---|---|\n")
    table_head = ("<table><tr><th>Company</th><th>Position</th><th>City</th><th>Link</th>"
                  "<th>Date Posted</th></tr>")

    def lines(when, text):
        return F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(when, F.struct("k", text.alias("t"))))), lambda e: e["t"]), "\n")

    return rows.groupBy("file").agg(lines(even, pipe).alias("p"), lines(~even, html).alias("h")) \
        .select(L("Acme [tracker]").alias("source"), L("Acme").alias("company"),
                F.concat(L("acme/r"), C("file").cast("string")).alias("repo"),
                L("main").alias("branch"), L("README.md").alias("path"),
                L(AS_OF).cast("bigint").alias("fetched_at"),
                F.concat(L(head), "p", L("\n\nText between.\n"), L(table_head), "h",
                         L("</table>\n")).alias("body"))


README_SQL = f"""
    select concat('tracker:acme/r', cast(k // 30 as {TEXT}), ':', case when k % 2 = 0
        then concat('https://jobs.acme.com/apply/', {K}) else {K} end) as uid,
      coalesce(last_value(case when (k // 2) % 3 <> 2 then company end ignore nulls) over (
        partition by k // 30, k % 2 order by k rows unbounded preceding), '') as company,
      trim(replace(title, '|', '/')) as title, location,
      concat('https://jobs.acme.com/apply/', {K}) as url,
      cast(case when k % 2 = 0 then {AS_OF - 3 * DAY} else ts end as bigint) as posted_at,
      case when k % 2 = 0 then cycle_extra_s else '' end as terms from fx"""


@query("tracker_tables", duck(README_SQL))
def tracker_tables(spark, folder):
    rows = trackers.tracker_tables(materialise(_readmes(spark, folder), "readmes"), AS_OF)
    return rows.select("uid", "company", "title", "location", "url", "posted_at",
                       F.array_join("cycle_extra", " | ").alias("terms"))


@query("tracker_choose", duck(f"""
    select repo, branch, path from (
      select distinct concat('acme/r', cast(k // 30 as {TEXT})) as repo,
        case when (k // 30) % 3 = 0 then 'dev' when (k // 30) % 2 = 0 then 'main' else 'master'
          end as branch,
        case when (k // 30) % 3 = 0 then '.github/scripts/listings.json' else 'README.md' end as path
      from fx) t"""))
def tracker_choose(spark, folder):
    readmes = _readmes(spark, folder)
    file = F.regexp_extract("repo", r"(\d+)$", 1).cast("bigint")
    twice = readmes.select("*", F.explode(F.array(L("main"), L("master"))).alias("b")).withColumn(
        "branch", C("b")).drop("b")
    # An empty listing file never wins; odd repositories have no rows on main.
    plain = twice.withColumn("body", F.when((file % 2 == 1) & (C("branch") == "main"), "# none")
                             .otherwise(C("body")))
    files = [plain]
    for branch in ("dev", "main"):
        for path in ("listings.json", ".github/scripts/listings.json"):
            body = F.when((file % 3 == 0) & L(branch == "dev" and path.startswith(".")),
                          '[{"url":"u"}]').otherwise("[]")
            files.append(readmes.withColumns(
                {"branch": L(branch), "path": L(path), "body": body}))
    every = files[0]
    for part in files[1:]:
        every = every.unionByName(part)
    # The landing zone is a stored table; so is its stand-in here.
    return trackers.tracker_choose(materialise(every, "tracker-files"), AS_OF).select("repo", "branch", "path")


# --- the landing zone ----------------------------------------------------------------------------

def _pages_landed(spark, folder):
    return landed(fx(spark, folder), "greenhouse", "acme", F.struct("k", "title"), '{"jobs":{}}')


@query("incr_scan", duck(f"""
    select distinct cast(k // 25 as int) as page_seq, concat('g', cast(k // 25 % 4 as {TEXT})) as source,
      cast(met as bigint) as fetched_at from fx join (values (1, {AS_OF}), (2, {AS_OF}),
      (3, {AS_OF - 1}), (3, {AS_OF})) as t(g, met) on k // 25 % 4 = g"""))
def incr_scan(spark, folder):
    """Listings unchanged, changed on each page, new, and changed twice back to what they were."""
    group = C("page_seq") % 4
    pages = _pages_landed(spark, folder).withColumn(
        "source", F.concat(L("g"), group.cast("string")))
    other = pages.withColumn("body", F.concat(L(" "), "body"))

    def at(rows, seconds):
        return rows.withColumn("fetched_at", C("fetched_at") + seconds)

    nothing = spark.createDataFrame([], state.PAYLOADS_SCHEMA)
    seen = remember_payloads(at(pages.where(group.isin(0, 3)).unionByName(
        other.where(group == 1)), -9), nothing)
    landing = pages.unionByName(at(pages.where(group == 3), -2)).unionByName(
        at(other.where(group == 3), -1))
    return incremental_scan(landing, seen).select("page_seq", "source", "fetched_at")


# Short links s0..s49 lead: 0-2 mod 5 to an employer in one, two or three hops, 3 to nowhere,
# and those of 4 have not landed.
SHORT_NO = "cast(regexp_extract(url, '^https://bit.ly/s([0-9]+)$', 1) as int)"
SHORT_END = f"concat('https://jobs.end', cast({SHORT_NO} as varchar), '.com/apply?a=1&b=2')"


def _link_pages(spark, folder):
    """Landed redirects for the short links that postings use, as often as they use them."""
    used = fx(spark, folder).where(C("url").startswith("https://bit.ly/")).select(
        "url", F.regexp_extract("url", r"s(\d+)$", 1).cast("int").alias("n"),
        C("ts").alias("fetched_at"))
    kind = C("n") % 5
    end = F.concat(L("https://jobs.end"), C("n").cast("string"), L(".com/apply?a=1&"))
    hop = F.concat(L("https://t.co/h"), C("n").cast("string"))

    def page(rows, url, status, to, html):
        return rows.select(url.alias("url"), "fetched_at", L(status).alias("status"),
                           to.alias("location_header"), html.alias("html"))

    none = L(None).cast("string")
    first = page(used.where(kind != 4), C("url"), 302, F.when(
        kind == 0, F.concat(end, L("b=2"))).when(kind == 3, "").otherwise(hop), none)
    second = page(used.where(kind.isin(1, 2)), hop, 200, none, F.concat(
        L('<meta http-equiv="refresh" content="0; url='),
        F.when(kind == 1, F.concat(end, L("amp;b=2"))).otherwise("/g?x=1"), L('">')))
    third = page(used.where(kind == 2), L("https://t.co/g?x=1"), 301, L("/nowhere"), none)
    return first.unionByName(second).unionByName(third)


@query("short_links", duck(f"""
    select uid, case when swap then {SHORT_END} else url end as url,
      case when swap then url else '' end as short_url
    from (select *, url like 'https://bit.ly/%' and {d.scope(d.PLACE)} in ('ontario', 'canada')
        and case when url like 'https://bit.ly/%' then {SHORT_NO} % 5 in (0, 1) else false end
        as swap from fx) t"""))
def short_links(spark, folder):
    rows = postings(spark, folder)
    return resolve_short_links(rows, _link_pages(spark, folder)).select(
        "uid", "url", "short_url")


# Link n takes n % 10 + 1 hops, of which eight are allowed; n % 25 = 13 goes round in a circle.
@query("links_kept", duck(f"""
    select uid, case when asked and {SHORT_NO} % 10 < 8 and {SHORT_NO} % 25 <> 13
        then concat('https://jobs.lever.co/e', cast({SHORT_NO} as varchar), '/x') else url end as url
    from (select *, url like 'https://bit.ly/%' and {d.scope(d.PLACE)} in ('ontario', 'canada')
        as asked from fx) t"""))
def links_kept(spark, folder):
    """Chains of short links over two landings: short ones are known before the second,
    whose pages lack them; the others' later pages land only then."""
    n, step = C("n"), C("i")
    short = F.concat(L("https://bit.ly/s"), n.cast("string"))

    def hop(number):
        return F.when(number == 0, short).otherwise(F.concat(short, L("/"), number.cast("string")))

    last = F.when(n % 25 == 13, short).otherwise(
        F.concat(L("https://jobs.lever.co/e"), n.cast("string"), L("/x")))
    pages = materialise(fx(spark, folder).select((C("ck") % 50).alias("n")).distinct().select(
        n, F.explode(F.sequence(L(0), (n % 10).cast("int"))).alias("i")).select(
            n, step, hop(step).alias("url"), L(AS_OF).cast("bigint").alias("fetched_at"),
            L(302).alias("status"),
            F.when(step == n % 10, last).otherwise(hop(step + 1)).alias("location_header"),
            L("").alias("html")), "hop-pages")
    rows, cfg = postings(spark, folder), Settings(short_link_hops=8)
    none = spark.createDataFrame([], state.LINKS_SCHEMA)
    first = follow_links(rows, none, pages.where(step < 3), cfg)
    return follow_links(rows, first.links, pages.where(n % 10 >= 3), cfg).rows.select("uid", "url")


# --- detail records -----------------------------------------------------------------------------

@query("extract_desc", duck(f"""
    select uid, cast(length(text) as int) as chars, text, place, cast(posted as bigint) as posted
    from (select uid,
      case when k % 13 = 12 then '' when k % 13 in (0, 1) then concat(title, ' & more')
        when k % 13 = 7 then concat(title, ' R ', title)
        when k % 13 = 3 then repeat(concat(title, '. '), 20) || title
        when k % 13 in (4, 5, 6) then concat(title, ' & more')
        else concat('Page ', title) end as text,
      case k % 13 when 0 then location when 1 then {joined("location", "'Oakville, ON'")}
        when 7 then location when 4 then {JOB_PLACE} when 5 then {JOB_PLACE}
        when 6 then {JOB_PLACE} else '' end as place,
      case when k % 13 in (0, 1, 4, 5, 6) then ts else 0 end as posted
      from fx where k % 13 <> 11 and k % 13 <> 12 and url like 'http%'
        and (k % 13 <> 9 or true)) t"""))
def extract_desc(spark, folder):
    rows = fx(spark, folder)
    kind = C("k") % 13
    text = F.concat(L("&lt;p&gt;"), "title", L(" &amp;amp; more&lt;/p&gt;"))
    greenhouse = F.to_json(F.struct(text.alias("content"), F.struct(C("location").alias("name"))
                                    .alias("location"), C("day").alias("first_published")))
    workday = F.to_json(F.struct(F.struct(
        text.alias("jobDescription"), "location", F.array(L("Oakville, ON"))
        .alias("additionalLocations"), C("day").alias("startDate")).alias("jobPostingInfo")))
    lever = F.to_json(F.struct(F.concat(F.repeat(F.concat("title", L(". ")), 20), "title")
                               .alias("descriptionPlain")))
    oracle = F.to_json(F.struct(F.array(F.struct(
        C("title").alias("ExternalDescriptionStr"), L("<b>R</b>").alias(
            "ExternalResponsibilitiesStr"), C("title").alias("ExternalQualificationsStr"),
        C("location").alias("PrimaryLocation"))).alias("items")))
    page = F.concat(L("<style>p{}</style><p>Page</p> "), "title", L("<script>x</script>"))
    jobs = _job_page(spark, folder).select("k", C("html").alias("job_html"))
    bodies = rows.join(jobs, "k").select(
        "k", F.when(kind == 0, greenhouse).when(kind == 1, workday).when(kind == 3, lever)
        .when(kind == 7, oracle).when(kind.isin(4, 5, 6), C("job_html")).otherwise(page)
        .alias("body"))
    asked = rows.where(kind < 11).select(
        "k", "uid", F.when(kind.isin(0, 9), F.concat("url", L("?p="), C("k").cast("string")))
        .otherwise(C("url")).alias("url"), L("").alias("inline_description"))
    details = asked.join(bodies, "k").select("url", L(AS_OF).alias("fetched_at"), "body")
    return detail_pages.extract_descriptions(asked, details, AS_OF).select(
        "uid", F.length("text").alias("chars"), "text", "place", "posted")
