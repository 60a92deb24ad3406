"""Queries over the board sources: orders landed as each platform's payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsluice.catalog import duck as d
from jobsluice.catalog.fixtures import (
    AS_OF, AS_OF_2026, DAY, MONTHS, TEXT, duck, fx, landed, landed_markup, listing_view, pick)
from jobsluice.catalog.registry import query
from jobsluice.functions import vocab
from jobsluice.functions.dates import EARLIEST
from jobsluice.settings import DEFAULT
from jobsluice.sources.base import SOURCES, listing_complete
from jobsluice.sources.json_boards import resolve_multi_location

C, L = F.col, F.lit
K = f"cast(k as {TEXT})"
ISO_TS = "ts + 19800"
RECENT = f"case when ts > {EARLIEST} then ts else 0 end"


def joined(*parts: str) -> str:
    items = "[" + ", ".join(parts) + "]"
    return (f"array_to_string(list_filter({items}, lambda x, i: x <> '' and "
            f"list_position({items}, x) = i), ', ')")


def want(platform: str, where: str = "true", **columns: str) -> str:
    """The listing rows a platform's payload must give, straight from the postings."""
    c = {"company": "'Acme'", "title": "title", "location": "location", "url": "url",
         "source": f"'Acme [{platform}]'", "posted_at": "cast(0 as bigint)", "country": "''",
         "employment_type": "''", "places": "''", "terms": "''", **columns}
    order = ["uid", "company", "title", "location", "url", "source", "posted_at", "country",
             "employment_type", "places", "terms"]
    return duck("select " + ", ".join(f"{c[n]} as {n}" for n in order) + f" from fx where {where}")


def read(rows: DataFrame, platform: str) -> DataFrame:
    return listing_view(SOURCES[platform](rows, AS_OF))


def iso():
    return F.concat("day", L("T05:30:00.000+00:00"))


def key(prefix: str) -> str:
    return f"concat('{prefix}', {K})"


def skey(prefix: str):
    return F.concat(L(prefix), C("k").cast("string"))


@query("src_ashby", want(
    "ashby", "k % 13 <> 0", uid=key("ashby:acme:"), location=joined("location", "loc_extra_s"),
    url=f"case when k % 2 = 0 then url else {key('https://jobs.ashbyhq.com/acme/')} end",
    posted_at=ISO_TS, places="concat(location, ' | ', loc_extra_s)",
    employment_type="employment_type"))
def src_ashby(spark, folder):
    record = F.struct(
        C("k").cast("string").alias("id"), "title", "location",
        F.array(F.struct(C("loc_extra_s").alias("location"))).alias("secondaryLocations"),
        (C("k") % 13 != 0).alias("isListed"), iso().alias("publishedAt"),
        F.when(C("k") % 2 == 0, C("url")).alias("jobUrl"),
        C("employment_type").alias("employmentType"))
    return read(landed(fx(spark, folder), "ashby", "acme", record, '{"jobs":{}}'), "ashby")


@query("src_greenhouse", want(
    "greenhouse", uid=key("greenhouse:acme:"),
    location="case when location = '' then 'HQ' else concat(location, ', HQ, ', location) end",
    url=f"case when k % 2 = 0 then url else {key('https://boards.greenhouse.io/acme/jobs/')} end",
    posted_at=f"case when k % 3 = 0 then {ISO_TS} else ts end",
    places="concat(location, ' | HQ | ', location)"))
def src_greenhouse(spark, folder):
    record = F.struct(
        C("k").alias("id"), "title", F.struct(C("location").alias("name")).alias("location"),
        F.array(F.struct(L("HQ").alias("name")), F.struct(C("location").alias("name")))
        .alias("offices"), F.when(C("k") % 2 == 0, C("url")).alias("absolute_url"),
        F.when(C("k") % 3 != 0, C("day")).alias("first_published"), iso().alias("updated_at"))
    return read(landed(fx(spark, folder), "greenhouse", "acme", record, '{"jobs":{}}'),
                "greenhouse")


@query("src_lever", want(
    "lever", uid=key("lever:acme:"),
    location=joined("location", "'hybrid'",
                    "concat(case when location = '' then '' else location || ', ' end, 'Remote')",
                    "employment_type"),
    posted_at=RECENT, places="'hybrid'", terms="cycle_extra_s"))
def src_lever(spark, folder):
    record = F.struct(
        C("k").cast("string").alias("id"), C("title").alias("text"),
        F.struct("location", F.array("location", L("Remote")).alias("allLocations"),
                 C("employment_type").alias("commitment")).alias("categories"),
        L("hybrid").alias("workplaceType"), (C("ts") * 1000).alias("createdAt"),
        C("url").alias("hostedUrl"), C("cycle_extra_s").alias("term"))
    return read(landed(fx(spark, folder), "lever", "acme", record, "{}"), "lever")


@query("src_smartrecruiters", want(
    "smartrecruiters", uid=key("smartrecruiters:acme:"), country="'Canada'",
    location=joined("location", "'ON'", "'ca'", "case when k % 2 = 0 then 'remote' else '' end"),
    url=key("https://jobs.smartrecruiters.com/acme/"), posted_at="ts",
    places="concat(location, ' | ca | ON', case when k % 2 = 0 then ' | remote' else '' end)"))
def src_smartrecruiters(spark, folder):
    record = F.struct(
        C("k").cast("string").alias("id"), C("title").alias("name"),
        F.struct(C("location").alias("city"), L("ON").alias("region"), L("ca").alias("country"),
                 (C("k") % 2 == 0).alias("remote")).alias("location"),
        C("day").alias("releasedDate"))
    return read(landed(fx(spark, folder), "smartrecruiters", "acme", record,
                       '{"totalFound":9,"content":{}}'), "smartrecruiters")


SHORT = f"case when k % 2 = 0 then concat('S', {K}) else {K} end"


@query("src_workable", want(
    "workable", uid=f"concat('workable:acme:', {SHORT})", country="'Canada'",
    location=joined("location", "'Canada'", "case when k % 3 = 0 then 'remote' else '' end"),
    url=f"concat('https://apply.workable.com/acme/j/', {SHORT}, '/')", posted_at="ts",
    places="concat(location, ' | ')"))
def src_workable(spark, folder):
    record = F.struct(
        C("k").alias("id"), F.when(C("k") % 2 == 0, skey("S")).alias("shortcode"), "title",
        C("location").alias("city"), L("").alias("region"), L("Canada").alias("country"),
        (C("k") % 3 == 0).alias("telecommuting"), C("day").alias("published_on"))
    return read(landed(fx(spark, folder), "workable", "acme", record, '{"jobs":{}}'), "workable")


@query("src_recruitee", want(
    "recruitee", uid=key("recruitee:acme:"), country="'Canada'",
    location=joined("location", "loc_extra_s", "'Canada'",
                    "case when k % 3 = 0 then 'remote' else '' end"), posted_at="ts",
    places="concat(location, ' | ', loc_extra_s, case when k % 3 = 0 then ' | remote' else '' end)"))
def src_recruitee(spark, folder):
    record = F.struct(
        C("k").alias("id"), "title", "location", C("loc_extra_s").alias("city"),
        L("Canada").alias("country"), (C("k") % 3 == 0).alias("remote"),
        C("url").alias("careers_url"), C("day").alias("published_at"))
    return read(landed(fx(spark, folder), "recruitee", "acme", record, '{"offers":{}}'),
                "recruitee")


@query("src_teamtailor", want(
    "teamtailor", uid=key("teamtailor:acme:"),
    location="case when k % 3 < 2 then " + joined("location", "'Canada'") + " else "
             + joined("concat(case when location = '' then '' else location || ', ' end, 'ON; CA')",
                      "case when k % 2 = 0 then 'remote' else '' end") + " end",
    posted_at="ts", employment_type="case when k % 3 = 2 then employment_type else '' end",
    country="case when k % 3 < 2 then 'Canada' else '' end",
    places="case when k % 3 < 2 then location else '' end"))
def src_teamtailor(spark, folder):
    rows = fx(spark, folder)
    page = F.floor(C("k") / 25) * 3 + C("k") % 3
    plain = F.struct(C("k").cast("string").alias("id"), "title", "location",
                     L("Canada").alias("country"), C("url").alias("careersite-job-url"),
                     C("day").alias("created-at"))
    address = F.array(
        F.struct(F.struct(C("location").alias("addressLocality"), L("ON").alias("addressRegion"))
                 .alias("address")),
        F.struct(F.struct(L(None).cast("string").alias("addressLocality"),
                          L("CA").alias("addressRegion")).alias("address")))
    feed = F.struct(
        C("k").cast("string").alias("id"), "title", "url", C("day").alias("date_published"),
        F.struct(address.alias("jobLocation"), C("employment_type").alias("employmentType"),
                 F.when(C("k") % 2 == 0, "TELECOMMUTE").alias("jobLocationType"))
        .alias("_jobposting"))
    parts = [landed(rows.where(C("k") % 3 == i), "teamtailor", "acme", record, shape, page)
             for i, (record, shape) in enumerate(
                 ((plain, "{}"), (plain, '{"jobs":{}}'), (feed, '{"items":{}}')))]
    return read(parts[0].unionByName(parts[1]).unionByName(parts[2]), "teamtailor")


@query("src_breezy", want(
    "breezy", uid=key("breezy:acme:"),
    location="case when k % 2 = 0 then " + joined("location", "'Canada'", "'remote'")
             + " else location end",
    url=f"concat('https://acme.breezy.hr/p/f', {K})", posted_at="ts",
    places="case when k % 2 = 0 then concat(location, ' | Canada | remote') else location end"))
def src_breezy(spark, folder):
    rows = fx(spark, folder)
    page = F.floor(C("k") / 25) * 2 + C("k") % 2
    common = [C("k").cast("string").alias("id"), C("title").alias("name"),
              skey("f").alias("friendly_id"), C("day").alias("published_date")]
    spot = F.struct(C("location").alias("city"), F.struct(L("Canada").alias("name"))
                    .alias("country"), L(True).alias("is_remote")).alias("location")
    objects = landed(rows.where(C("k") % 2 == 0), "breezy", "acme", F.struct(*common, spot),
                     "{}", page)
    plain = landed(rows.where(C("k") % 2 == 1), "breezy", "acme", F.struct(*common, "location"),
                   "{}", page)
    return read(objects.unionByName(plain), "breezy")


CXS = "https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Jobs/jobs"
WD_ID = f"case when k % 5 = 0 then concat('/job/X/', {K}) else concat('JR', {K}) end"
WD_PLACE = "case when k % 3 = 0 then '3 Locations' else location end"


def _workday(spark, folder):
    def record(title):
        ids = F.when(C("k") % 5 != 0, F.array(skey("JR"))).otherwise(
            F.array().cast("array<string>"))
        return F.struct(
            title.alias("title"), ids.alias("bulletFields"),
            skey("/job/X/").alias("externalPath"),
            F.when(C("k") % 3 == 0, "3 Locations").otherwise(C("location")).alias("locationsText"),
            L("Posted 3 Days Ago").alias("postedOn"))
    rows = fx(spark, folder)
    page = F.floor(C("k") / 25).cast("int")
    first = landed(rows, "workday", CXS, record(C("title")), '{"jobPostings":{}}', page, "Canada")
    again = landed(rows.where(C("k") % 2 == 0), "workday", CXS,
                   record(F.concat("title", L(" II"))), '{"jobPostings":{}}', page + 1_000_000,
                   "Canada")
    return first.unionByName(again)


WORKDAY = dict(
    uid=f"concat('workday:acme.wd3.myworkdayjobs.com:', {WD_ID})", country="'Canada'",
    title="case when k % 2 = 0 then concat(title, ' II') else title end", location=WD_PLACE,
    url=f"concat('https://acme.wd3.myworkdayjobs.com/en-US/Jobs/job/X/', {K})",
    posted_at=f"cast({AS_OF - 3 * DAY} as bigint)", places=WD_PLACE)


@query("src_workday", want("workday", **WORKDAY))
def src_workday(spark, folder):
    return read(_workday(spark, folder), "workday")


_TITLE2 = WORKDAY["title"]
_STUDENT = (f"({d.any_rx(_TITLE2, vocab.STUDENT_TERMS + vocab.NEWGRAD_TERMS)} or len(list_filter("
            + d.cycles(f"concat({_TITLE2}, ' | ')") + f", lambda x: x >= {DEFAULT.live_from})) > 0)")


@query("src_workday_detail", want("workday", **{
    **WORKDAY, "location": f"case when k % 3 = 0 and {_STUDENT} then "
    + joined("location", "'Oakville, ON'", "loc_extra_s", "'Canada'") + f" else {WD_PLACE} end"}))
def src_workday_detail(spark, folder):
    rows = fx(spark, folder)
    info = F.struct("location", F.array(L("Oakville, ON"), C("loc_extra_s"))
                    .alias("additionalLocations"),
                    F.struct(L("Canada").alias("descriptor")).alias("country"))
    details = rows.select(L("Acme [workday]").alias("source"),
                          skey("/job/X/").alias("external_path"), L(AS_OF).alias("fetched_at"),
                          F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("body"))
    # Every detail landed once before, with other places.
    details = details.unionByName(details.withColumns({
        "fetched_at": C("fetched_at") - 1, "body": F.replace("body", L("Oakville"), L("Paris"))}))
    found = SOURCES["workday"](_workday(spark, folder), AS_OF)
    return listing_view(resolve_multi_location(found, details, AS_OF_2026))


@query("merge_pages", duck("""
    select page_seq, false as is_copy, page_seq % 7 <> 0 as complete, cast(count(*) as bigint)
      as postings from (select cast(k // 25 as int) as page_seq from fx where k % 2 = 1) t
      group by page_seq
    union all select 1000000 + page_seq, true, (1000000 + page_seq) % 7 <> 0,
      cast(count(*) as bigint)
      from (select cast(k // 25 as int) as page_seq from fx where k % 2 = 0) t group by page_seq
    """))
def merge_pages(spark, folder):
    """Which landed page each merged posting was last met on."""
    rows = SOURCES["workday"](_workday(spark, folder), AS_OF)
    return rows.groupBy("page_seq", C("title").endswith(" II").alias("is_copy"), "complete").agg(
        F.count("*").alias("postings"))


@query("listing_complete", duck("""
    select source, fetched_at, bool_and(page_seq % 7 <> 0) as complete,
      cast(count(*) as bigint) as pages
    from (select distinct nation as source, cast(k // 25 as int) as page_seq,
      996624000 + ck % 3 as fetched_at from fx) t group by source, fetched_at"""))
def whole_listings(spark, folder):
    pages = fx(spark, folder).select(
        C("nation").alias("source"), F.floor(C("k") / 25).cast("int").alias("page_seq"),
        (L(AS_OF) + C("ck") % 3).alias("fetched_at")).distinct().withColumn(
            "complete", C("page_seq") % 7 != 0)
    return listing_complete(pages)


@query("src_amazon", want(
    "amazon", uid=key("amazon:"), location=joined("location", "concat('CA, ', nation)"),
    url=f"concat('https://www.amazon.jobs/en/jobs/', {K})", posted_at="ts", places="nation",
    country="'Canada'"))
def src_amazon(spark, folder):
    rows = fx(spark, folder).withColumn("month_name", F.expr(pick("(month_no - 1)", MONTHS)))
    record = F.struct(
        F.when(C("k") % 2 == 0, C("k").cast("string")).alias("id_icims"),
        C("k").cast("string").alias("id"), "title", C("location").alias("normalized_location"),
        F.concat(L("CA, "), "nation").alias("location"), skey("/en/jobs/").alias("job_path"),
        F.concat("month_name", L("  "), "day_no", L(", "), "year_no").alias("posted_date"),
        C("nation").alias("city"))
    return read(landed(rows, "amazon", "CAN", record, '{"hits":9,"jobs":{}}', country="Canada"),
                "amazon")


@query("src_oracle", want(
    "oracle", uid=key("oracle:eh.fa.ca2.oraclecloud.com:"),
    location=joined("location", "loc_extra_s", "case when k % 4 = 0 then 'Remote' else '' end"),
    url=key("https://eh.fa.ca2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_7/job/"),
    posted_at="ts"))
def src_oracle(spark, folder):
    record = F.struct(
        C("k").alias("Id"), C("title").alias("Title"), C("location").alias("PrimaryLocation"),
        F.array(F.struct(C("loc_extra_s").alias("Name"))).alias("secondaryLocations"),
        F.when(C("k") % 4 == 0, "Fully Remote").alias("WorkplaceType"),
        C("day").alias("PostedDate"))
    return read(landed(fx(spark, folder), "oracle", "https://eh.fa.ca2.oraclecloud.com/|CX_7",
                       record, '{"items":[{"TotalJobsCount":9,"requisitionList":{}}]}'), "oracle")


@query("src_jibe", want(
    "jibe", uid=key("jibe:careers.acme.com:"),
    location=joined("location", joined("nation", "'ON'", "'Canada'")),
    url=f"case when k % 2 = 0 then url else {key('https://careers.acme.com/jobs/')} end",
    posted_at=ISO_TS))
def src_jibe(spark, folder):
    data = F.struct(
        F.when(C("k") % 2 == 0, C("k").cast("string")).alias("req_id"),
        C("k").cast("string").alias("slug"), "title", C("location").alias("full_location"),
        C("nation").alias("city"), L("ON").alias("state"), L("Canada").alias("country"),
        iso().alias("posted_date"), F.when(C("k") % 2 == 0, C("url")).alias("canonical_url"))
    return read(landed(fx(spark, folder), "jibe", "https://careers.acme.com/",
                       F.struct(data.alias("data")), '{"jobs":{},"totalCount":9}'), "jibe")


@query("src_eightfold", want(
    "eightfold", uid=key("eightfold:acme.eightfold.ai:"),
    location=joined("location", "loc_extra_s", "case when k % 4 = 0 then 'Remote' else '' end"),
    url=f"case when k % 2 = 0 then {key('https://acme.eightfold.ai/p/')} else "
        f"{key('https://acme.eightfold.ai/careers/job/')} end", posted_at=RECENT))
def src_eightfold(spark, folder):
    record = F.struct(
        C("k").alias("id"), C("title").alias("name"),
        F.array("location", "loc_extra_s").alias("locations"),
        F.when(C("k") % 4 == 0, "remote_local").alias("workLocationOption"),
        F.when(C("k") % 2 == 0, skey("/p/")).alias("positionUrl"), C("ts").alias("postedTs"))
    return read(landed(fx(spark, folder), "eightfold", "https://acme.eightfold.ai|acme.com",
                       record, '{"data":{"count":9,"positions":{}}}'), "eightfold")


@query("src_bamboohr", want(
    "bamboohr", uid=key("bamboohr:acme:"), employment_type="employment_type",
    location=joined("location", "'ON'", "loc_extra_s", "'Ontario'", "'Canada'",
                    "case when k % 4 = 0 then 'Remote' else '' end"),
    url=key("https://acme.bamboohr.com/careers/")))
def src_bamboohr(spark, folder):
    record = F.struct(
        C("k").alias("id"), C("title").alias("jobOpeningName"),
        F.struct(C("location").alias("city"), L("ON").alias("state")).alias("location"),
        F.struct(C("loc_extra_s").alias("city"), L("Ontario").alias("state"),
                 L("Canada").alias("country")).alias("atsLocation"),
        F.when(C("k") % 4 == 0, L(True)).alias("isRemote"),
        C("employment_type").alias("employmentStatusLabel"))
    return read(landed(fx(spark, folder), "bamboohr", "acme", record, '{"result":{}}'),
                "bamboohr")


@query("src_rippling", want(
    "rippling", uid=key("rippling:acme:"),
    location=joined(joined("location", "'ON'", "'Canada'"), joined("loc_extra_s", "'CA'"),
                    "case when k % 4 = 0 then 'Remote' else '' end"),
    url=f"case when k % 2 = 0 then url else {key('https://ats.rippling.com/acme/jobs/')} end"))
def src_rippling(spark, folder):
    spots = F.array(
        F.struct(C("location").alias("city"), L("ON").alias("stateCode"),
                 L("Canada").alias("country"), L("ON_SITE").alias("workplaceType")),
        F.struct(C("loc_extra_s").alias("city"), L(None).cast("string").alias("stateCode"),
                 L("CA").alias("country"),
                 F.when(C("k") % 4 == 0, "remote").alias("workplaceType")))
    record = F.struct(C("k").cast("string").alias("id"), C("title").alias("name"),
                      spots.alias("locations"), F.when(C("k") % 2 == 0, C("url")).alias("url"))
    return read(landed(fx(spark, folder), "rippling", "acme", record,
                       '{"items":{},"totalPages":9}'), "rippling")


@query("src_getro", want(
    "getro", uid=key("getro:careers.acme.vc:"), company="company",
    location=joined("location", "loc_extra_s", "case when k % 4 = 0 then 'Remote' else '' end"),
    url=f"case when k % 2 = 0 then url else "
        f"concat('https://careers.acme.vc/companies/o/jobs/s', {K}) end",
    employment_type="employment_type", posted_at=RECENT))
def src_getro(spark, folder):
    record = F.struct(
        C("k").alias("id"), "title",
        F.struct(C("company").alias("name"), L("o").alias("slug")).alias("organization"),
        F.array("location", "loc_extra_s").alias("locations"),
        F.when(C("k") % 4 == 0, "remote").otherwise("on_site").alias("work_mode"),
        C("employment_type").alias("seniority"), skey("s").alias("slug"),
        F.when(C("k") % 2 == 0, C("url")).alias("url"), C("ts").alias("created_at"))
    return read(landed(fx(spark, folder), "getro", "https://careers.acme.vc/", record,
                       '{"results":{"count":9,"jobs":{}}}'), "getro")


@query("src_consider", want(
    "consider", uid=key("consider:jobs.acme.vc:"),
    company="case when k % 9 = 0 then 'Acme' else company end",
    location=joined("location", "case when k % 4 = 0 then 'Remote' else '' end"),
    employment_type=joined("employment_type", "'Senior'"), posted_at="ts"))
def src_consider(spark, folder):
    record = F.struct(
        C("k").alias("jobId"), "title",
        F.when(C("k") % 9 != 0, C("company")).alias("companyName"),
        F.array("location").alias("locations"), (C("k") % 4 == 0).alias("remote"),
        C("url").alias("applyUrl"),
        F.array(F.struct(C("employment_type").alias("label")),
                F.struct(L("Senior").alias("label"))).alias("jobSeniorities"),
        C("day").alias("timeStamp"))
    return read(landed(fx(spark, folder), "consider", "jobs.acme.vc", record,
                       '{"jobs":{},"total":9}'), "consider")


# --- markup ---------------------------------------------------------------------------------

def _amp(column: str):
    return F.replace(column, L("&"), L("&amp;"))


@query("src_icims", want(
    "icims", uid=key("icims:careers-acme.icims.com:"),
    location=joined("'Ottawa, ON, Canada'", "case when k % 2 = 0 then 'Remote, Canada' else '' end",
                    "case when k % 2 = 0 then nation else '' end"),
    url=f"concat('https://careers-acme.icims.com/jobs/', {K}, '/dev/job')",
    posted_at="ts + 57900"))
def src_icims(spark, folder):
    date = F.concat_ws("/", "month_no", "day_no", F.concat("year_no", L(" 4:05 PM")))
    more = F.when(C("k") % 2 == 0, F.concat(
        L('<dt>Additional Locations</span></dt><dd class="x"><span>CA-Remote|'), "nation",
        L("</span></dd>"))).otherwise("")
    block = F.concat(
        L('<li class="iCIMS_JobCardItem"><a href="https://careers-acme.icims.com/jobs/'),
        C("k").cast("string"), L('/dev/job?in_iframe=1" title="x" class="iCIMS_Anchor"><h3>'),
        _amp("title"),
        L('</h3></a><span class="field-label">Job Locations</span>\n<span>CA-ON-Ottawa</span>'),
        more, L('<dt>Posted Date</dt><dd class="d"> <span title="'), date, L('">x</span></dd></li>'))
    return read(landed_markup(fx(spark, folder), "icims", "https://careers-acme.icims.com", block,
                              "<ul>", "</ul>"), "icims")


@query("src_successfactors", want(
    "successfactors", uid="concat('successfactors:jobs.acme.com:', cast(100000 + k as varchar))",
    location="case when k % 3 = 0 or location = '' then 'Toronto, ON' else location end",
    url="concat('https://jobs.acme.com/job/Toronto-Dev-ON-M5J-2V5/', "
        "cast(100000 + k as varchar), '/')", posted_at="ts"))
def src_successfactors(spark, folder):
    rows = fx(spark, folder).withColumn("month_name", F.expr(pick("(month_no - 1)", MONTHS)))
    jid = (C("k") + 100000).cast("string")
    date = F.concat(F.left("month_name", L(3)), L(" "), "day_no", L(", "), "year_no")
    link = F.concat(L('<a class="x" href="/job/Toronto-Dev-ON-M5J-2V5/'), jid, L('/"> '),
                    _amp("title"), L(" </a>"))
    spot = F.when(C("k") % 3 == 0, "").otherwise(C("location"))
    table = F.concat(L('<tr class="data-row">'), link, L('<span class="jobLocation"> '), spot,
                     L(' </span><span class="jobDate visible"> '), date, L("</span></tr>"))
    tile = F.concat(L('<li class="job-tile x">'), link, L('<div id="a-section-location-value"> '),
                    spot, L(' </div><span class="jobDate"> '), date, L("</span></li>"))
    block = F.when(C("k") % 2 == 0, table).otherwise(tile)
    return read(landed_markup(rows, "successfactors",
                              "https://jobs.acme.com/search/?q=intern&locationsearch=Ontario",
                              block), "successfactors")


@query("src_jazzhr", want(
    "jazzhr", uid=f"concat('jazzhr:acme:j', {K})",
    url=f"concat('https://acme.applytojob.com/apply/j', {K}, '/Dev?a=1&b=2')"))
def src_jazzhr(spark, folder):
    block = F.concat(
        L('<li class="list-group-item"><a href="https://acme.applytojob.com/apply/j'),
        C("k").cast("string"), L('/Dev?a=1&amp;b=2">'), _amp("title"),
        L('</a><i class="fa fa-map-marker"></i> '), "location", L(" </li>"))
    return read(landed_markup(fx(spark, folder), "jazzhr", "acme", block, "<ul>", "</ul>"),
                "jazzhr")


@query("src_personio", want(
    "personio", uid=key("personio:acme:"), location=joined("location", "employment_type"),
    url=key("https://acme.jobs.personio.de/job/"), employment_type="employment_type"))
def src_personio(spark, folder):
    block = F.concat(
        L("<position><id>"), C("k").cast("string"), L("</id><name>"), _amp("title"),
        L("</name><office>"), "location", L("</office><employmentType>"), "employment_type",
        L("</employmentType></position>"))
    return read(landed_markup(fx(spark, folder), "personio", "acme", block,
                              '<?xml version="1.0"?><workzag-jobs>', "</workzag-jobs>"),
                "personio")
