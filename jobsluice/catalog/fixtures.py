"""Job tables derived from the given tables, in Spark and in DuckDB alike.

The same SELECT runs in both engines; only the table names and the epoch
expression differ. Every order is one posting, so the work grows with the
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsluice.functions.identity import fingerprint
from jobsluice.operators.state import JOBS_COLUMNS
from jobsluice.sources.base import LANDED_SCHEMA, POSTING_COLUMNS

AS_OF = 996_624_000      # 2001-08-01, the last order date
AS_OF_2026 = 1_793_534_400  # 2026-11-01 12:00 UTC, for work terms
DAY = 86_400

TITLES = [
    "Machine Learning Intern", "ML Intern (Summer 2027)", "Software Developer Co-op",
    "Analog Design Intern", "Senior Data Engineer", "Data Science Internship, Winter 2027",
    "Unpaid Research Intern", "New Grad Machine Learning Engineer",
    "AI Research Student - Fall 2027", "IT Support Co-op", "Marketing Coordinator Intern",
    "Store Cashier Student", "Warehouse Student Placement", "2026 Summer - Data Analyst Intern",
    "Software Engineer Intern, Winter", "Computer Vision Engineer - Summer 2027",
    "Backend Developer Co-op W27", "NLP Intern Fall 26", "Robotics Apprentice (8 months)",
    "PhD Students Only: Deep Learning Intern", "Full Stack Developer",
    "Data & Analytics Co-op R-12345", "Quantum Software Intern | Remote",
    "CV File Upload Student", "Recent Graduate Web Developer",
]
LOCATIONS = [
    "Toronto, ON", "Vancouver, BC", "Remote, Canada", "Ottawa, ON", "Austin, TX",
    "Waterloo, Ontario, Canada", "Waterloo, IA", "Hamilton, OH", "Canada", "Remote", "",
    "Mississauga, Ontario, CA", "London, ON", "London, UK", "Ottawa, ON; Toronto, ON",
    "Concord, CA", "Montréal, QC", "New York, NY", "1 Hamilton Rd, Windsor, CT",
]
TERMS = ["", "Summer 2027", "Fall 2026", "", "Winter 2027", "", "n/a"]
LEVELS = ["", "", "Intern", "", "Full time", ""]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(key: str, values: list[str]) -> str:
    """A CASE that deals the values out by a key."""
    arms = " ".join(f"when {i} then {quote(v)}" for i, v in enumerate(values))
    return f"case {key} % {len(values)} {arms} end"


TEXT = "varchar(40)"
HEX = f"lpad(cast(k as {TEXT}), 12, '0')"
BOARD_SLUG = f"concat('b', cast(ck % 40 as {TEXT}))"
URLS = [
    f"concat('https://job-boards.greenhouse.io/', {BOARD_SLUG}, '/jobs/', "
    f"cast(100000 + k % 700 as {TEXT}))",
    f"concat('https://t', cast(ck % 9 as {TEXT}), '.wd5.myworkdayjobs.com/en-US/Site/job/Toronto/"
    f"Dev_R-', cast(10000 + k as {TEXT}))",
    f"concat('https://jobs.ashbyhq.com/', {BOARD_SLUG}, '/0000abcd-0000-4000-8000-', {HEX})",
    f"concat('https://jobs.lever.co/', upper({BOARD_SLUG}), '/0000abcd-0000-4000-8000-', {HEX})",
    f"concat('https://careers.c', cast(ck % 9 as {TEXT}), '.com/jobs/', cast(9000 + k as {TEXT}), "
    "'?icims=1')",
    f"concat('https://x', cast(ck % 9 as {TEXT}), '.icims.com/jobs/', cast(9000 + k as {TEXT}), "
    "'/dev/job')",
    f"concat('https://jobs.s', cast(ck % 9 as {TEXT}), '.com/job/Toronto-Dev-ON-M5J-2V5/', "
    f"cast(600000 + k as {TEXT}), '/')",
    f"concat('https://e', cast(ck % 9 as {TEXT}), '.fa.ca2.oraclecloud.com/hcmUI/"
    f"CandidateExperience/en/sites/CX_1/job/', cast(k as {TEXT}))",
    f"concat('https://www.own', cast(ck % 23 as {TEXT}), '.com/careers?gh_jid=', "
    f"cast(k as {TEXT}))",
    f"concat('https://bit.ly/s', cast(ck % 50 as {TEXT}))",
    f"concat('https://www.linkedin.com/jobs/view/', cast(k as {TEXT}))",
    "'javascript:alert(1)'",
    f"concat('https://jobs.', {BOARD_SLUG}, '.org/Apply (', cast(k as {TEXT}), ')')",
]
URL_CASE = "case k % 13 " + " ".join(f"when {i} then {u}" for i, u in enumerate(URLS)) + " end"

DATES = [
    f"cast(ts as {TEXT})", f"concat(cast(ts as {TEXT}), '000')", "'Posted 3+ Days Ago'",
    "'Yesterday'", "day", "concat(day, 'T05:30:00Z')", "'n/a'",
    "concat(day, 'T05:30:00.000-04:00')",
]
TABLE_DATES = ["'3d'", "'2w'", "'1mo'", "'5h'", "'Jul 21'", "'December 31'", "day", "''"]


def _case(key: str, parts: list[str]) -> str:
    arms = " ".join(f"when {i} then {p}" for i, p in enumerate(parts))
    return f"case {key} % {len(parts)} {arms} end"


FX = f"""
select *, {URL_CASE} as url, {_case('k', DATES)} as date_text,
  {_case('k', TABLE_DATES)} as table_date
from (
select o.o_orderkey as k, o.o_custkey as ck, o.o_orderkey as seq,
  substring(cast(o.o_orderdate as {TEXT}), 1, 10) as day,
  {{epoch}} as ts, month(o.o_orderdate) as month_no, day(o.o_orderdate) as day_no,
  year(o.o_orderdate) as year_no,
  case when o.o_orderpriority = '5-LOW'
    then concat('tracker:fx:', cast(o.o_orderkey as {TEXT}))
    else concat('greenhouse:', cast(o.o_custkey as {TEXT}), ':', cast(o.o_orderkey as {TEXT}))
    end as uid,
  concat(c.c_name, case o.o_custkey % 4 when 1 then ' Inc.' when 2 then ' & Sons'
    when 3 then ' Technologies Canada' else '' end) as company,
  {pick('o.o_orderkey', TITLES)} as title,
  {pick('(o.o_orderkey + o.o_custkey)', LOCATIONS)} as location,
  n.n_name as nation, concat(n.n_name, ' [greenhouse]') as source,
  case when o.o_orderkey % 11 = 0 then 0 else {{epoch}} end as posted_at,
  {{epoch}} + (o.o_orderkey % 5) * 3600 as first_seen,
  {{epoch}} + (o.o_orderkey % 9) * 86400 as last_seen,
  o.o_orderkey % 17 = 0 as seeded,
  cast(o.o_orderkey % 13 % 4 as int) as misses,
  case o.o_orderstatus when 'O' then 'strict' when 'F' then 'loose'
    else case when o.o_orderkey % 2 = 0 then 'other' end end as tier,
  case o.o_orderstatus when 'O' then 'AI in description'
    when 'F' then case when o.o_orderkey % 3 = 0 then 'later cycle' else 'no AI signal' end
    else case when o.o_orderkey % 2 = 0 then 'not tech' when o.o_orderkey % 3 = 0
      then 'no Canadian location' else 'not student level' end end as reason,
  concat('g', cast(o.o_custkey % 97 as {TEXT}), '-', cast(o.o_orderkey % 7 as {TEXT}))
    as group_id,
  o.o_orderkey % 3 = 0 as notified, o.o_orderkey % 4 = 0 as digested,
  {pick('o.o_custkey', TERMS)} as cycle_extra_s,
  {pick('(o.o_custkey + 1)', LEVELS)} as employment_type,
  case when o.o_custkey % 10 = 0 then 'Canada' else '' end as country,
  case when o.o_orderkey % 8 = 0 then 'Toronto' else '' end as loc_extra_s,
  o.o_custkey % 31 = 0 as ai_native,
  case when o.o_orderkey % 6 = 0 then 'Summer 2027' else '' end as term,
  case when o.o_orderkey % 6 = 1 then 'PyTorch, LLMs' else '' end as ai_terms
from {{orders}} o join {{customer}} c on c.c_custkey = o.o_custkey
join {{nation}} n on n.n_nationkey = c.c_nationkey) base
"""
SPARK_EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o.o_orderdate)"
DUCK_EPOCH = "cast(epoch(o.o_orderdate) as bigint)"
FX_DUCK = FX.replace("{epoch}", DUCK_EPOCH).replace("{orders}", "orders").replace(
    "{customer}", "customer").replace("{nation}", "nation")


def duck(sql: str, **ctes: str) -> str:
    """A DuckDB statement over the derived postings ``fx``."""
    more = "".join(f", {name} as ({body})" for name, body in ctes.items())
    return f"with fx as ({FX_DUCK}){more} {sql}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out to all of them.

    A small file is one split, and so one task; a table of many files is left
    as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def fx(spark: SparkSession, folder: str) -> DataFrame:
    names = ("customer", "nation")
    orders = spread(table(spark, folder, "orders"), "o_orderkey")
    return spark.sql(FX.replace("{epoch}", SPARK_EPOCH), orders=orders,
                     **{n: table(spark, folder, n) for n in names})


def postings(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """The derived rows as postings."""
    rows = fx(spark, folder).withColumns({
        "loc_extra": F.array("loc_extra_s"), "cycle_extra": F.array("cycle_extra_s"),
        "short_url": F.lit(""), "inline_description": F.lit("")})
    return rows.select(*POSTING_COLUMNS, "seq", *extra)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The derived rows as the jobs table."""
    rows = fx(spark, folder).withColumn(
        "fingerprint", fingerprint(F.col("company"), F.col("title")))
    return rows.select(*JOBS_COLUMNS)


def landed(df: DataFrame, platform: str, token: str | Column, record: Column, shape: str = "{}",
           page: Column | None = None, country: str = "", source: str = "Acme",
           per_page: int = 25) -> DataFrame:
    """Landing rows whose bodies hold up to ``per_page`` of ``df``'s rows each.

    ``shape`` is the JSON around the array; the page is a range of keys, so no
    body grows with the data.
    """
    page = F.floor(F.col("k") / per_page) if page is None else page
    pages = df.select(page.cast("int").alias("page_seq"),
                      F.struct("k", record.alias("r")).alias("e")).groupBy("page_seq").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["r"])).alias("a"))
    before, after = shape.split("{}")
    return pages.select(
        F.lit(f"{source} [{platform}]").alias("source"), F.lit(platform).alias("platform"),
        (F.lit(token) if isinstance(token, str) else token).alias("token"),
        F.lit(source).alias("company"), F.lit(country).alias("country"),
        F.lit(AS_OF).cast("bigint").alias("fetched_at"), "page_seq",
        (F.col("page_seq") % 7 != 0).alias("complete"),
        F.concat(F.lit(before), "a", F.lit(after)).alias("body"))


def landed_markup(df: DataFrame, platform: str, token: str, block: Column, before: str = "",
                  after: str = "", per_page: int = 25, source: str = "Acme") -> DataFrame:
    """Landing rows whose bodies are blocks of markup, one per row of ``df``."""
    page = F.floor(F.col("k") / per_page).cast("int").alias("page_seq")
    pages = df.select(page, F.struct("k", block.alias("b")).alias("e")).groupBy("page_seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["b"]), "\n")
        .alias("b"))
    return pages.select(
        F.lit(f"{source} [{platform}]").alias("source"), F.lit(platform).alias("platform"),
        F.lit(token).alias("token"), F.lit(source).alias("company"), F.lit("").alias("country"),
        F.lit(AS_OF).cast("bigint").alias("fetched_at"), "page_seq", F.lit(True).alias("complete"),
        F.concat(F.lit(before), "b", F.lit(after)).alias("body"))


LANDED_COLUMNS = [part.split()[0] for part in LANDED_SCHEMA.split(", ")]


def listing_view(rows: DataFrame) -> DataFrame:
    """Listing rows with their arrays as text, for comparison."""
    return rows.select(
        "uid", "company", "title", "location", "url", "source", "posted_at", "country",
        "employment_type", F.array_join("loc_extra", " | ").alias("places"),
        F.array_join("cycle_extra", " | ").alias("terms"))
