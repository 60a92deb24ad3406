"""Queries over enrichment, roles and state updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsluice.catalog import duck as d
from jobsluice.catalog.fixtures import (
    AS_OF, AS_OF_2026, DAY, TEXT, duck, fx, jobs, postings, table)
from jobsluice.catalog.registry import query
from jobsluice.functions.identity import role_keys
from jobsluice.operators import enrich, roles, state
from jobsluice.operators import triage as triage_ops
from jobsluice.session import materialise
from jobsluice.settings import DEFAULT, Settings

C, L = F.col, F.lit
WEEK = DEFAULT.max_age_hours * 3600
SHOWN = "coalesce(nullif(posted_at, 0), first_seen)"


# --- enrichment ------------------------------------------------------------------------------

def sources(spark, folder):
    """One greenhouse source per nation; some AI-native, with a place, or for one country."""
    key = C("n_nationkey")
    return table(spark, folder, "nation").select(
        F.concat("n_name", L(" [greenhouse]")).alias("label"), C("n_name").alias("name"),
        L("greenhouse").alias("platform"), F.lower("n_name").alias("token"),
        L("board").alias("kind"), (key % 5 == 0).alias("ai_native"),
        F.when(key % 3 == 0, "Markham, ON").otherwise("").alias("location"),
        F.when(key % 4 == 0, "Canada").otherwise("").alias("country"))


SRC = """select concat(n_name, ' [greenhouse]') as label, n_name, n_nationkey % 5 = 0 as native,
    case when n_nationkey % 3 = 0 then 'Markham, ON' else '' end as place,
    case when n_nationkey % 4 = 0 then 'Canada' else '' end as land from nation"""


@query("default_location", duck(f"""
    select k, case when place <> '' and {d.scope('location')} = 'unknown' then place
      else location end as location from fx left join src on src.label = fx.source""", src=SRC))
def default_location(spark, folder):
    return enrich.fill_default_location(
        postings(spark, folder, "k"), sources(spark, folder)).select("k", "location")


@query("stamp_country", duck("""
    select k, case when country <> '' then country else land end as country
    from fx left join src on src.label = fx.source""", src=SRC))
def stamp_country(spark, folder):
    return enrich.stamp_country(
        postings(spark, folder, "k"), sources(spark, folder)).select("k", "country")


@query("ai_native", duck(f"""
    select k, ai_native or native or {d.norm_company('company')} in (
        select {d.norm_company("concat(c_name, ' Ltd')")} from customer where c_custkey % 7 = 0)
      as ai_native from fx left join src on src.label = fx.source""", src=SRC))
def ai_native(spark, folder):
    owners = table(spark, folder, "customer").where("c_custkey % 7 = 0").select(
        F.concat("c_name", L(" [own]")).alias("label"),
        F.concat("c_name", L(" Ltd")).alias("name"), L("lever").alias("platform"),
        F.lower("c_name").alias("token"), L("board").alias("kind"), L(True).alias("ai_native"),
        L("").alias("location"), L("").alias("country"))
    every = sources(spark, folder).unionByName(owners)
    return enrich.flag_ai_native(postings(spark, folder, "k"), every).select("k", "ai_native")


BOARDS = f"""select *, row_number() over (partition by key order by origin, pos) as copy from (
    select c_custkey as pos, 0 as origin, concat('Co', cast(c_custkey % 60 as {TEXT})) as name,
      case c_custkey % 3 when 0 then 'lever' when 1 then 'workday' else 'successfactors' end
        as platform,
      case c_custkey % 3 when 1 then concat('https://w/', cast(c_custkey % 500 as {TEXT}), '/jobs/')
        when 2 then concat('https://s/search/?q=term', cast(c_custkey % 400 as {TEXT}), '&l=x')
        else concat('Tok', cast(c_custkey % 300 as {TEXT})) end as token from customer
    union all select s_suppkey, 1, concat('Co', cast(s_suppkey % 60 as {TEXT})), 'lever',
      concat('TOK', cast(s_suppkey % 400 as {TEXT}), '/') from supplier) b,
    lateral (select concat(platform, ' ', lower(regexp_replace(token, '/+$', ''))) as key) x"""


@query("all_sources", f"""
    with boards as ({BOARDS}), one as (select *, row_number() over (
      partition by name, platform order by origin, pos) as nth from boards where copy = 1)
    select platform, token, concat(name, ' [', platform, case when nth = 1 then '' else
      concat(':', case platform when 'lever' then regexp_replace(token, '/+$', '')
        when 'workday' then split_part(token, '/', 4)
        else regexp_extract(token, 'q=([^&]*)', 1) end) end, ']') as label from one""")
def all_sources(spark, folder):
    number = C("c_custkey")
    kind = number % 3
    curated = table(spark, folder, "customer").select(
        number.alias("pos"), F.concat(L("Co"), (number % 60).cast("string")).alias("name"),
        F.when(kind == 0, "lever").when(kind == 1, "workday").otherwise("successfactors")
        .alias("platform"),
        F.when(kind == 1, F.concat(L("https://w/"), (number % 500).cast("string"), L("/jobs/")))
        .when(kind == 2, F.concat(L("https://s/search/?q=term"), (number % 400).cast("string"),
                                  L("&l=x")))
        .otherwise(F.concat(L("Tok"), (number % 300).cast("string"))).alias("token"))
    promoted = table(spark, folder, "supplier").select(
        C("s_suppkey").alias("pos"),
        F.concat(L("Co"), (C("s_suppkey") % 60).cast("string")).alias("name"),
        L("lever").alias("platform"),
        F.concat(L("TOK"), (C("s_suppkey") % 400).cast("string"), L("/")).alias("token"))
    return enrich.union_sources(curated, promoted).select("platform", "token", "label")


@query("new_uids", duck("""
    select uid, min(seq) as seq from (select *, case when k % 10 = 9 then '' else
      concat('u', cast(k % 997 as varchar)) end as u from fx) t
    where u <> '' and u not in (select concat('u', cast(k as varchar)) from fx where k % 5 = 0)
      and k % 13 <> 0 group by u""".replace("select uid,", "select u as uid,")))
def new_uids(spark, folder):
    rows = postings(spark, folder, "k").withColumns({
        "uid": F.when(C("k") % 10 == 9, "").otherwise(
            F.concat(L("u"), (C("k") % 997).cast("string"))),
        "title": F.when(C("k") % 13 == 0, "").otherwise(C("title"))})
    stored = fx(spark, folder).where(C("k") % 5 == 0).select(
        F.concat(L("u"), C("k").cast("string")).alias("uid"))
    return enrich.drop_known_uids(rows, stored).select("uid", "seq")


@query("desc_unread", duck("select uid from fx where k % 4 <> 0"))
def desc_unread(spark, folder):
    read = fx(spark, folder).where(C("k") % 4 == 0).select("uid")
    return enrich.drop_read_descriptions(fx(spark, folder).select("uid"), read)


@query("boards_unknown", duck(f"""
    select distinct platform, token from (select {d.board('url')[0]} as platform,
      {d.board('url')[1]} as token from fx) t
    where platform is not null and not (platform in ('lever', 'greenhouse')
      and lower(token) in (select concat('b', cast(c_custkey as varchar)) from customer
        where c_custkey % 2 = 0))"""))
def boards_unknown(spark, folder):
    from jobsluice.functions.boards import with_board
    found = with_board(fx(spark, folder)).select("platform", "token").distinct()
    known = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(
        F.explode(F.array(L("lever"), L("greenhouse"))).alias("platform"),
        F.concat(L("B"), C("c_custkey").cast("string"), L("/")).alias("token"))
    return enrich.drop_configured_boards(found, known)


# --- roles ------------------------------------------------------------------------------------

# Postings in blocks of six: rows 0-2 and 3-5 share a title each; in even blocks rows 2 and 3
# link the same requisition, which makes the block one role. Every fourth block was met before.
BLOCK = "k // 6"
ROLE = """case when (k // 6) % 2 = 0 then (k // 6) * 6 when k % 6 < 3 then (k // 6) * 6
    else (k // 6) * 6 + 3 end"""
GROUP = f"""case when (k // 6) % 4 = 0 or ((k // 6) % 4 = 1 and k % 6 < 3)
    then concat('old', cast({BLOCK} as varchar)) else concat('u', cast({ROLE} as varchar)) end"""


def _blocks(spark, folder):
    return materialise(_block_rows(spark, folder), "blocks")


def _block_rows(spark, folder):
    k = C("k")
    block, half = F.floor(k / 6), F.floor(k % 6 / 3)
    shared = (block % 2 == 0) & (k % 6).isin(2, 3)
    rows = postings(spark, folder, "k")
    return rows.withColumns({
        "uid": F.concat(L("u"), k.cast("string")),
        "company": F.concat(L("Block "), block.cast("string"), F.when(k % 2 == 0, " Inc").otherwise("")),
        "title": F.when(half == 0, "Data Intern").otherwise("Web Student"),
        "url": F.concat(L("https://jobs.acme.com/jobs/"), F.when(
            shared, (10_000_000 + block).cast("string")).otherwise((20_000_000 + k).cast("string"))),
        "seq": k,
    })


def _stored_keys(blocks):
    """Keys of the first half of every block whose number is 0 or 1 modulo 4."""
    first = blocks.where((C("k") % 6 == 0) & (F.floor(C("k") / 6) % 4).isin(0, 1))
    keys = role_keys(C("company"), C("title"), C("url"))
    return first.select(
        F.explode(F.array_compact(F.slice(keys, 1, 1))).alias("key"),
        F.concat(L("old"), F.floor(C("k") / 6).cast("string")).alias("group_id"),
        F.lit(AS_OF - 9 * DAY).cast("bigint").alias("since"))


@query("assign_groups", duck(
    f"select concat('u', cast(k as varchar)) as uid, {GROUP} as group_id from fx"))
def assign_groups(spark, folder):
    rows = _blocks(spark, folder)
    groups = roles.assign_groups(rows, _stored_keys(rows), AS_OF)
    return groups.rows.select("uid", "group_id")


def _old_jobs(spark, folder):
    """A stored table: two rows per pair of postings, one under a short link."""
    k = C("k")
    pair = F.floor(k / 2)
    rows = jobs(spark, folder).join(fx(spark, folder).select("uid", "k"), "uid").withColumns({
        "group_id": F.concat(L("p"), k.cast("string")),
        "company": F.concat(L("Pair "), pair.cast("string")),
        "title": F.when(k % 2 == 0, "Data Intern").otherwise("Web Student"),
        "first_seen": (L(AS_OF - 90 * DAY) + k).cast("bigint"),
        "url": F.when(k % 2 == 0, F.concat(L("https://jobs.acme.com/jobs/"),
                                           (10_000_000 + pair).cast("string")))
        .otherwise(F.concat(L("https://bit.ly/z"), k.cast("string")))})
    return materialise(rows, "old-jobs")


@query("refresh_url", duck("""
    select uid, case when k % 2 = 1 and (k // 2) % 3 <> 2 then
        concat('https://jobs.acme.com/jobs/', cast(10000000 + k // 2 as varchar))
      when k % 2 = 0 then concat('https://jobs.acme.com/jobs/', cast(10000000 + k // 2 as varchar))
      else concat('https://bit.ly/z', cast(k as varchar)) end as url,
      concat('p', cast(case when k % 2 = 1 and (k // 2) % 3 <> 2 then k - 1 else k end as varchar))
        as group_id from fx"""))
def refresh_url(spark, folder):
    stored = _old_jobs(spark, folder)
    keys = role_keys(C("company"), C("title"), C("url"))
    known = stored.select(F.explode(keys).alias("key"), "group_id", C("first_seen").alias("since"))
    seen = stored.where((C("k") % 2 == 1) & (F.floor(C("k") / 2) % 3 != 2)).select(
        "uid", "company", "title", C("url").alias("short_url"), F.concat(
            L("https://jobs.acme.com/jobs/"),
            (10_000_000 + F.floor(C("k") / 2)).cast("string")).alias("url"))
    return roles.refresh_url(stored.drop("k"), seen, known, AS_OF).rows.select(
        "uid", "url", "group_id")


def _sent(by: str, of: str) -> str:
    return f"""select c.k, case when c.cand = 'strict' then coalesce(s.strict_sent, false)
        else coalesce(s.kept, false) end as delivered
      from (select k, {of} as g, case when k % 2 = 0 then 'strict' else 'loose' end as cand from fx) c
      left join (select {by} as g, bool_or(tier = 'strict' and notified and tier is not null)
          as strict_sent, bool_or(tier is not null) as kept
        from fx where k % 5 < 2 group by {by}) s on s.g = c.g"""


@query("delivered", duck(_sent("group_id", "group_id")))
def delivered(spark, folder):
    rows = fx(spark, folder)
    stored = rows.where(C("k") % 5 < 2)
    cand = rows.withColumn("tier", F.when(C("k") % 2 == 0, "strict").otherwise("loose"))
    return roles.delivered(cand.select("k", "uid", "group_id", "tier"), stored).select(
        "k", "delivered")


_FP = d.fingerprint("company", "title")


@query("fp_delivered", duck(_sent(_FP, _FP)))
def fp_delivered(spark, folder):
    stored = jobs(spark, folder).join(fx(spark, folder).where(C("k") % 5 < 2).select("uid"), "uid")
    cand = jobs(spark, folder).join(fx(spark, folder).select("uid", "k"), "uid").select(
        "k", "uid", "fingerprint", F.when(C("k") % 2 == 0, "strict").otherwise("loose")
        .alias("tier"))
    return roles.fingerprint_delivered(cand, stored).select("k", "delivered")


# --- triage -------------------------------------------------------------------------------------

# Titles by block so that classification and roles are both known.
TRIAGE_TITLES = ["Machine Learning Intern", "Software Developer Co-op",
                 "Marketing Coordinator Intern", "Senior Director"]


def _arrivals(spark, folder):
    return materialise(_arrival_rows(spark, folder), "arrivals")


def _arrival_rows(spark, folder):
    """Blocks of six postings of one requisition each, with tiers dealt by position."""
    k = C("k")
    block = F.floor(k / 6)
    title = F.element_at(F.array(*[L(t) for t in TRIAGE_TITLES]),
                         (F.pmod(k * 7 + block, L(4)) + 1).cast("int"))
    return postings(spark, folder, "k").withColumns({
        "uid": F.concat(L("u"), k.cast("string")),
        "company": F.concat(L("Block "), block.cast("string")),
        "title": title, "location": L("Toronto, ON"), "ai_native": L(False),
        "loc_extra": F.array().cast("array<string>"), "cycle_extra": F.array().cast("array<string>"),
        "employment_type": L(""), "country": L(""),
        "url": F.concat(L("https://jobs.acme.com/jobs/"), (10_000_000 + block).cast("string"))})


def _met_before(arrivals):
    """Blocks met before: every third kept as loose, every sixth as a notified strict role."""
    first = arrivals.where((C("k") % 6 == 0) & (F.floor(C("k") / 6) % 3 == 0))
    strict = F.floor(C("k") / 6) % 6 == 0
    stored = first.select(
        F.concat(L("old"), C("k").cast("string")).alias("uid"), L("f").alias("fingerprint"),
        "company", L("Some Intern").alias("title"), "location", "url", "source",
        F.when(strict, "strict").otherwise("loose").alias("tier"), L("x").alias("reason"),
        L(AS_OF - DAY).cast("bigint").alias("first_seen"), L(0).cast("bigint").alias("posted_at"),
        L(False).alias("seeded"), strict.alias("notified"), L(False).alias("digested"),
        F.concat(L("g"), F.floor(C("k") / 6).cast("string")).alias("group_id"),
        L(AS_OF - DAY).cast("bigint").alias("last_seen"), L(0).alias("misses"), L("").alias("term"),
        L("").alias("ai_terms"))
    # Every fiftieth posting itself is stored as well, and so skipped.
    seen = stored.limit(0).unionByName(arrivals.where(C("k") % 50 == 49).select(
        "uid", L("f").alias("fingerprint"), "company", "title", "location", "url", "source",
        L(None).cast("string").alias("tier"), L("y").alias("reason"),
        L(AS_OF - DAY).cast("bigint").alias("first_seen"), L(0).cast("bigint").alias("posted_at"),
        L(False).alias("seeded"), L(False).alias("notified"), L(False).alias("digested"),
        C("uid").alias("group_id"), L(AS_OF - DAY).cast("bigint").alias("last_seen"),
        L(0).alias("misses"), L("").alias("term"), L("").alias("ai_terms")))
    keys = role_keys(C("company"), C("title"), C("url"))
    known = stored.select(F.explode(keys).alias("key"), "group_id",
                          C("first_seen").alias("since")).distinct()
    return stored.unionByName(seen), known


_POS = "(k * 7 + k // 6) % 4"
TRIAGED = f"""
    select k, concat('u', cast(k as varchar)) as uid, k // 6 as block,
      case {_POS} when 0 then 'strict' when 1 then 'loose' when 2 then 'other' end as new_tier,
      (k // 6) % 3 = 0 as kept_before, (k // 6) % 6 = 0 as strict_before
    from fx where k % 50 <> 49"""
DUPES = """
    select *, case when new_tier = 'strict' then strict_before or strict_earlier > 0
      when new_tier is not null then kept_before or kept_earlier > 0 else false end as duplicate
    from (select *, coalesce(sum(case when new_tier is not null then 1 else 0 end) over w, 0)
        as kept_earlier,
      coalesce(sum(case when new_tier = 'strict' then 1 else 0 end) over w, 0) as strict_earlier
      from triaged window w as (partition by block order by k
        rows between unbounded preceding and 1 preceding)) t"""
FIRST = """select *, case when kept_before then concat('g', cast(block as varchar))
    else concat('u', cast(min(k) over (partition by block) as varchar)) end as group_id from dupes"""


@query("triage", duck("select uid, new_tier as tier, group_id, duplicate from firsts",
                      triaged=TRIAGED, dupes=DUPES, firsts=FIRST))
def triage(spark, folder):
    arrivals = _arrivals(spark, folder)
    stored, known = _met_before(arrivals)
    result = triage_ops.triage(arrivals, stored, known, AS_OF_2026)
    return result.triaged.select("uid", "verdict.tier", "group_id", "duplicate")


@query("run_summary", duck(f"""
    select (select cast(count(*) as bigint) from fx) as fetched,
      (select cast(count(*) as bigint) from fx) - cast(count(*) filter (
        not duplicate) as bigint) as skipped,
      cast(count(*) filter (new_tier = 'strict' and not duplicate) as bigint) as strict,
      cast(count(*) filter (new_tier = 'loose' and not duplicate) as bigint) as loose,
      cast(count(*) filter (new_tier = 'strict' and not duplicate and fx.posted_at <> 0
        and fx.posted_at < {AS_OF_2026 - WEEK}) as bigint) as stale
    from dupes join fx using (k)""", triaged=TRIAGED, dupes=DUPES))
def run_summary(spark, folder):
    arrivals = _arrivals(spark, folder)
    stored, known = _met_before(arrivals)
    result = triage_ops.triage(arrivals, stored, known, AS_OF_2026)
    return triage_ops.run_summary(result.triaged, arrivals, AS_OF_2026)


@query("preview", duck(f"""
    select cast(count(*) as bigint) as postings,
      cast(count(*) filter (t = 0 and first_strict and fresh) as bigint) as strict,
      cast(count(*) filter (t = 0 and first_strict and not fresh) as bigint) as stale,
      cast(count(*) filter (t = 0 and not first_strict) as bigint) as duplicates,
      cast(count(*) filter (t = 1) as bigint) as loose,
      cast(count(*) filter (t = 2) as bigint) as other
    from (select k, {_POS} as t, posted_at = 0 or posted_at >= {AS_OF - WEEK} as fresh,
      k = min(k) over (partition by k // 6, {_POS}) as first_strict from fx) s"""))
def preview(spark, folder):
    from jobsluice.functions.classify import classify
    judged = classify(_arrivals(spark, folder), AS_OF_2026)
    return roles.preview(judged, AS_OF - WEEK)


@query("record", duck("""
    select uid, first_seen, term from (
      select uid, first_seen, term, k from fx where k % 3 = 0
      union all select uid, 996624000, cast(null as varchar), k from fx where k % 3 <> 0) t
    where k is not null""".replace("cast(null as varchar)", d.term_label("cycles").replace(
        "cycles", d.cycles(f"concat(title, ' | ', {d.TERMS})", AS_OF)))))
def record(spark, folder):
    old = jobs(spark, folder).join(
        fx(spark, folder).where(C("k") % 3 == 0).select("uid"), "uid", "left_semi")
    return state.record_postings(old, _fresh_rows(spark, folder, False)).select(
        "uid", "first_seen", "term")


def _fresh_rows(spark, folder, seeded):
    verdict = F.struct(L("loose").alias("tier"), L("no AI signal").alias("reason"),
                       F.array(L("PyTorch"), L("LLMs")).alias("ai_terms"))
    rows = postings(spark, folder, "group_id").withColumns({
        "verdict": verdict, "notified": L(seeded), "digested": L(seeded), "seeded": L(seeded)})
    return state.job_rows(rows, AS_OF)


@query("seed", duck("""
    select uid, seeded, notified, digested, ai_terms from fx where k % 3 = 0
    union all select uid, true, true, true, 'PyTorch, LLMs' from fx where k % 3 <> 0"""))
def seed(spark, folder):
    old = jobs(spark, folder).join(
        fx(spark, folder).where(C("k") % 3 == 0).select("uid"), "uid", "left_semi")
    verdict = F.struct(L("loose").alias("tier"), L("no AI signal").alias("reason"),
                       F.array(L("PyTorch"), L("LLMs")).alias("ai_terms"))
    rows = postings(spark, folder, "group_id").withColumn("verdict", verdict)
    return state.seed(old, rows, AS_OF).select(
        "uid", "seeded", "notified", "digested", "ai_terms")


@query("mark_flags", duck("""
    select uid, notified or (tier = 'strict' and k % 2 = 0 and tier is not null) as notified,
      digested or (tier = 'loose' and tier is not null) as digested from fx""".replace(
    "notified or (", "coalesce(notified or (").replace("is not null) as n", "is not null), false) as n")
    .replace("digested or (", "coalesce(digested or (").replace(
        "is not null) as d", "is not null), false) as d")))
def mark_flags(spark, folder):
    rows = jobs(spark, folder)
    even = fx(spark, folder).where((C("tier") == "strict") & (C("k") % 2 == 0)).select("uid")
    marked = state.mark_digested(state.mark_notified(rows, even),
                                 rows.where(C("tier") == "loose").select("uid"))
    return marked.select("uid", "notified", "digested")


@query("presence", duck("""
    select uid, case when listed is not null then greatest(last_seen, listed) else last_seen end
        as last_seen,
      cast(case when listed is not null then 0 else misses end + case when no % 4 = 0 then 0 else
        (select count(*) from (values (996624000), (996710400), (996796800)) s(stamp)
          where s.stamp > greatest(last_seen, coalesce(listed, last_seen))) end as int) as misses
    from (select *, cast(regexp_extract(nation, '([0-9]+)', 1) as int) as no,
      case when cast(regexp_extract(nation, '([0-9]+)', 1) as int) % 4 = 0 or k % 7 = 0 then null
        when (k + 2) % 3 <> 0 then 996796800 else 996710400 end as listed from fx) t"""))
def presence(spark, folder):
    """Three listings per source; each leaves out a third of its rows, and a seventh always."""
    rows = fx(spark, folder)
    runs = F.array(*[F.struct(L(n).alias("n"), L(AS_OF + n * DAY).alias("stamp"))
                     for n in range(3)])
    listed = rows.select("*", F.inline(runs)).where(
        ((C("k") + C("n")) % 3 != 0) & (C("k") % 7 != 0))
    number = F.regexp_extract("nation", r"(\d+)", 1).cast("int")
    listing = listed.select("source", "uid", C("stamp").cast("bigint").alias("stamp"),
                            (number % 4 != 0).alias("complete"))
    return state.mark_present(jobs(spark, folder), listing).select("uid", "last_seen", "misses")


@query("demote", duck("""
    select fx.uid, case when moved then new_tier else fx.tier end as tier,
      case when moved then why else fx.reason end as reason
    from fx left join (select j.uid, j.new_tier, j.why, coalesce(j.tier in ('strict', 'loose')
        and j.why in ('earlier cycle', 'later cycle', 'cycle already passed')
        and case j.new_tier when 'strict' then 3 when 'loose' then 2 when 'other' then 1 else 0 end
          < case j.tier when 'strict' then 3 when 'loose' then 2 else 0 end, false) as moved
      from judged j) m using (uid)""", **d.classified()))
def demote(spark, folder):
    lowered = state.demote_for_cycle(jobs(spark, folder), postings(spark, folder), AS_OF_2026)
    return lowered.select("uid", "tier", "reason")


# --- descriptions --------------------------------------------------------------------------------

DESCRIBED_TEXT = ["Train models in PyTorch with CUDA and MLOps.", "An AI powered team.",
                  "LLMs: LLM agents, LLM features, LLM pipelines and LLM systems."]


def _described(spark, folder):
    k = C("k")
    return fx(spark, folder).where(k % 3 != 2).select(
        "uid", F.element_at(F.array(*[L(t) for t in DESCRIBED_TEXT]), (k % 3 + 1).cast("int"))
        .alias("text"),
        F.when(k % 2 == 0, "Toronto, ON").otherwise("").alias("place"),
        F.when(k % 4 == 0, C("ts")).otherwise(0).cast("bigint").alias("posted"))


@query("desc_upsert", duck("""
    select uid, cast(case when k % 3 = 0 then 3 when k % 3 = 1 then 0 else 7 end as int) as score,
      case when k % 3 = 0 then 'PyTorch, MLOps, CUDA' when k % 3 = 1 then '' else 'old' end as terms,
      cast(case when k % 3 <> 2 then 996624000 else 5 end as bigint) as checked_at from fx"""))
def desc_upsert(spark, folder):
    old = fx(spark, folder).select(
        "uid", L(5).cast("bigint").alias("checked_at"), L(7).alias("score"), L("old").alias("terms"),
        L(None).cast("string").alias("error"))
    found = _described(spark, folder).withColumn("error", L(None).cast("string"))
    # "Train models" counts as model training.
    read = state.read_descriptions(
        found.withColumn("text", F.regexp_replace("text", "Train models in", "Use")), AS_OF)
    return state.record_descriptions(old, read).select("uid", "score", "terms", "checked_at")


@query("desc_requeue", duck(f"""
    select uid from fx where not coalesce(tier = 'loose' and reason = 'no AI signal'
      and {SHOWN} >= {AS_OF - WEEK}, false)"""))
def desc_requeue(spark, folder):
    read = fx(spark, folder).select("uid")
    return state.requeue_descriptions(read, jobs(spark, folder), AS_OF)


@query("desc_rules", duck(f"""
    select uid, 'as before' as rules from fx union all
    select uid, 'changed' from fx where not coalesce(tier = 'loose' and reason = 'no AI signal'
      and {SHOWN} >= {AS_OF - WEEK}, false)"""))
def desc_rules(spark, folder):
    """Reads that a run keeps under the rules of the run before, and under rules that changed."""
    read, rows = fx(spark, folder).select("uid"), jobs(spark, folder)
    none = spark.createDataFrame([], state.RULES_SCHEMA)
    kept, rules = state.requeue_for_rules(read, rows, none, AS_OF, Settings(desc_min_terms=9))
    kept, rules = state.requeue_for_rules(read, rows, rules, AS_OF)
    same, _ = state.requeue_for_rules(read, rows, rules, AS_OF)
    return same.withColumn("rules", L("as before")).unionByName(
        kept.withColumn("rules", L("changed")))


OPEN_DESC = f"""((tier = 'loose' and reason = 'no AI signal')
    or (tier is null and reason = 'no Canadian location')) and {SHOWN} >= {AS_OF - WEEK}"""


@query("desc_backlog", duck(f"""
    select uid, {SHOWN} as shown_at from fx where {OPEN_DESC} and k % 5 <> 0
    order by shown_at desc, uid limit 150"""))
def desc_backlog(spark, folder):
    read = fx(spark, folder).where(C("k") % 5 == 0).select("uid")
    return state.description_backlog(jobs(spark, folder), read, 150, AS_OF).select(
        "uid", state.shown_at().alias("shown_at"))


@query("reclassify", duck("""
    select uid, case when asks and k % 3 = 0 and k % 2 = 1 and why = 'no AI signal'
        then 'AI in description'
      when asks and k % 3 <> 2 and k % 2 = 0 and scope_known then 'moved' else 'same' end as outcome
    from (select *, (new_tier = 'loose' and why = 'no AI signal') or
      (new_tier is null and why = 'no Canadian location') as asks, false as scope_known
      from judged) t where k % 2 = 1 and k % 3 = 0 and why = 'no AI signal'
      and cycle_now in ('unknown', 'target') and level = 'intern'""", **d.classified()))
def reclassify(spark, folder):
    """Loose rows with no AI word whose description names enough terms become strict."""
    rows = postings(spark, folder, "k")
    judged = triage_ops.judge(rows, AS_OF_2026, DEFAULT, _described(spark, folder))
    return judged.where((C("k") % 2 == 1)
                        & (C("verdict.reason") == "AI in description")).select(
        "uid", C("verdict.reason").alias("outcome"))


@query("backfill", duck("""
    select uid, case when promoted then 'strict' else tier end as tier,
      case when promoted then 'AI in description' else reason end as reason,
      location from (select *, coalesce(((tier = 'loose' and reason = 'no AI signal')
        or (tier is null and reason = 'no Canadian location')) and coalesce(nullif(posted_at, 0), first_seen) >= 996019200 and k % 3 = 0, false)
        as promoted from (select *, 'Toronto, ON' as place0 from fx) f) t""".replace(
    "location from", "'Toronto, ON' as location from")))
def backfill(spark, folder):
    rows = jobs(spark, folder).withColumns({
        "title": L("Software Developer Co-op"), "location": L("Toronto, ON")})
    none = fx(spark, folder).limit(0).select("uid")
    found = _described(spark, folder).join(
        fx(spark, folder).where(C("k") % 3 == 0).select("uid"), "uid", "left_semi")
    filled = state.backfill(rows, none, found, AS_OF)
    return filled.select("uid", "tier", "reason", "location")
