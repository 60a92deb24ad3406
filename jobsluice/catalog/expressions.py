"""Queries over the column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsluice.catalog import duck as d
from jobsluice.catalog.fixtures import (
    AS_OF, AS_OF_2026, DAY, MONTHS, duck, fx, pick, postings, quote, spread, table)
from jobsluice.catalog.registry import query
from jobsluice.functions import (
    boards, clean, cycles, dates, describe, identity, places, render, vocab)
from jobsluice.functions import classify as rules
from jobsluice.settings import DEFAULT

C = F.col

# --- cleaning ---------------------------------------------------------------------------

@query("fn_clean", duck("""
    select k, trim(title) as cleaned,
      concat(title, case when location <> '' then ', ' || location else '' end) as listed,
      case when employment_type <> '' then employment_type when location <> '' then location
        else title end as labelled from fx"""))
def fn_clean(spark, folder):
    rows = fx(spark, folder)
    record = F.struct(C("employment_type").alias("name"), C("location").alias("city"), "title")
    return rows.select(
        "k", clean.clean_str(F.concat(F.lit(" \t"), "title", F.lit("\n "))).alias("cleaned"),
        clean.clean_list(F.array("title", "location", F.lit(""))).alias("listed"),
        clean.first_label(record, ["name", "city", "title"]).alias("labelled"))


@query("fn_join", duck("""
    select k, array_to_string(list_filter([location, loc_extra_s, country, location],
      lambda x, i: x <> '' and list_position([location, loc_extra_s, country, location], x) = i),
      ', ') as joined from fx"""))
def fn_join(spark, folder):
    return fx(spark, folder).select("k", clean.join_distinct(
        C("location"), C("loc_extra_s"), C("country"), C("location")).alias("joined"))


DATE_SQL = f"""case k % 8 when 0 then case when ts > {dates.EARLIEST} then ts else 0 end
    when 1 then case when ts > {dates.EARLIEST} then ts else 0 end
    when 2 then {AS_OF} - 3 * {DAY} when 3 then {AS_OF} - {DAY} when 4 then ts
    when 5 then ts + 19800 when 6 then 0 else ts + 19800 + 14400 end"""


@query("fn_parse_date", duck(f"select k, cast({DATE_SQL} as bigint) as parsed from fx"))
def fn_parse_date(spark, folder):
    return fx(spark, folder).select("k", dates.parse_date(C("date_text"), AS_OF).alias("parsed"))


@query("fn_first_date", duck(f"""
    select k, case when {DATE_SQL} = 0 then ts else cast({DATE_SQL} as bigint) end as parsed
    from fx"""))
def fn_first_date(spark, folder):
    return fx(spark, folder).select("k", dates.first_date(
        F.lit(None).cast("string"), C("date_text"), C("day"), as_of=AS_OF).alias("parsed"))


@query("fn_table_date", duck(f"""
    select k, cast(case k % 8 when 0 then {AS_OF} - 3 * {DAY} when 1 then {AS_OF} - 14 * {DAY}
      when 2 then {AS_OF} - 30 * {DAY} when 3 then {AS_OF} - 5 * 3600
      when 4 then epoch(timestamp '2001-07-21 00:00:00')
      when 5 then epoch(timestamp '2000-12-31 00:00:00') when 6 then ts else 0 end as bigint)
      as parsed from fx"""))
def fn_table_date(spark, folder):
    return fx(spark, folder).select(
        "k", dates.parse_table_date(C("table_date"), AS_OF).alias("parsed"))


@query("fn_provider_date", duck(
    "select k, ts as long_date, ts as short_date, ts + 57900 as clock_date from fx"))
def fn_provider_date(spark, folder):
    rows = fx(spark, folder).withColumn(
        "month_name", F.expr(pick("(month_no - 1)", MONTHS)))
    return rows.select(
        "k", dates.long_date(F.concat_ws(" ", "month_name", F.lit(""), F.concat(
            "day_no", F.lit(",")), "year_no")).alias("long_date"),
        dates.short_date(F.concat(F.left("month_name", F.lit(3)), F.lit(". "), "day_no",
                                  F.lit(", "), "year_no")).alias("short_date"),
        dates.clock_date(F.concat_ws("/", "month_no", "day_no", F.concat(
            "year_no", F.lit(" 04:05 PM")))).alias("clock_date"))


@query("fn_flatten", duck(
    "select k, concat(title, '|', location, '|remote|', company) as strings from fx"))
def fn_flatten(spark, folder):
    text = F.concat(
        F.lit('{"a":["'), "title", F.lit('",{"b":"'), "location",
        F.lit('","c":true,"d":null,"e":'), C("k").cast("string"),
        F.lit('}],"f":[[[["too deep"]]]],"g":[false,[["'), "company", F.lit('"]]]}'))
    return fx(spark, folder).select(
        "k", F.array_join(clean.flatten_json(text), "|").alias("strings"))


@query("fn_loc_blob", duck(f"select k, {d.PLACE} as place from fx"))
def fn_loc_blob(spark, folder):
    return postings(spark, folder, "k").select("k", clean.location_blob(
        C("location"), C("loc_extra"), C("country"), C("employment_type")).alias("place"))


@query("fn_cycle_blob", duck(f"select k, {d.TERMS} as terms from fx"))
def fn_cycle_blob(spark, folder):
    return postings(spark, folder, "k").select("k", clean.cycle_blob(
        C("cycle_extra"), C("employment_type")).alias("terms"))


def _entities(text: str) -> str:
    for code, char in (("&amp;", "&"), ("&amp", "&"), ("&quot;", '"'), ("&copy;", "©"),
                       ("&middot;", "·")):
        text = f"replace({text}, '{code}', '{char}')"
    return text


HTML_PLAIN = _entities(_entities("html"))
for _tag in ("script", "style", "noscript"):
    HTML_PLAIN = f"regexp_replace({HTML_PLAIN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
HTML_PLAIN = f"regexp_replace({HTML_PLAIN}, '<[^>]+>', ' ', 'g')"


@query("html_text", f"""
    select page_id, trim(regexp_replace({HTML_PLAIN}, '\\s+', ' ', 'g')) as plain from pages""")
def html_text(spark, folder):
    return spread(table(spark, folder, "pages"), "page_id").select(
        "page_id", clean.html_to_text(C("html")).alias("plain"))


@query("fn_safe_url", duck(
    "select k, case when regexp_matches(url, '^https?://') then url else '' end as link from fx"))
def fn_safe_url(spark, folder):
    return fx(spark, folder).select("k", clean.safe_url(C("url")).alias("link"))


SAFE = "case when regexp_matches(url, '^https?://') then url else '' end"


def _swaps(text: str, codes) -> str:
    for char, code in codes:
        text = f"replace({text}, {quote(char)}, {quote(code)})"
    return text


def md_sql(text: str) -> str:
    text = f"replace(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '\\', '\\\\')"
    text = _swaps(text, render.MARKUP_CODES)
    return f"regexp_replace({text}, '([|\\[\\]*_`~#])', '\\\\\\1', 'g')"


def xml_sql(text: str) -> str:
    return _swaps(text, render.MARKUP_CODES + render.QUOTE_CODES)


@query("fn_escape", duck(f"""
    select k, {_swaps(SAFE, render.LINK_CODES)} as link, {md_sql("concat(company, ' | ', title)")}
      as md, {xml_sql("concat(company, ' <', title, '>')")} as xml from fx"""))
def fn_escape(spark, folder):
    return fx(spark, folder).select(
        "k", render.md_url(C("url")).alias("link"),
        render.md_escape(F.concat("company", F.lit(" | "), "title")).alias("md"),
        render.xml_escape(F.concat("company", F.lit(" <"), "title", F.lit(">"))).alias("xml"))


@query("fn_host", f"""
    select page_id, {d.bare_host('url')} as host,
      {d.on_domain(d.bare_host('url'), vocab.SHORTENER_HOSTS)} as is_short from pages""")
def fn_host(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", clean.bare_host(C("url")).alias("host"),
        clean.is_short_link(C("url")).alias("is_short"))


def _local(ts: str) -> str:
    return f"cast(timezone('America/Toronto', to_timestamp({ts})) as date)"


DAYS = f"greatest(date_diff('day', {_local('shown_at')}, {_local(str(AS_OF))}), 0)"
LABEL = (f"case when {DAYS} = 0 then 'Today' when {DAYS} = 1 then 'Yesterday' "
         f"else concat(cast({DAYS} as varchar), ' days ago') end")
SHOWN = "coalesce(nullif(posted_at, 0), first_seen)"
WHEN = (f"case when posted_at = 0 and seeded then 'date unknown' when posted_at = 0 then "
        f"concat('found ', lower({LABEL}[1:1]), {LABEL}[2:]) else {LABEL} end")
TODAY = f"(not (posted_at = 0 and seeded) and {DAYS} = 0)"


@query("day_label", duck(f"""
    select k, {LABEL} as label, cast({DAYS} as int) as days
    from (select *, {SHOWN} as shown_at from fx) s"""))
def day_label(spark, folder):
    shown = F.coalesce(F.nullif("posted_at", F.lit(0)), "first_seen")
    return fx(spark, folder).select(
        "k", dates.day_label(shown, AS_OF).alias("label"),
        dates.days_ago(shown, AS_OF).alias("days"))


@query("when_label", duck(f"""
    select k, {WHEN} as label, {TODAY} as today
    from (select *, {SHOWN} as shown_at from fx) s"""))
def when_label(spark, folder):
    shown = F.coalesce(F.nullif("posted_at", F.lit(0)), "first_seen")
    args = (C("posted_at"), C("seeded"), shown, AS_OF)
    return fx(spark, folder).select(
        "k", dates.when_label(*args).alias("label"), dates.is_today(*args).alias("today"))


@query("window_label", duck("""
    select k, case when k % 200 >= 48 then concat(cast((k % 200) // 24 as varchar), ' days')
        else concat(cast(k % 200 as varchar), ' hours') end as one,
      case when w = s then concat('last ', w) else concat('AI/ML last ', s, ', others last ', w)
        end as both_windows
    from (select k, case when k % 200 >= 48 then concat(cast((k % 200) // 24 as varchar), ' days')
        else concat(cast(k % 200 as varchar), ' hours') end as w,
      case when greatest(k % 200, ck % 300) >= 48
        then concat(cast(greatest(k % 200, ck % 300) // 24 as varchar), ' days')
        else concat(cast(greatest(k % 200, ck % 300) as varchar), ' hours') end as s from fx) t
    """))
def window_label(spark, folder):
    hours, strict = C("k") % 200, C("ck") % 300
    return fx(spark, folder).select(
        "k", dates.window_label(hours).alias("one"),
        dates.windows_label(hours, strict).alias("both_windows"))


@query("is_fresh", duck(f"""
    select k, posted_at = 0 or posted_at >= {AS_OF - DEFAULT.max_age_hours * 3600} as fresh
    from fx"""))
def is_fresh(spark, folder):
    return fx(spark, folder).select("k", dates.is_fresh(C("posted_at"), AS_OF).alias("fresh"))


NAME_TITLE = ("trim(regexp_replace(" + _entities(
    "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', "
    "'g')") + ", '\\s+', ' ', 'g'))")
_PARTS = (f"list_filter(list_transform(regexp_split_to_array({NAME_TITLE}, '[|\\-–—:]'), "
          f"lambda p: trim(p)), lambda p: length(p) between 2 and 39 and not regexp_matches(p, "
          f"{quote(vocab.GENERIC_PAGE_TITLE)}))")
_HOST = ("split_part(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), 'www\\.', '', 'g'), "
         "'.', 1)")


@query("name_guess", f"""
    select page_id, coalesce({_PARTS}[1],
      array_to_string(list_transform(string_split(replace({_HOST}, '-', ' '), ' '),
        lambda w: concat(upper(w[1:1]), lower(w[2:]))), ' ')) as name from pages""")
def name_guess(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", clean.company_name_guess(C("url"), C("html")).alias("name"))


# --- vocabularies, places, terms ------------------------------------------------------------

@query("p_ai", duck(f"select k, {d.ai('title')} as ai from fx"))
def p_ai(spark, folder):
    return fx(spark, folder).select("k", rules.has_ai_signal(C("title")).alias("ai"))


@query("p_student", duck(f"""
    select k, {d.any_rx('title', vocab.STUDENT_TERMS)} as student,
      not {d.any_rx('title', vocab.STUDENT_TERMS)} and {d.any_rx('title', vocab.NEWGRAD_TERMS)}
      as new_grad from fx"""))
def p_student(spark, folder):
    return fx(spark, folder).select("k", rules.is_student(C("title")).alias("student"),
                                    rules.is_new_grad(C("title")).alias("new_grad"))


@query("p_vocab", duck(f"""
    select k, {d.any_rx('title', vocab.OFF_FIELD_TERMS)} as off_field,
      {d.any_rx('title', vocab.TECH_TERMS)} or {d.rx('title', vocab.TECH_UPPER, ci=False)} as tech,
      {d.any_rx('title', vocab.RETAIL_TERMS)} as retail,
      {d.any_rx('title', vocab.REJECT_TERMS)} as reject from fx"""))
def p_vocab(spark, folder):
    title = C("title")
    return fx(spark, folder).select(
        "k", rules.is_off_field(title).alias("off_field"), rules.is_tech(title).alias("tech"),
        rules.is_retail(title).alias("retail"), rules.is_reject(title).alias("reject"))


@query("p_places", duck(f"""
    select k, {d.ontario('location')} as ontario, {d.commute('location')} as commute,
      {d.far('location')} as far from fx"""))
def p_places(spark, folder):
    text = C("location")
    return fx(spark, folder).select(
        "k", places.names_ontario(text).alias("ontario"),
        places.names_commute(text).alias("commute"), places.names_far(text).alias("far"))


@query("p_scope", duck(f"""
    select k, {d.other_canada('location')} as other_canada, {d.canada('location')} as canada,
      {d.remote('location')} as remote, {d.foreign('location')} as abroad from fx"""))
def p_scope(spark, folder):
    text = C("location")
    return fx(spark, folder).select(
        "k", places.names_other_canada(text).alias("other_canada"),
        places.names_canada(text).alias("canada"), places.is_remote(text).alias("remote"),
        places.names_foreign(text).alias("abroad"))


@query("location_scope", duck(f"select k, {d.scope(d.PLACE)} as scope from fx"))
def location_scope(spark, folder):
    place = clean.location_blob(C("location"), C("loc_extra"), C("country"), C("employment_type"))
    rows = postings(spark, folder, "k").withColumn("place", place)
    return rows.select("k", places.location_scope(C("place")).alias("scope"))


@query("in_canada", duck(f"""
    select k, {d.scope('location')} <> 'unknown' as names_a_place,
      {d.scope(d.PLACE)} in ('ontario', 'canada') as in_canada from fx"""))
def in_canada(spark, folder):
    place = clean.location_blob(C("location"), C("loc_extra"), C("country"), C("employment_type"))
    rows = postings(spark, folder, "k").withColumn("place", place)
    return rows.select("k", places.names_a_place(C("location")).alias("names_a_place"),
                       places.in_canada(C("place")).alias("in_canada"))


TERM_TEXT = f"concat(title, ' | ', {d.TERMS})"


def _term_cycles(spark, folder):
    rows = postings(spark, folder, "k")
    terms = clean.cycle_blob(C("cycle_extra"), C("employment_type"))
    return rows.withColumn("cycles", cycles.title_cycles(C("title"), terms, AS_OF_2026))


@query("parse_cycles", duck(
    f"select k, array_to_string({d.cycles(TERM_TEXT)}, ',') as cycles from fx"))
def parse_cycles(spark, folder):
    return _term_cycles(spark, folder).select(
        "k", F.array_join(C("cycles").cast("array<string>"), ",").alias("cycles"))


_CYCLED = {"cycled": f"select k, {d.cycles(TERM_TEXT)} as cycles from fx"}


@query("cycle_verdict", duck(
    f"select k, {d.cycle_verdict('cycles')} as verdict from cycled", **_CYCLED))
def cycle_verdict(spark, folder):
    return _term_cycles(spark, folder).select(
        "k", cycles.cycle_verdict(C("cycles")).alias("verdict"))


@query("live_cycle", duck(f"""
    select k, len(list_filter(cycles, lambda x: x >= {DEFAULT.live_from})) > 0 as live
    from cycled""", **_CYCLED))
def live_cycle(spark, folder):
    return _term_cycles(spark, folder).select(
        "k", cycles.names_live_cycle(C("cycles")).alias("live"))


@query("term_label", duck(f"select k, {d.term_label('cycles')} as term from cycled", **_CYCLED))
def term_label(spark, folder):
    return _term_cycles(spark, folder).select("k", cycles.term_label(C("cycles")).alias("term"))


@query("classify", duck("""
    select k, new_tier as tier, why as reason,
      why not in ('reject term', 'not student level') as student,
      why in ('cycle already passed', 'no AI signal', 'new grad, not internship', 'later cycle',
        'earlier cycle', 'ai + student + ontario') or (why in ('store or shift role', 'off-field',
        'not tech') and scope = 'ontario') as ontario,
      case when why in ('reject term', 'not student level', 'outside commute area',
        'outside Ontario', 'no Canadian location', 'store or shift role') then 'unknown'
        else cycle_now end as cycle,
      why <> 'no Canadian location' or trim(place) <> '' as location_known,
      ai_title and why in ('Canada, province not named', 'new grad, not internship',
        'later cycle', 'earlier cycle', 'ai + student + ontario') as ai
    from judged""", **d.classified()))
def classify(spark, folder):
    judged = rules.classify(postings(spark, folder, "k"), AS_OF_2026)
    return judged.select("k", *[f"verdict.{c}" for c in (
        "tier", "reason", "student", "ontario", "cycle", "location_known", "ai")])


# --- descriptions -----------------------------------------------------------------------------

PHRASES = [
    "", "We train models in PyTorch.", "An AI powered team.",
    "Build LLM features with the OpenAI API, prompt engineering and embeddings.",
    "Machine learning, deep learning and NLP.", "Step-down transformer station work.",
    "LLMs, LLMs, LLMs and more LLMs: agents, AI agents, LLM agents.",
    "<b>RAG</b> with vector search; model serving and evals.", "Transformers and CUDA.",
]
DESC_SQL = f"concat(text, ' ', {pick('doc_id', PHRASES)})"
_DESC = f"select doc_id, {d.description_text(DESC_SQL)} as plain from documents"


def _found(pattern: str) -> str:
    return f"regexp_matches(plain, {quote('(?i)' + pattern)})"


_LABELS = "array_to_string(list_filter([" + ", ".join(
    f"case when {_found(p)} then {quote(label)} end"
    for label, p in d.description_patterns()) + "], lambda x: x is not null), ', ')"
_SCORE = " + ".join(f"cast({_found(p)} as int)" for _, p in d.description_patterns())
_MENTIONS = " + ".join(f"len(regexp_extract_all(plain, {quote('(?i)' + p)}))"
                       for _, p in d.description_patterns())


def descriptions(spark, folder):
    """Documents as job descriptions: the whole text and a phrase."""
    text = F.concat("text", F.lit(" "), F.expr(pick("doc_id", PHRASES)))
    return spread(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", describe.plain_description(text).alias("plain"))


@query("desc_score", f"""
    select doc_id, cast({_SCORE} as int) as score, {_LABELS} as labels from ({_DESC}) t""")
def desc_score(spark, folder):
    rows = descriptions(spark, folder).withColumn("terms", describe.description_terms(C("plain")))
    return rows.select("doc_id", F.size("terms").alias("score"),
                       F.array_join("terms", ", ").alias("labels"))


@query("desc_mentions", f"""
    select doc_id, cast({_MENTIONS} as int) as mentions from ({_DESC}) t""")
def desc_mentions(spark, folder):
    return descriptions(spark, folder).select(
        "doc_id", describe.description_mentions(C("plain")).alias("mentions"))


@query("desc_is_ai", f"""
    select doc_id, ({_SCORE}) >= 3 or (({_SCORE}) >= 2 and ({_MENTIONS}) >= 6) as is_ai
    from ({_DESC}) t""")
def desc_is_ai(spark, folder):
    rows = descriptions(spark, folder).withColumn("terms", describe.description_terms(C("plain")))
    return rows.select("doc_id", describe.description_is_ai(C("plain"), C("terms")).alias("is_ai"))


@query("wants_desc", duck("""
    select k, coalesce(new_tier = 'loose' and why = 'no AI signal', false)
      or (new_tier is null and why = 'no Canadian location') as wants from judged""",
                          **d.classified()))
def wants_desc(spark, folder):
    judged = rules.classify(postings(spark, folder, "k"), AS_OF_2026)
    return judged.select("k", rules.wants_description(
        C("verdict.tier"), C("verdict.reason")).alias("wants"))


@query("denied_board", duck("""
    select k, regexp_matches(lower(concat(company, ' ', case k % 5 when 0 then 'Prolific-'
      when 1 then 'weloc' else '' end, url)), 'prolific|welo|general dynamics|invisible|internshiplist')
      as denied from fx"""))
def denied_board(spark, folder):
    token = F.concat(F.when(C("k") % 5 == 0, "Prolific-").when(C("k") % 5 == 1, "weloc")
                     .otherwise(""), "url")
    return fx(spark, folder).select("k", boards.is_denied_board(C("company"), token).alias("denied"))


# --- identity ------------------------------------------------------------------------------------

@query("norm_company", duck(f"select k, {d.norm_company('company')} as company_key from fx"))
def norm_company(spark, folder):
    return fx(spark, folder).select(
        "k", identity.normalize_company(C("company")).alias("company_key"))


@query("norm_title", duck(f"select k, {d.norm_title('title')} as title_key from fx"))
def norm_title(spark, folder):
    return fx(spark, folder).select("k", identity.normalize_title(C("title")).alias("title_key"))


@query("fingerprint", duck(f"select k, {d.fingerprint('company', 'title')} as fp from fx"))
def fingerprint(spark, folder):
    return fx(spark, folder).select(
        "k", identity.fingerprint(C("company"), C("title")).alias("fp"))


@query("req_id", duck(f"select k, {d.requisition('url')} as req from fx"))
def req_id(spark, folder):
    return fx(spark, folder).select("k", identity.requisition_id(C("url")).alias("req"))


_KEYS_SQL = f"""concat('fp:', {d.fingerprint('company', 'title')}, case when req <> '' then
    concat(' req:', {d.norm_company('company')}, ':', req) else '' end,
    case when req <> '' and {d.bare_host('url')} <> '' then
    concat(' req@', {d.bare_host('url')}, ':', req) else '' end)"""


@query("role_keys", duck(f"""
    select k, {_KEYS_SQL} as keys from (select *, {d.requisition('url')} as req from fx) s"""))
def role_keys(spark, folder):
    return fx(spark, folder).select("k", F.array_join(identity.role_keys(
        C("company"), C("title"), C("url")), " ").alias("keys"))


# --- boards ----------------------------------------------------------------------------------------

_PLATFORM, _TOKEN = d.board("url")


@query("board_from_url", duck(f"select k, {_PLATFORM} as platform, {_TOKEN} as token from fx"))
def board_from_url(spark, folder):
    return boards.with_board(fx(spark, folder), keep_all=True).select("k", "platform", "token")


@query("board_key", duck(f"""
    select k, {d.board_key('platform', 'token')} as board_key
    from (select k, {_PLATFORM} as platform, {_TOKEN} as token from fx) s
    where platform is not null"""))
def board_key(spark, folder):
    return boards.with_board(fx(spark, folder)).select(
        "k", boards.board_key(C("platform"), C("token")).alias("board_key"))
