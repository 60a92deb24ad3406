"""DuckDB spellings of the rules, for the statements queries are compared with.

DuckDB's regular expressions have no look-ahead. A forbidden continuation is
blanked out of the text first, and a required end becomes an alternative.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from jobsluice.catalog.fixtures import AS_OF_2026, quote
from jobsluice.functions import vocab
from jobsluice.settings import DEFAULT

END = r"(?:[^\w-]|$)"


def plain(pattern: str) -> str:
    return pattern.replace(r"(?![\w-])", END)


def rx(text: str, pattern: str, ci: bool = True) -> str:
    return f"regexp_matches({text}, {quote(('(?i)' if ci else '') + plain(pattern))})"


def any_rx(text: str, terms: list[str]) -> str:
    return rx(text, "|".join(terms))


def blank(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {quote('(?i)' + pattern)}, ' ', 'g')"


def ai(text: str) -> str:
    """AI vocabulary; a CV that is a file to upload is not computer vision."""
    terms = [t.split("(?!")[0] if "(?!" in t else t for t in vocab.AI_TERMS]
    return any_rx(blank(text, r"\bcv[\s\-]?(?:file|upload)"), terms)


_REGION_NAMES = vocab.OTHER_REGIONS.split("|", 1)[1]
_TWO = r"(?:[abd-np-z][a-z]|c[b-z]|o[a-mo-z])"
_TWO_OR_CA = r"(?:[a-np-z][a-z]|o[a-mo-z])"
_STREET = vocab.NOT_A_STREET.removeprefix("(?!").removesuffix(")")


def _guarded(text: str, towns: list[str], two: str) -> str:
    names = "|".join(towns)
    elsewhere = rf"\s*,\s*(?:{two}{END}|{_REGION_NAMES}"
    return blank(text, rf"(?:{names})(?:{_STREET}|{elsewhere})")


def _cleaned(text: str) -> str:
    """Place text without towns that a street or another region claims."""
    shared = sorted({*vocab.SHARED_TOWNS, *vocab.SHARED_GTA_TOWNS, *vocab.COMMUTE_SHARED_TOWNS})
    text = blank(text, r"\bontario\b\s*,\s*(?:california|oregon)\b")
    text = _guarded(text, shared, _TWO)
    return _guarded(text, vocab.CALIFORNIA_TOWNS, _TWO_OR_CA)


def ontario(text: str) -> str:
    terms = [t.split("(?!\\s*,")[0] for t in vocab.ONTARIO_PLAIN]
    terms += vocab.SHARED_TOWNS + vocab.SHARED_GTA_TOWNS + vocab.CALIFORNIA_TOWNS
    return any_rx(_cleaned(text), terms)


def commute(text: str) -> str:
    return any_rx(_cleaned(text), vocab.COMMUTE_PLAIN + vocab.COMMUTE_SHARED_TOWNS
                  + vocab.SHARED_GTA_TOWNS + vocab.CALIFORNIA_TOWNS)


def far(text: str) -> str:
    return any_rx(_cleaned(text), vocab.FAR_PLAIN + vocab.FAR_SHARED_TOWNS)


def other_canada(text: str) -> str:
    return any_rx(text, vocab.OTHER_CANADA_TERMS)


def canada(text: str) -> str:
    return any_rx(text, vocab.CANADA_TERMS)


def remote(text: str) -> str:
    return any_rx(text, vocab.REMOTE_TERMS)


def foreign(text: str) -> str:
    return f"({any_rx(text, vocab.FOREIGN_TERMS)} or {rx(text, vocab.FOREIGN_UPPER, ci=False)})"


def scope(text: str) -> str:
    return f"""case
      when {ontario(text)} or ({remote(text)} and {canada(text)} and not {other_canada(text)})
        then case when {far(text)} and not {commute(text)} and not {remote(text)} then 'far'
          else 'ontario' end
      when {canada(text)} and not {other_canada(text)} and not {foreign(text)} then 'canada'
      when {other_canada(text)} or {foreign(text)} then 'elsewhere' else 'unknown' end"""


PLACE = ("concat_ws(' | ', nullif(location, ''), nullif(loc_extra_s, ''), nullif(country, ''), "
         "nullif(employment_type, ''))")
TERMS = "concat_ws(' | ', nullif(cycle_extra_s, ''), nullif(employment_type, ''))"


def _month(season: str) -> str:
    return (f"case lower({season}) when 'winter' then 1 when 'w' then 1 when 'spring' then 4 "
            f"when 'summer' then 5 when 's' then 5 else 9 end")


def _dated(text: str, pattern: str, season: int, year: int) -> str:
    p = quote("(?i)" + pattern)
    pairs = f"list_zip(regexp_extract_all({text}, {p}, {season}), " \
            f"regexp_extract_all({text}, {p}, {year}))"
    y = "case when length(x[2]) = 2 then 2000 + cast(x[2] as int) else cast(x[2] as int) end"
    return f"list_transform({pairs}, lambda x: ({y}) * 100 + {_month('x[1]')})"


def cycles(text: str, as_of: int = AS_OF_2026) -> str:
    """Sorted distinct terms a text names."""
    now = datetime.fromtimestamp(as_of, ZoneInfo("America/Toronto"))
    rest = f"regexp_replace({text}, {quote('(?i)' + vocab.CYCLE_SEASON_FIRST)}, ' ', 'g')"
    full = (f"list_concat(list_concat({_dated(text, vocab.CYCLE_SEASON_FIRST, 1, 2)}, "
            f"{_dated(rest, vocab.CYCLE_YEAR_FIRST, 2, 1)}), "
            f"{_dated(text, vocab.CYCLE_SHORT, 1, 2)})")
    bare_pattern = quote("(?i)" + vocab.CYCLE_BARE.replace(r"(?=\||$)", r"(?:\||$)"))
    bare = (f"list_transform(regexp_extract_all({text}, {bare_pattern}, 1), lambda x: "
            f"({now.year} + case when {_month('x')} < {now.month} then 1 else 0 end) * 100 "
            f"+ {_month('x')})")
    return (f"list_sort(list_distinct(case when len({full}) > 0 then {full} else {bare} end))")


def cycle_verdict(found: str) -> str:
    c = DEFAULT
    def some(test: str) -> str:
        return f"len(list_filter({found}, lambda x: {test})) > 0"
    return f"""case when len({found}) = 0 then 'unknown'
      when {some(f'x between {c.first_target} and {c.last_target}')} then 'target'
      when {some(f'x > {c.last_target}')} then 'later'
      when {some(f'x between {c.live_from} and {c.first_target - 1}')} then 'earlier'
      else 'past' end"""


def term_label(found: str) -> str:
    live = f"list_filter({found}, lambda x: x >= {DEFAULT.live_from})"
    name = ("case x % 100 when 1 then 'Winter' when 4 then 'Spring' when 5 then 'Summer' "
            "else 'Fall' end")
    return (f"array_to_string(list_transform(case when len({live}) > 0 then {live} else {found} "
            f"end, lambda x: concat({name}, ' ', cast(x // 100 as varchar))), ', ')")


def classified(source: str = "fx") -> dict[str, str]:
    """CTEs ending in ``judged``: the source's columns plus the verdict's fields."""
    flags = f"""select *, concat(title, ' | ', company, ' | ', place) as hay,
        concat(title, ' | ', place) as level_text
      from (select *, {PLACE} as place, {TERMS} as terms from {source}) s"""
    live = f"len(list_filter(title_cycles, lambda x: x >= {DEFAULT.live_from})) > 0"
    levels = f"""select *, {any_rx('hay', vocab.REJECT_TERMS)} as rejected,
        {any_rx('level_text', vocab.STUDENT_TERMS)} as student_word,
        {any_rx('level_text', vocab.NEWGRAD_TERMS)} as grad_word,
        {cycles("concat(title, ' | ', terms)")} as title_cycles,
        {cycles("concat(hay, ' | ', terms)")} as all_cycles,
        {scope('place')} as scope, ({ai('title')} or ai_native) as ai_title,
        {any_rx('title', vocab.RETAIL_TERMS)} as retail,
        {any_rx('title', vocab.OFF_FIELD_TERMS)} as off_field,
        ({any_rx('title', vocab.TECH_TERMS)} or {rx('title', vocab.TECH_UPPER, ci=False)}) as tech
      from flags"""
    steps = f"""select *, {cycle_verdict('all_cycles')} as cycle_now,
        case when student_word or (not grad_word and {live}) then 'intern'
          when grad_word then 'grad' end as level from levels"""
    judged = """select *, case
        when rejected then 'reject term'
        when level is null then 'not student level'
        when scope = 'far' then 'outside commute area'
        when scope = 'elsewhere' then 'outside Ontario'
        when scope = 'unknown' then 'no Canadian location'
        when cycle_now = 'past' then 'cycle already passed'
        when not ai_title and retail then 'store or shift role'
        when not ai_title and off_field then 'off-field'
        when not ai_title and not tech then 'not tech'
        when scope = 'canada' then 'Canada, province not named'
        when not ai_title then 'no AI signal'
        when level = 'grad' then 'new grad, not internship'
        when cycle_now = 'later' then 'later cycle'
        when cycle_now = 'earlier' then 'earlier cycle'
        else 'ai + student + ontario' end as why from steps"""
    final = """select *, case
        when why in ('off-field', 'not tech') then 'other'
        when why in ('Canada, province not named', 'no AI signal', 'new grad, not internship',
          'later cycle', 'earlier cycle') then 'loose'
        when why = 'ai + student + ontario' then 'strict' end as new_tier from judged0"""
    return {"flags": flags, "levels": levels, "steps": steps, "judged0": judged,
            "judged": final}


# --- identity -----------------------------------------------------------------------


def norm_company(col: str) -> str:
    words = "|".join(vocab.COMPANY_WORDS)
    text = f"replace(lower({col}), '&', ' and ')"
    text = rf"regexp_replace({text}, '\b(?:{words})\b\.?', ' ', 'g')"
    return f"regexp_replace({text}, '[^a-z0-9]+', '', 'g')"


def norm_title(col: str) -> str:
    text = f"replace(lower({col}), '&', ' and ')"
    for pattern, token in vocab.TITLE_FOLDS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(token)}, 'g')"
    text = f"regexp_replace({text}, {quote('|'.join(vocab.TITLE_NOISE))}, ' ', 'g')"
    text = f"regexp_replace({text}, '[^a-z0-9]+', ' ', 'g')"
    return (f"array_to_string(list_sort(list_filter(string_split({text}, ' '), "
            f"lambda x: x <> '')), ' ')")


def fingerprint(company: str, title: str) -> str:
    return f"sha1(concat({norm_company(company)}, '::', {norm_title(title)}))"


def url_path(url: str) -> str:
    return rf"regexp_extract({url}, '^(?:[A-Za-z][\w+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def netloc(url: str) -> str:
    return rf"lower(regexp_extract({url}, '^(?:[A-Za-z][\w+.\-]*:)?//([^/?#]*)', 1))"


def bare_host(url: str) -> str:
    return rf"regexp_replace({netloc(url)}, '^www\.', '')"


def requisition(url: str) -> str:
    def found(text: str, pattern: str, group: int = 1) -> str:
        return f"nullif(regexp_extract({text}, {quote(pattern)}, {group}), '')"
    path = url_path(url)
    return f"""coalesce({found(url, vocab.REQ_GREENHOUSE)},
      upper(replace({found(path, vocab.REQ_WORKDAY)}, '-', '')),
      lower({found(path, '(?i)' + vocab.UUID, 0)}), {found(path, vocab.REQ_PATH)}, '')"""


# --- boards -------------------------------------------------------------------------


def board(url: str) -> tuple[str, str]:
    """Platform and token expressions for a posting link."""
    arms: list[tuple[str, str, str]] = []

    def ex(pattern: str, group: int) -> str:
        return f"regexp_extract({url}, {quote(pattern)}, {group})"

    def hit(pattern: str) -> str:
        return f"regexp_matches({url}, {quote(pattern)})"

    def workday(pattern: str, tenant: int, wd: int, site: int) -> str:
        return (f"concat('https://', {ex(pattern, tenant)}, '.', {ex(pattern, wd)}, "
                f"'.myworkdayjobs.com/wday/cxs/', {ex(pattern, tenant)}, '/', "
                f"{ex(pattern, site)}, '/jobs')")

    arms.append((hit(vocab.WORKDAY_POSTING), "workday", workday(vocab.WORKDAY_POSTING, 1, 2, 3)))
    arms.append((hit(vocab.WORKDAY_SITE_POSTING), "workday",
                 workday(vocab.WORKDAY_SITE_POSTING, 2, 1, 3)))
    o = vocab.ORACLE_POSTING
    arms.append((hit(o), "oracle", f"concat('https://', lower({ex(o, 1)}), '|', {ex(o, 2)})"))
    e = vocab.EIGHTFOLD_POSTING
    arms.append((hit(e), "eightfold",
                 f"concat(lower({ex(e, 1)}), '.eightfold.ai|', lower({ex(e, 1)}), '.com')"))
    for name, p, tail in (("jibe", vocab.JIBE_POSTING, ""), ("icims", vocab.ICIMS_POSTING, ""),
                          ("successfactors", vocab.SUCCESSFACTORS_POSTING,
                           "/search/?q=&locationsearch=Ontario")):
        arms.append((hit(p), name, f"concat('https://', lower({ex(p, 1)}), '{tail}')"))
    noise = ", ".join(quote(t) for t in vocab.TOKEN_NOISE)
    for name, p in vocab.SLUG_POSTINGS:
        arms.append((f"{ex(p, 1)} <> '' and lower({ex(p, 1)}) not in ({noise})", name, ex(p, 1)))
    platform = "case " + " ".join(f"when {t} then '{n}'" for t, n, _ in arms) + " end"
    token = "case " + " ".join(f"when {t} then {tok}" for t, _, tok in arms) + " end"
    return platform, token


def board_key(platform: str, token: str) -> str:
    return (f"concat({platform}, ' ', case when {platform} = 'successfactors' "
            f"then {netloc(token)} else lower(regexp_replace({token}, '/+$', '')) end)")


def on_domain(host: str, domains: list[str]) -> str:
    escaped = "|".join(d.replace(".", r"\.") for d in domains)
    return f"regexp_matches({host}, {quote(rf'^(?:.*\.)?(?:{escaped})$')})"


# --- descriptions -------------------------------------------------------------------

def letters(text: str) -> str:
    """Accented letters as plain ones, so that word ends are found alike."""
    return f"regexp_replace({text}, '[À-ÖØ-öø-ÿĀ-ɏ]', 'q', 'g')"


def description_patterns() -> list[tuple[str, str]]:
    return [(label, pattern.split("(?!")[0] if "(?!" in pattern else pattern)
            for label, pattern in vocab.DESCRIPTION_TERMS]


def description_text(text: str) -> str:
    """Tag-free text without the transformers that are electrical."""
    bare = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    return letters(blank(bare, r"\btransformers?\s+(?:station|substation)"))
