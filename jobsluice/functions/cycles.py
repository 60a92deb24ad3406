"""Work terms, as year*100 + first month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsluice.functions import vocab
from jobsluice.functions.clean import let
from jobsluice.functions.dates import at
from jobsluice.settings import DEFAULT, Settings

_CI = "(?iU)"
_HINT = r"(?i)winter|spring|summer|fall|autumn|\b[wsf]'?\d"
_NONE = "array<int>"


def _month(season: Column) -> Column:
    low = F.lower(season)
    expr = None
    for name, month in vocab.SEASON_MONTH.items():
        expr = F.when(low == name, month) if expr is None else expr.when(low == name, month)
    return expr


def _full_year(digits: Column) -> Column:
    year = digits.cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def _dated(text: Column, pattern: str) -> Column:
    """Terms of every match: its letters are the season, its digits the year."""
    matches = F.regexp_extract_all(text, F.lit(_CI + pattern), F.lit(0))
    return F.transform(matches, lambda m: _full_year(
        F.regexp_extract(m, r"(\d+)", 1)) * 100 + _month(F.regexp_extract(m, "([A-Za-z]+)", 1)))


def parse_cycles(text: Column, as_of: int | Column, cfg: Settings = DEFAULT) -> Column:
    """Every term the text names, sorted and distinct.

    A season with its year either side, a short code, or else a bare season
    closing a field, which means the next such term.
    """
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, _CI + vocab.CYCLE_SEASON_FIRST, " ")
    dated = F.concat(
        _dated(text, vocab.CYCLE_SEASON_FIRST),
        _dated(rest, vocab.CYCLE_YEAR_FIRST),
        _dated(text, vocab.CYCLE_SHORT),
    )
    utc = F.to_utc_timestamp(F.timestamp_seconds(at(as_of)), F.current_timezone())
    today = F.from_utc_timestamp(utc, cfg.timezone)
    bare = F.transform(
        F.regexp_extract_all(text, F.lit(_CI + vocab.CYCLE_BARE), F.lit(1)),
        lambda s: (F.year(today) + (_month(s) < F.month(today)).cast("int")) * 100 + _month(s))
    found = let(dated, lambda terms: F.when(F.size(terms) > 0, terms).otherwise(bare))
    return F.when(text.rlike(_HINT), F.array_sort(F.array_distinct(found))).otherwise(
        F.array().cast(_NONE))


def cycle_verdict(cycles: Column, cfg: Settings = DEFAULT) -> Column:
    """target, later, earlier, past, or unknown when no term is named."""
    return (
        F.when(cycles.isNull(), None)
        .when(F.size(cycles) == 0, "unknown")
        .when(F.exists(cycles, lambda c: c.between(cfg.first_target, cfg.last_target)), "target")
        .when(F.exists(cycles, lambda c: c > cfg.last_target), "later")
        .when(F.exists(cycles, lambda c: (c >= cfg.live_from) & (c < cfg.first_target)), "earlier")
        .otherwise("past")
    )


def names_live_cycle(cycles: Column, cfg: Settings = DEFAULT) -> Column:
    return F.exists(cycles, lambda c: c >= cfg.live_from)


def term_label(cycles: Column, cfg: Settings = DEFAULT) -> Column:
    """``Summer 2027, Fall 2027``; finished terms go when a live one is named."""
    def label(c: Column) -> Column:
        name = None
        for month, season in vocab.SEASON_NAME.items():
            test = c % 100 == month
            name = F.when(test, season) if name is None else name.when(test, season)
        return F.concat(name, F.lit(" "), F.floor(c / 100).cast("string"))

    def shown(cycles: Column) -> Column:
        live = F.filter(cycles, lambda c: c >= cfg.live_from)
        return F.when(F.size(live) > 0, live).otherwise(cycles)

    return F.array_join(F.transform(let(cycles, shown), label), ", ")


def title_cycles(title: Column, term_text: Column, as_of: int | Column,
                 cfg: Settings = DEFAULT) -> Column:
    """Terms named by the title and the term fields."""
    return parse_cycles(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" | "), term_text), as_of, cfg)
