"""Thresholds and windows, passed to every job that needs one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Feed windows, in hours. Strict roles stay listed longer.
    max_age_hours: int = 168
    strict_max_age_hours: int = 336
    # Cycles are year*100 + first month. Strict needs one between the targets.
    target_cycles: tuple[int, ...] = (202704, 202705)
    earliest_live_cycle: int = 202701
    # A role is closed after this many complete listings in a row without it.
    closed_after_misses: int = 2
    desc_min_terms: int = 3
    desc_min_mentions: int = 6
    # Optional cut of a description's text; None reads the whole text.
    desc_max_chars: int | None = None
    health_fail_threshold: float = 0.2
    discovery_max_boards: int = 300
    discovery_top_boards: int = 40
    discovery_max_fails: int = 5
    discovery_stale_days: int = 30
    promote_max: int = 60
    # Redirects a short link may take before it counts as leading nowhere.
    short_link_hops: int = 4
    sniff_every_days: int = 14
    explore_recheck_days: int = 30
    sitemap_max_age_days: int = 21
    feed_limit: int = 200
    alert_limit: int = 5
    timezone: str = "America/Toronto"
    # Keys with at least this many rows are split over several tasks in joins.
    hot_rows: int = 1_000_000

    @property
    def first_target(self) -> int:
        return min(self.target_cycles)

    @property
    def last_target(self) -> int:
        return max(self.target_cycles)

    @property
    def live_from(self) -> int:
        return min(self.earliest_live_cycle, self.first_target)

    @property
    def strict_window(self) -> int:
        return max(self.max_age_hours, self.strict_max_age_hours)


DEFAULT = Settings()
