"""Catalog queries against DuckDB on the smallest tables.

A spread of every area by default; ``ALL_QUERIES=1`` runs the whole catalog.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck_connection

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "fn_parse_date", "fn_table_date", "fn_flatten", "day_label", "location_scope", "parse_cycles",
    "classify", "desc_is_ai", "role_keys", "board_from_url", "src_greenhouse", "src_icims",
    "src_workday_detail", "page_links", "tracker_json", "default_location", "assign_groups",
    "triage", "presence", "recent_jobs", "reason_counts", "health", "disc_pick",
    "discover_boards", "sniff", "select_promoted", "rss_items", "md_rows", "stream_presence",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def con():
    return duck_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    found = differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert not found, "\n".join(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
