"""Roles and duplicates against plain models, with one key held by most rows."""

import random

import pytest
from pyspark.sql import functions as F

from jobsluice.operators import roles
from jobsluice.operators.roles import assign_groups, connected_components, first_of_each_role
from jobsluice.operators.skew import split_lookup
from jobsluice.operators.state import JOBS_SCHEMA, ROLE_KEYS_SCHEMA
from jobsluice.operators.triage import mark_duplicates
from jobsluice.session import materialise
from jobsluice.settings import Settings

# A limit this low makes every test split its hot keys.
TINY = Settings(hot_rows=5)


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    edges += [("hub", f"leaf{i}") for i in range(40)] + [(f"c{i:02}", f"c{i + 1:02}")
                                                         for i in range(20)]
    edges = [(a, b) for a, b in edges if a != b]
    found = connected_components(spark.createDataFrame(edges, "a string, b string"), TINY)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == union_find(edges)


def test_groups_of_a_hot_role(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        hot = i % 3 == 0
        company = "Hot Inc" if hot else f"Co {rng.randrange(30)}"
        title = "Data Intern" if hot else f"Role {rng.randrange(4)} x"
        rows.append((f"u{i:03}", company, title, f"https://j.com/jobs/{rng.randrange(10000, 10080)}",
                     i))
    df = spark.createDataFrame(rows, "uid string, company string, title string, url string, seq long")
    none = spark.createDataFrame([], ROLE_KEYS_SCHEMA)
    groups = assign_groups(df, none, 100, TINY)
    got = {r["uid"]: r["group_id"] for r in groups.rows.collect()}
    links = []
    for uid, company, title, url, _ in rows:
        number = url.rsplit("/", 1)[1]
        links += [(uid, f"~fp {company} {title}"), (uid, f"~host {number}")]
    want = union_find(links)
    assert got == {uid: want[uid] for uid, *_ in rows}


def test_duplicates_in_arrival_order(spark):
    rng = random.Random(4)
    tiers = ["strict", "loose", "other", None]
    rows = [(f"u{i}", i, "g0" if i % 3 == 0 else f"g{rng.randrange(6)}", rng.choice(tiers))
            for i in range(90)]
    stored = [("s1", "g1", "loose", False), ("s2", "g2", "strict", True),
              ("s3", "g3", "strict", False), ("s4", "g4", None, False)]
    grouped = spark.createDataFrame(rows, "uid string, seq long, group_id string, t string") \
        .withColumn("verdict", F.struct(F.col("t").alias("tier")))
    jobs = spark.createDataFrame([], JOBS_SCHEMA).unionByName(
        spark.createDataFrame(stored, "uid string, group_id string, tier string, notified boolean"),
        allowMissingColumns=True)
    got = {r["uid"]: r["duplicate"] for r in mark_duplicates(grouped, jobs, TINY).collect()}
    kept, sent = {"g1", "g2", "g3"}, {"g2"}
    want = {}
    for uid, _, group, tier in rows:
        want[uid] = tier is not None and group in (sent if tier == "strict" else kept)
        if tier is not None:
            kept.add(group)
        if tier == "strict":
            sent.add(group)
    assert got == want


def test_first_of_each_role_is_sequential(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", f"Co {rng.randrange(8)}", f"Role {rng.randrange(3)} x",
             f"https://j.com/jobs/{rng.randrange(10000, 10030)}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "uid string, company string, title string, url string, seq long")
    got = {r["uid"] for r in first_of_each_role(df).collect()}
    seen, want = set(), set()
    for uid, company, title, url, _ in rows:
        number = url.rsplit("/", 1)[1]
        keys = {("fp", company, title), ("req", company, number), ("host", number)}
        if not keys & seen:
            want.add(uid)
        seen |= keys
    assert got == want


def test_split_lookup_keeps_every_row(spark):
    rows = [("hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i}"), i) for i in range(300)]
    left = spark.createDataFrame(rows, "key string, id long")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("other", 3)], "key string, v long")
    got = split_lookup(left, right, ["key"], ["id"], cfg=TINY)
    assert got.count() == 300
    assert got.where("v = 1").count() == 100
    assert got.where("v = 2").count() == 1


def test_batches_one_by_one_give_the_roles_of_one_batch(spark):
    """Shared requisition ids chain companies and titles; the order of batches does not matter."""
    pick = random.Random(11)
    schema = "uid string, company string, title string, url string, seq bigint"
    rows = []
    for k in range(240):
        host = pick.choice(["https://boards.greenhouse.io/a/jobs/{}", "https://x.com/p/{}"])
        rows.append((f"u{k:03}", f"Firm {pick.randrange(30)}", f"Role {pick.randrange(5)}",
                     host.format(1000 + pick.randrange(70)) if k % 3 else "", k))

    def groups(*cuts):
        stored, merged, of = spark.createDataFrame([], ROLE_KEYS_SCHEMA), [], {}
        for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
            made = assign_groups(spark.createDataFrame(rows[low:high], schema), stored, number)
            moves = {r["old_group"]: r["group_id"] for r in made.merged.collect()}
            of = {u: moves.get(g, g) for u, g in of.items()}
            of.update({r["uid"]: r["group_id"] for r in made.rows.collect()})
            merged += list(moves)
            stored = materialise(made.keys, "keys")
        return of, {(r["key"], r["group_id"]) for r in stored.collect()}, merged

    whole, keys, none = groups(0, 240)
    parts, part_keys, merged = groups(0, 60, 150, 240)
    assert parts == whole and part_keys == keys and merged and not none
    assert 5 < len(set(whole.values())) < 150


def test_roles_are_linked_by_numbers(spark, monkeypatch):
    """Keys are long texts; the rounds over the links between them shuffle numbers only."""
    met = []
    find = roles.connected_components
    monkeypatch.setattr(roles, "connected_components", lambda edges, cfg: met.append(
        dict(edges.dtypes)) or find(edges, cfg))
    rows = [(f"u{i}", f"Firm {i // 2}", "Data Intern", f"https://x.com/jobs/{10000 + (i + 1) // 2}", i)
            for i in range(12)]
    stored = spark.createDataFrame(
        [("req@x.com:10003", "old", 5), ("req:firm9:1", "other", 1)], ROLE_KEYS_SCHEMA)
    made = assign_groups(spark.createDataFrame(
        rows, "uid string, company string, title string, url string, seq bigint"), stored, 100)
    assert met == [{"a": "bigint", "b": "bigint"}]
    assert {r["group_id"] for r in made.rows.collect()} == {"old"}
    keys = {r["key"]: (r["group_id"], r["since"]) for r in made.keys.collect()}
    assert keys["req:firm9:1"] == ("other", 1) and keys["req@x.com:10000"] == ("old", 5)
    fp = [k for k in keys if k.startswith("fp:")]
    assert len(fp) == 6 and all(len(k) == 43 for k in fp)


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(roles, "connected_components", None)
    rows = [(f"u{i}", "Firm", f"Role {i}", f"https://x.com/jobs/{10000 + i // 4}", i)
            for i in range(12)]
    made = assign_groups(spark.createDataFrame(
        rows, "uid string, company string, title string, url string, seq bigint"),
        spark.createDataFrame([], ROLE_KEYS_SCHEMA), 100)
    assert {r["uid"]: r["group_id"] for r in made.rows.collect()} == {
        f"u{i}": f"u{i // 4 * 4}" for i in range(12)}
