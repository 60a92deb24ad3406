"""Which postings are one role.

Rows sharing any key (company and title, or a requisition id scoped to the
company or the site) are one role. Stored keys keep their role's id.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.functions.identity import role_key_struct, role_keys
from jobsluice.operators.skew import split_lookup
from jobsluice.session import materialise
from jobsluice.settings import DEFAULT, Settings

KEYS = ["key_fp", "key_req", "key_host"]
ORDER = "decimal(38,0)"


def with_role_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with their three keys; a ``key_fp`` they carry is taken as it is."""
    known = F.col("key_fp") if "key_fp" in rows.columns else None
    keys = role_key_struct(F.col("company"), F.col("title"), F.col("url"), known)
    return rows.select(*[c for c in rows.columns if c not in KEYS], F.inline(F.array(keys)))


def _largest_to_smallest(edges: DataFrame, total: int, cfg: Settings) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.withColumn("m", F.least("a", "m"))
    met = split_lookup(both.where(F.col("b") > F.col("a")), least.drop("n"), ["a"], ["b"],
                       counts=least.select("a", "n"), how="inner", cfg=cfg, total=2 * total)
    return met.where(F.col("b") != F.col("m")).select(
        F.col("m").alias("a"), F.col("b")).distinct()


def _smaller_to_smallest(edges: DataFrame, total: int, cfg: Settings) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    met = split_lookup(down, least.drop("n"), ["a"], ["b"],
                       counts=least.select("a", "n"), how="inner", cfg=cfg, total=2 * total)
    moved = met.where(F.col("b") != F.col("m")).select(F.col("m").alias("a"), "b")
    kept = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(kept).distinct()


def connected_components(edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """``(node, component)`` of an undirected graph ``(a, b)``.

    Alternates the two star steps until every component is a star around its
    smallest node. Each round works on distinct edges only, is written to the
    shared folder, and hub nodes are split over tasks.
    """
    current = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b").distinct(), "edges")
    mark = _edge_mark(current)
    # Every round but the last brings some node nearer its smallest one, so this ends.
    while True:
        # A round at most doubles the edges it is given, by the second step.
        stars = _smaller_to_smallest(
            _largest_to_smallest(current, mark[0], cfg), 2 * mark[0], cfg)
        current = materialise(
            stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
        previous, mark = mark, _edge_mark(current)
        if mark == previous:
            break
    centres = current.select(F.col("a").alias("node")).distinct().withColumn(
        "component", F.col("node"))
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")) \
        .unionByName(centres)


def _edge_mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


class Groups(NamedTuple):
    rows: DataFrame       # input rows with group_id
    keys: DataFrame       # role_keys after this batch: key, group_id, since
    merged: DataFrame     # old_group -> group_id, for roles that became one


def _packed(key: Column) -> Column:
    """A key as few bytes: a fingerprint's hex digits are bytes, other keys stay as they are."""
    return F.when(key.rlike("^fp:[0-9a-f]{40}$"), F.concat(
        F.lit(b"\x00"), F.unhex(F.substring(key, 4, 40)))).otherwise(
            F.concat(F.lit(b"\x01"), key.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 1 << 30)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x00"), F.concat(
        F.lit("fp:"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def assign_groups(rows: DataFrame, stored_keys: DataFrame, as_of: int,
                  cfg: Settings = DEFAULT) -> Groups:
    """Give each row its role.

    ``rows`` need uid, company, title, url and seq (arrival order), and may
    carry their keys, or ``key_fp`` alone, and ``stored_group``, a role they already belong to.
    ``stored_keys(key, group_id, since)`` are the keys known so far. A role keeps the id of its
    earliest stored part, else takes the uid of its first arrival.
    """
    if "stored_group" not in rows.columns:
        rows = rows.withColumn("stored_group", F.lit(None).cast("string"))
    if "stored_since" not in rows.columns:
        rows = rows.withColumn("stored_since", F.lit(None).cast("bigint"))
    keyed = rows if set(KEYS) <= set(rows.columns) else with_role_keys(rows)
    keyed = keyed.withColumns({k: _packed(F.col(k)) for k in KEYS})
    # Copies with equal keys act as one, so a huge group of them is one tuple. It has a number,
    # which its links are made of: keys are only shuffled where they are compared.
    tuples = materialise(
        keyed.groupBy(*KEYS, "stored_group").agg(
            F.min(F.struct("seq", "uid")).alias("first"), F.count("*").alias("n"),
            F.min("stored_since").alias("since")).withColumn(
                "node", F.monotonically_increasing_id()), "role-tuples")
    total = tuples.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = _met_keys(tuples, stored_keys)
    members = _members(tuples, keys)
    names = materialise(_named(tuples, keys, members, cfg, total), "role-names")
    # A tuple has three keys, so no node is met more often here.
    by_fp = keys.where("is_fp").join(names, "node").select(
        F.col("key").alias("key_fp"), F.col("c.id").alias("group_id"))
    per_fp = keys.where(F.col("is_fp") & (F.col("n") >= cfg.hot_rows)).select(
        F.col("key").alias("key_fp"), "n").distinct()
    grouped = split_lookup(keyed, by_fp, ["key_fp"], ["uid"], counts=per_fp, cfg=cfg,
                           total=total)

    # Stored roles that now share a component take its one id.
    merged = materialise(
        members.groupBy("group_id").agg(F.min("node").alias("node")).join(names, "node").select(
            F.col("group_id").alias("old_group"), F.col("c.id").alias("group_id"))
        .where("old_group <> group_id"), "merged-roles")
    relabelled = stored_keys
    if not merged.isEmpty():
        relabelled = stored_keys.join(
            merged.select(F.col("group_id").alias("_new"), F.col("old_group").alias("group_id")),
            "group_id", "left").select(
                "key", F.coalesce("_new", "group_id").alias("group_id"), "since")
    fresh = keys.where("group_id is null").select("key", "node").join(names, "node").select(
        _unpacked(F.col("key")).alias("key"), F.col("c.id").alias("group_id"),
        F.when(F.col("c.rank") == 0, F.col("c.at")).otherwise(F.lit(as_of))
        .cast("bigint").alias("since"))
    return Groups(grouped.drop(*KEYS, "stored_group", "stored_since"),
                  relabelled.unionByName(fresh), merged)


def _met_keys(tuples: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Every key of the batch: its first tuple (``node``), first arrival, counts, stored role."""
    own = tuples.where("key_fp is not null").select(
        "first", "n", "node", F.inline(F.array(*[
            F.struct(F.col(k).alias("key"), F.lit(k == "key_fp").alias("is_fp")) for k in KEYS])))
    met = own.where("key is not null").groupBy("key").agg(
        F.min("first").alias("first"), F.bool_or("is_fp").alias("is_fp"),
        F.min("node").alias("node"), F.count("*").alias("tuples"), F.sum("n").alias("n"))
    return materialise(met.join(stored_keys.select(
        _packed(F.col("key")).alias("key"), "group_id", F.col("since").alias("kept_since")),
        "key", "left"), "role-keys")


def _members(tuples: DataFrame, keys: DataFrame) -> DataFrame:
    """``(group_id, node)``: stored roles and the nodes that belong to them."""
    held = tuples.where("stored_group is not null and key_fp is not null")
    return keys.where("group_id is not null").select("group_id", "node").unionByName(
        held.select(F.col("stored_group").alias("group_id"), "node"))


def _links(tuples: DataFrame, keys: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``: tuples under the first one of their company and title, and all other links.

    A tuple has one company and title, so these are stars already. The other links, of tuples
    that share a requisition or a stored role, are between the first tuples of such stars.
    """
    shared = keys.where("tuples > 1").select("key", F.col("node").alias("b"), "is_fp")
    met = tuples.where("key_fp is not null").select(
        F.col("node").alias("a"), F.explode(F.array(*KEYS)).alias("key")).where("key is not null")
    links = materialise(met.join(shared, "key").select("a", "b", "is_fp").where("a <> b")
                        .distinct(), "role-links")
    copies = links.where("is_fp").select("a", "b")
    centres = members.groupBy("group_id").agg(F.min("node").alias("b"))
    others = links.where("not is_fp").select("a", "b").unionByName(
        members.join(centres, "group_id").select(F.col("node").alias("a"), "b"))
    if not copies.isEmpty():
        for end in ("a", "b"):
            firsts = copies.select(F.col("a").alias(end), F.col("b").alias("_first"))
            others = others.join(firsts, end, "left").withColumn(
                end, F.coalesce("_first", end)).drop("_first")
    return copies, materialise(others.where("a <> b").distinct(), "role-links")


def _are_stars(links: DataFrame) -> bool:
    """Whether every linked node has one link, to a node that has none: no round is needed."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(None).cast("int").alias("out")))
    return ends.groupBy("node").agg(
        F.count("out").alias("out"), F.count("*").alias("all")).where(
            "out > 1 or (out = 1 and all > 1)").isEmpty()


def _stars(links: DataFrame) -> DataFrame:
    centres = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        centres.withColumn("component", F.col("node")))


def _named(tuples: DataFrame, keys: DataFrame, members: DataFrame, cfg: Settings, total: int
           ) -> DataFrame:
    """``(node, c)``: what each node's role is called; stored roles by age, then arrivals."""
    def rank(level: int, at: str, name: str):
        return F.struct(F.lit(level).alias("rank"), F.coalesce(F.col(at), F.lit(0)).cast(ORDER)
                        .alias("at"), F.col(name).alias("id"))

    known = F.col("group_id").isNotNull()
    said = keys.where(known | F.col("is_fp")).select("node", F.when(
        known, rank(0, "kept_since", "group_id")).otherwise(
            rank(1, "first.seq", "first.uid")).alias("c"))
    held = tuples.where("stored_group is not null and key_fp is not null").select(
        "node", rank(0, "since", "stored_group").alias("c"))
    candidates = said.unionByName(held).groupBy("node").agg(F.min("c").alias("c"))
    copies, edges = _links(tuples, keys, members)
    linked = materialise(_stars(edges) if _are_stars(edges)
                         else connected_components(edges, cfg), "linked")
    components = linked.unionByName(copies.join(
        linked.withColumnRenamed("node", "b"), "b", "left").select(
            F.col("a").alias("node"), F.coalesce("component", "b").alias("component")))
    components = materialise(components, "components")
    if components.isEmpty():
        return candidates
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    best = materialise(candidates.join(components, "node", "left").groupBy(
        F.coalesce("component", "node").alias("component")).agg(F.min("c").alias("c")),
        "role-candidates")
    shared = split_lookup(components, best, ["component"], ["node"], counts=sizes, how="inner",
                          cfg=cfg, total=4 * total).select("node", "c")
    alone = best.withColumnRenamed("component", "node").join(components, "node", "left_anti")
    return alone.select("node", "c").unionByName(shared)


def regroup(jobs: DataFrame, merged: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Stored rows of merged roles under their new id."""
    moves = merged.select(F.col("old_group").alias("group_id"), F.col("group_id").alias("_to"))
    joined = split_lookup(jobs, moves, ["group_id"], ["uid"], cfg=cfg)
    return joined.withColumn("group_id", F.coalesce("_to", "group_id")).select(*jobs.columns)


def refresh_url(jobs: DataFrame, seen: DataFrame, stored_keys: DataFrame, as_of: int,
                cfg: Settings = DEFAULT) -> Groups:
    """Stored rows whose short link has since been resolved, under their real link.

    The new link's keys may belong to another stored role, which then merges.
    ``rows`` of the result is the whole jobs table.
    """
    links = seen.where((F.coalesce("short_url", F.lit("")) != "")
                       & (F.coalesce("url", F.lit("")) != "")).select(
        "uid", F.col("url").alias("_url"), F.col("company").alias("_company"),
        F.col("title").alias("_title"))
    met = jobs.join(links, "uid").where(~F.col("url").eqNullSafe(F.col("_url")))
    changed = met.select(
        "uid", F.col("_company").alias("company"), F.col("_title").alias("title"),
        F.col("_url").alias("url"), F.col("first_seen").alias("seq"),
        F.coalesce("group_id", "uid").alias("stored_group"),
        F.col("first_seen").alias("stored_since"))
    changed = materialise(changed, "relinked")
    if changed.isEmpty():
        return Groups(jobs, stored_keys, changed.select(
            F.col("stored_group").alias("old_group"), F.col("uid").alias("group_id")))
    groups = assign_groups(changed, stored_keys, as_of, cfg)
    relinked = jobs.join(changed.select("uid", F.col("url").alias("_url")), "uid", "left")
    relinked = relinked.withColumn("url", F.coalesce("_url", "url")).select(*jobs.columns)
    return Groups(regroup(relinked, groups.merged, cfg), groups.keys, groups.merged)


def delivery_state(jobs: DataFrame, by: str = "group_id") -> DataFrame:
    """What each role (or fingerprint) has already delivered."""
    return jobs.groupBy(by).agg(
        F.bool_or(F.coalesce((F.col("tier") == "strict") & F.col("notified"), F.lit(False)))
        .alias("strict_sent"),
        F.bool_or(F.col("tier").isNotNull()).alias("kept_any"))


def delivered(candidates: DataFrame, jobs: DataFrame, by: str = "group_id",
              cfg: Settings = DEFAULT) -> DataFrame:
    """Adds ``delivered``: has the candidate's role been sent at its tier or better?

    A strict candidate only counts a strict row that was notified; any other
    counts any kept row. Rejected copies never count.
    """
    joined = split_lookup(candidates, delivery_state(jobs, by), [by], ["uid"], cfg=cfg)
    sent = F.when(F.col("tier") == "strict", F.col("strict_sent")).otherwise(F.col("kept_any"))
    return joined.withColumn("delivered", F.coalesce(sent, F.lit(False))).drop(
        "strict_sent", "kept_any")


def fingerprint_delivered(candidates: DataFrame, jobs: DataFrame, cfg: Settings = DEFAULT
                          ) -> DataFrame:
    return delivered(candidates, jobs, "fingerprint", cfg)


def first_of_each_role(rows: DataFrame) -> DataFrame:
    """Rows none of whose keys was met earlier (``seq``).

    Every key names its first row; a row named by all its keys is kept. Keys
    combine before the shuffle, so a key held by most rows costs nothing.
    """
    keyed = rows.withColumn("_keys", role_keys(F.col("company"), F.col("title"), F.col("url")))
    payload = F.struct(*rows.columns, F.size("_keys").alias("_size"))
    named = keyed.select(F.explode("_keys").alias("key"), "seq", payload.alias("row"))
    firsts = named.groupBy("key").agg(F.min_by("row", "seq").alias("row"))
    votes = firsts.groupBy("row").agg(F.count("*").alias("votes"))
    return votes.where(F.col("votes") == F.col("row._size")).select("row.*").drop("_size")


def preview(classified: DataFrame, fresh_since: int) -> DataFrame:
    """Counts of a run that stores nothing: strict roles once each, by freshness."""
    flat = classified.select("uid", "company", "title", "url", "seq", "posted_at",
                             F.col("verdict.tier").alias("tier"))
    strict = flat.where(F.col("tier") == "strict")
    fresh = (F.col("posted_at") == 0) | (F.col("posted_at") >= fresh_since)
    roles = first_of_each_role(strict).agg(
        F.count_if(fresh).alias("strict"), F.count_if(~fresh).alias("stale"),
        F.count("*").alias("roles"))
    tiers = flat.agg(F.count("*").alias("postings"),
                     F.count_if(F.col("tier") == "strict").alias("strict_rows"),
                     F.count_if(F.col("tier") == "loose").alias("loose"),
                     F.count_if(F.col("tier") == "other").alias("other"))
    both = roles.withColumn("_one", F.lit(1)).join(tiers.withColumn("_one", F.lit(1)), "_one")
    return both.select("postings", "strict", "stale",
                       (F.col("strict_rows") - F.col("roles")).alias("duplicates"),
                       "loose", "other")

