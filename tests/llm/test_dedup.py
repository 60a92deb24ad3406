"""Exact and near copies against plain versions."""

from collections import Counter, defaultdict

import numpy as np
from brute import components, fingerprint, sha
from rows import odd_rows
from pyspark.sql import functions as F

from jobsluice.llm import exact_dedup, simhash_dedup
from jobsluice.llm.exact_dedup import DedupSettings

SMALL = DedupSettings(bucket_keys=4)


def expected_groups():
    groups = defaultdict(list)
    for row in odd_rows():
        groups[row[1] or ""].append(row[0])
    return {text: (max((i for i in ids if i is not None), default=None), len(ids))
            for text, ids in groups.items()}


def check_groups(rows):
    want = expected_groups()
    by_sha = {sha(t): t for t in want}
    assert Counter((r["id"], r["text_sha256"]) for r in rows) == Counter(
        (r[0], sha(r[1] or "")) for r in odd_rows())
    kept = Counter()
    for r in rows:
        assert (r["keep_id"], r["group_size"]) == want[by_sha[r["text_sha256"]]]
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_groups(docs):
    check_groups(exact_dedup.exact_groups(docs, cfg=SMALL).collect())


def test_colliding_keys_are_chained(docs):
    rows = exact_dedup.exact_groups(docs, cfg=SMALL, key=lambda t: F.length(t) % 3).collect()
    check_groups(rows)
    assert max(r["slot"] for r in rows) > 5


def test_directory_doubles():
    loads = np.zeros(64, dtype=np.int64)
    loads[5], loads[40:44] = 100, 3
    directory = exact_dedup.grow_directory(loads, 8)
    assert len(directory.slots) == 1 << directory.depth
    for bucket, depth in enumerate(directory.local):
        assert directory.slots.count(bucket) == 1 << (directory.depth - depth)
    per_slot = loads.reshape(len(directory.slots), -1).sum(axis=1)
    load = Counter()
    for slot, bucket in enumerate(directory.slots):
        load[bucket] += int(per_slot[slot])
    assert sorted(load.values())[-2:] == [6, 100] or sorted(load.values())[-1] == 100
    assert all(n <= 8 for b, n in load.items() if directory.local[b] < 6)


def test_exact_survivors(docs):
    rows = exact_dedup.deduplicate(docs, cfg=SMALL)
    assert rows.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in rows.collect()) == Counter(
        (keep, text) for text, (keep, _) in expected_groups().items())


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert simhash_dedup.component_of(simhash_dedup.near_groups(none)).count() == 0
    assert simhash_dedup.deduplicate_near(none).count() == 0


def near_rows():
    rows = odd_rows()
    prints = [fingerprint(r[1]) for r in rows]
    return rows, prints, components([r[0] for r in rows], prints)


def test_near_groups(docs):
    rows, prints, comps = near_rows()
    for tile in (3, 4096):
        found = simhash_dedup.near_groups(docs, cfg=simhash_dedup.SimhashSettings(tile=tile))
        assert Counter(map(tuple, simhash_dedup.component_of(found).collect())) == Counter(
            (r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comps))


def test_near_survivors(docs):
    rows, prints, comps = near_rows()
    roots = components([r[0] for r in rows], prints, roots=True)
    got = simhash_dedup.deduplicate_near(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(
        comp for comp, _ in set(zip(comps, roots)))


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for p in base.tolist():
        for _ in range(8):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            for b in flips.tolist():
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    cfg = simhash_dedup.SimhashSettings(tile=16)
    links = [(a % 2 ** 64, b % 2 ** 64) for a, b in simhash_dedup.find_links(frame, cfg).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = components(prints, prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(p) for p in prints] == want
    assert len(links) < 4 * len(prints)
