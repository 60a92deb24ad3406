"""Quality counts and rules, secret spans, mixing and sharding against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import base_spans, quality_counts, sha, words_of
from rows import odd_rows, prose
from pyspark.sql import functions as F

from jobsluice.llm import mixing, quality, secrets, sharding
from jobsluice.llm.common import bounded_sample


def test_quality_counts(docs):
    judged = quality.judge(docs, quality.DecisionList()).collect()
    got = Counter((r["_row"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"],
                   r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in judged)
    want = Counter()
    for r in odd_rows():
        counts = quality_counts(r[1])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want[(r[0], *counts, failed)] += 1
    assert got == want


def labelled(spark):
    rows = [(k, prose(k + 1, 90), 1) for k in range(120)]
    rows += [(200 + k, " ".join(f"{w}$$$" for w in prose(k + 1, 90).split()), 0) for k in range(60)]
    rows += [(300 + k, " ".join(w.upper() for w in prose(k + 1, 90).split()), 0) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(r[0], r[2], None) for r in rows] + [(0, 1, 1), (9, None, 0), (None, 0, 0), (1, 0, 0)],
        "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_rules_are_learned(spark):
    rows, docs, labels = labelled(spark)
    rules = quality.learn(docs, labels)
    assert 2 <= len(rules.rules) <= 4
    verdicts = {r["_row"]["doc_id"]: r for r in quality.judge(docs, rules).collect()}
    usable = [r for r in rows if not verdicts[r[0]]["base_failed"]]
    assert all(verdicts[i]["kept"] for i, _, good in usable if good)
    caught = [not verdicts[i]["kept"] for i, _, good in usable if not good]
    assert np.mean(caught) > 0.95
    # The emitted expression and a reading of the list agree.
    for r in verdicts.values():
        first = "keep"
        values = spark.createDataFrame([r.asDict(recursive=True)]).select(
            *[quality.feature(f).alias(f) for f in quality.FEATURES]).first() \
            if r["_row"]["doc_id"] in (0, 200, 300) else None
        if values is None:
            continue
        for number, rule in enumerate(rules.rules):
            cuts = [(values[c.feature], c.above, rules.thresholds[c.feature][c.cut - 1])
                    for c in rule]
            if all(v >= t if above else v < t for v, above, t in cuts):
                first = f"rule_{number + 1}"
                break
        assert r["verdict"] == ("base" if r["base_failed"] else first)


def test_rules_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, empty) == quality.DecisionList()
    assert quality.judge(none, quality.learn(none, empty)).count() == 0
    kept = quality.judge(docs, quality.DecisionList()).where("kept").select("_row.*")
    assert kept.columns == docs.columns


@pytest.mark.parametrize("rows", range(30_000, 30_008))
def test_the_limit_does_not_cut_a_sample(spark, rows):
    frame = spark.range(rows)
    kept = {r[0] for r in bounded_sample(frame, 20_000, "id").collect()}
    again = {r[0] for r in bounded_sample(frame.orderBy(F.desc("id")), 20_000, "id").collect()}
    assert kept == again and 18_000 < len(kept) < 20_000


def test_base_secret_spans(docs, spark):
    more = ["PassWord: abcdefgh token=short", "api_key='ABCDEFGH12345678' xx apikey = q.w=e-r/t+y",
            "é𝄞 secret:deadbeefdeadbeefdeadbeefdeadbeef1", "AKIA" + "Q" * 11 + " AKIA" + "Q" * 12,
            "ſecret=abcdefgh toKen=abcdefgh", "a" * 31 + " " + "b" * 32]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(1000 + k, t) for k, t in enumerate(more)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["s"]) for r in secrets.scan(frame).select(
        "id", secrets.span_text(F.col("base")).alias("s")).collect())
    assert got == Counter((i, base_spans(t)) for i, t in rows)


def test_random_tokens_are_added(spark):
    rng = np.random.default_rng(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for k in range(300):
        token = "".join(rng.choice(list(signs), 40))
        rows.append((k, f"{prose(k + 1, 30)} {token} {prose(k + 2, 30)}" if k % 3 == 0 else
                     f"{prose(k + 1, 30)} thirtytwolettersandthenyear2024inone "
                     "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 " + "12" * 20))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["id"]: len(r["added"]) for r in found}
    assert np.mean([added[k] == 1 for k in range(0, 300, 3)]) > 0.9
    assert all(added[k] == 0 for k in range(300) if k % 3)


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE64 = LOWER.upper() + LOWER + DIGITS + "+/"


def planted(spark, signs, sizes, before="", ordinary=True, seed=5):
    """Random tokens of ``signs`` among ordinary runs, scanned: whether each was added whole."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        token = before + "".join(rng.choice(list(signs), sizes[k % len(sizes)]))
        rows.append((k, f"{prose(k + 1, 30)} {token} {prose(k + 2, 30)}", len(token)))
        if ordinary:
            rows.append((1000 + k, f"{prose(k + 1, 30)} averylongordinarywordinlowercase "
                                   "usr/share/some-place/with_names " + "-" * 40, 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, size int")
    found = {r["id"]: r["added"] for r in secrets.scan(frame).collect()}
    assert not any(found[r[0]] for r in rows if r[0] >= 1000)
    return np.array([[s["upto"] - s["at"] for s in found[r[0]]] == [r[2]]
                     for r in rows if r[0] < 1000])


def test_random_tokens_without_a_digit_are_added(spark):
    assert planted(spark, LOWER + LOWER.upper(), [20, 32, 48, 64]).mean() > 0.9


@pytest.mark.parametrize("signs", [LOWER + DIGITS, LOWER.upper() + DIGITS, LOWER + "234567"])
def test_random_tokens_of_one_case_pass_the_battery(spark, monkeypatch, signs):
    # Any token that the three tests let through has a chance below one, and is added here.
    monkeypatch.setattr(secrets, "discovery_limits", lambda tested, cfg: [1] * len(cfg.bands))
    sizes = [20, 32, 48, 64]
    passed = planted(spark, signs, sizes, ordinary=False).reshape(-1, len(sizes)).mean(axis=0)
    assert (passed > 0.95).all(), passed


def test_long_random_tokens_of_one_case_are_added(spark):
    assert planted(spark, LOWER + DIGITS, [64]).mean() > 0.9


def test_random_tokens_of_mixed_signs_are_added(spark):
    assert planted(spark, BASE64, [40, 64], before="live-key_").mean() > 0.9


def test_false_discoveries_are_held(spark):
    """Chances of ordinary tokens only, evenly spread: almost none may be accepted."""
    rows = [([((0, 3, 40, 40), float(np.log10((k + 0.5) / 2000)))],) for k in range(2000)]
    tested = spark.createDataFrame(
        rows, f"d array<struct<span:{secrets.SPAN},chance:double>>")
    limits = secrets.discovery_limits(tested, secrets.SecretSettings())
    assert limits[1] > 30


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    left = total
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] < share * weight[s] - 1e-9}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else share * weight[s]
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, none):
    assert mixing.taken_words(mixing.mix(none)).count() == 0
    assert mixing.apply_mix(none, mixing.mix(none)).count() == 0
    for cfg in (mixing.MixSettings(), mixing.MixSettings(block_rows=4, last_rows=2)):
        mixed = mixing.mix(docs, cfg=cfg)
        rows = mixing.taken_words(mixed).collect()
        sizes = defaultdict(int)
        for r in odd_rows():
            sizes[r[2]] += len(words_of(r[1]))
        target = brute_targets(sizes)
        assert Counter((r["id"], r["size"]) for r in rows) == Counter(
            (r[0], len(words_of(r[1]))) for r in odd_rows())
        by_size = {n: s for s, n in sizes.items()}
        taken = Counter()
        for r in rows:
            source = by_size[r["source_size"]]
            assert abs(r["target"] - target[source]) < 1e-6
            assert r["taken"] <= 3 * r["size"]
            taken[source] += r["taken"]
        # No more than its largest document from the target, and within the budget.
        assert sum(taken.values()) <= sum(sizes.values())
        for source, n in sizes.items():
            largest = max(len(words_of(r[1])) for r in odd_rows() if r[2] == source)
            assert taken[source] >= target[source] - 2 * largest
        out = mixing.apply_mix(docs, mixed, cfg=cfg)
        assert out.columns == docs.columns
        words = Counter()
        for r in out.collect():
            words[r["source"]] += len(words_of(r["text"]))
        assert words == +taken


def test_excess_is_shared_by_weight(spark):
    rng = np.random.default_rng(1)
    for _ in range(6):
        sizes = {f"s{k:02}": int(10 ** rng.uniform(0, 5)) for k in range(8)} | {None: 50}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


def test_sharding(docs, none):
    assert sharding.shuffle_into_shards(none).count() == 0
    cfg = sharding.ShardSettings(shards=6, block_rows=3)
    rows = sharding.shuffle_into_shards(docs, cfg=cfg).collect()
    assert Counter(r["id"] for r in rows) == Counter(r[0] for r in odd_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_matrix_is_exact_and_uniform():
    sizes, room = [30, 0, 50, 20], [34, 33, 33]
    drawn = np.array([sharding.communication_matrix(sizes, room, seed) for seed in range(400)])
    assert (drawn.sum(axis=2) == sizes).all() and (drawn.sum(axis=1) == room).all()
    assert abs(drawn[:, 0, 0].mean() - 30 * 0.34) < 0.4
    # Hypergeometric spread, not binomial.
    assert abs(drawn[:, 2, 0].var() - 50 * 0.34 * 0.66 * 50 / 99) < 1.2


def test_large_draws():
    rng = np.random.default_rng(0)
    good, bad, draws = 400_000_000, 800_000_000, 3_000_000
    found = np.array([sharding.draw_hypergeometric(rng, good, bad, draws) for _ in range(3000)])
    share = good / (good + bad)
    spread = (draws * share * (1 - share)) ** 0.5
    assert abs(found.mean() - draws * share) < 4 * spread / 3000 ** 0.5
    assert abs(found.std() / spread - 1) < 0.06
