"""Divergence and filter audits and the factorisation machine against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from brute import lower_ascii, words_of
from rows import odd_rows, prose

from jobsluice.llm import divergence, factor_machine, filter_audit

KINDS = "doc_id long, text string, lang string, source string, term string, share long, n long"
LABELS = "doc_id long, quality int, toxic int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def group_rows():
    """Many sources and few words each; nulls, empty texts, clashing columns, a hot source."""
    pick, rows = random.Random(4), []
    for k in range(260):
        lang = [None, "", "de", "en"][k % 4]
        source = None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 17}"
        text = None if k % 19 == 0 else "" if k % 23 == 0 else \
            prose(pick.randrange(40), pick.randrange(1, 50)).upper() + " Ärger-ÄRGER x1y z"
        rows.append((k, text, lang, source, "t", 1, 2))
    rows += [(900, "one two", "lone", "only", "t", 1, 2), (901, prose(8, 30_000), "en", "s1", "", 0, 0),
             (5, prose(1, 9), "de", "s5", None, None, None)] * 2
    return rows


def plain_divergence(rows, min_docs):
    docs = [((lang or ""), (source or ""), TERM.findall(lower_ascii(text)))
            for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, mine = Counter(), [d for d in docs if d[0] == lang]
        for _, _, terms in mine:
            held.update(set(terms))
        kept = sorted(t for t in held if held[t] >= min_docs)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        whole = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for source in counts:
            pairs = [(-sum(abs(share(counts[source], t) - share(counts[o], t)) for t in kept), o)
                     for o in counts if o != source]
            terms = [(share(whole, t) - share(counts[source], t), t) for t in kept
                     if counts[source][t] and share(counts[source], t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(
                    terms, key=lambda x: (x[0], x[1].encode()))[:50])):
                out += [(lang, source, part, item, -v, at + 1)
                        for at, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(3, 8), (32, 4096)])
def test_divergence(spark, blocks):
    rows = group_rows()
    cfg = divergence.DivergenceSettings(
        min_docs=6, group_block=blocks[0], term_block=blocks[1], held_terms=300)
    docs = spark.createDataFrame(rows, KINDS).repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, cfg).collect()))
    want = plain_divergence(rows, 6)
    assert got == want
    assert {r[2] for r in want} == {"pair", "term"}
    assert any(r[2] == "pair" and r[4] > 0 for r in want)


def test_divergence_of_groups_without_terms(spark):
    rows = [(1, None, None, "a", "", 0, 0), (2, "", None, None, "", 0, 0)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, KINDS)).collect()))
    assert got == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], KINDS)).isEmpty()


def plain_counts(text):
    words = words_of(text)
    return (len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text),
            sum(c in "#$%&*|" for c in text))


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_transducer(block):
    pick = random.Random(block)
    texts = [r[1] or "" for r in odd_rows() if len(r[1] or "") < 3000]
    texts += ["".join(pick.choice("Aaäß€😀 \n\t#|x\x85 \x1f") for _ in range(pick.randrange(60)))
              for _ in range(200)]
    for text in texts:
        assert filter_audit.transduce(text.encode(), block) == plain_counts(text)


def plain_audit(rows, labels, min_words):
    firsts, good, toxic = {}, set(), set()
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, q, t in labels:
        if i is not None and q == 1:
            good.add(i)
        if i is not None and t == 1:
            toxic.add(i)
    parts = defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        words, distinct, capitals, points, symbols = plain_counts(text)
        fails = {"A": words < min_words, "B": 100 * distinct < 50 * words,
                 "C": 100 * capitals > 3 * points, "D": symbols > 0,
                 "E": i is not None and text in firsts and firsts[text] < i}
        parts[lang or ""].append((i, {f for f in fails if fails[f]}))
    out = []
    for part, docs in parts.items():
        mine, total = [], Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                total[letter] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone),
                             sum(letter in d[1] for d in docs) - len(gone),
                             sum(d[1] == {letter} for d in docs),
                             sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def test_filter_audit(spark):
    pick = random.Random(9)
    rows = [(r[0], r[1], [None, "", "en", "de"][k % 4], r[2], "x", 0, 0)
            for k, r in enumerate(odd_rows())]
    rows += [(None, "no id", "en", "s", "x", 0, 0), (7, prose(3, 60) + " x", "en", "s", "x", 0, 0)]
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1])) for k in range(250)]
    labels += [(None, 1, 1), (3, 1, 0), (3, 0, 1), (100_000, 1, 1)]
    cfg = filter_audit.AuditSettings(min_words=40, block=512)
    got = filter_audit.audit(spark.createDataFrame(rows, KINDS).repartition(4),
                             spark.createDataFrame(labels, LABELS), cfg=cfg)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant",
                           "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels, 40)


def test_filter_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], KINDS)
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).isEmpty()


@pytest.fixture(scope="module")
def judged(spark):
    """Prose is good; lines of signs, shouting and repeats are not."""
    pick, rows, labels = random.Random(2), [], []
    for k in range(300):
        text = prose(k, pick.randrange(40, 200))
        if k % 5 == 0:
            text = [text.upper() + "!!", re.sub(" ", " | ", text), "again. " * 90][k // 5 % 3]
        rows.append((k, text, "en", "s", "x", 0, 0))
        if k != 7:
            labels.append((k, int(k % 5 > 0), 0))
    labels += [(8, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (4000, 0, 0)]
    return (spark.createDataFrame(rows, KINDS).repartition(3),
            spark.createDataFrame(labels, LABELS), rows)


CFG = factor_machine.FactorSettings(buckets=256, factors=3, iterations=40)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_tells_held_out_rows_apart(spark, judged):
    docs, labels, rows = judged
    learned = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = factor_machine.train(docs, learned, cfg=CFG)
    got = {r.id: r.score for r in factor_machine.score(docs, model, cfg=CFG).collect()}
    assert set(got) == {r[0] for r in rows}
    right = [(s >= 0.3) == (i % 5 > 0) for i, s in got.items() if held(i)]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_classifier_scores_in_linear_time_what_pairs_say(spark, judged):
    docs, labels, rows = judged
    made = factor_machine.labelled_features(docs, labels, cfg=CFG)
    vectors = factor_machine._vectors(CFG)
    data = vectors.fit(made).transform(made)
    from pyspark.ml.classification import FMClassifier
    fitted = FMClassifier(factorSize=3, maxIter=5, seed=1, initStd=0.3).fit(
        data.select("label", "features"))
    model = factor_machine.FactorModel(
        float(fitted.intercept), fitted.linear.toArray(), fitted.factors.toArray())
    for row in fitted.transform(data).limit(40).collect():
        words, levels = ([int(x) for x in row[c]] for c in ("words", "levels"))
        got = model.score(words, levels, CFG)
        x = row.features.toArray()
        at = np.flatnonzero(x)
        margin = model.bias + model.weights @ x + sum(
            float(model.vectors[a] @ model.vectors[b]) * x[a] * x[b]
            for k, a in enumerate(at) for b in at[k + 1:])
        assert got == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
        assert got == pytest.approx(row.probability[1], abs=1e-9)


def test_classifier_features():
    words, levels = factor_machine.features("", CFG)
    assert words == [] and levels == sorted(levels)
    long = prose(3, 300_000)
    words, levels = factor_machine.features(long, CFG)
    assert set(words) == {zlib.crc32(w.encode()) % 256 for w in set(long.split())}
    assert factor_machine.features("a b", CFG) == factor_machine.features("a b", CFG)


def test_classifier_copes_with_odd_rows(spark, docs, none):
    for labels, score in (([], 0.5), ([(7, 1, 0), (3, 1, 0)], 5 / 6)):
        model = factor_machine.train(docs, spark.createDataFrame(labels, LABELS), cfg=CFG)
        got = factor_machine.score(docs, model, cfg=CFG).collect()
        assert len(got) == len(odd_rows())
        assert {round(r.score, 9) for r in got} == {round(score, 9)}
    assert factor_machine.score(none, model, cfg=CFG).isEmpty()
