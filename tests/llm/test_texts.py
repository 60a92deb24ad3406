"""Packing, scoring, licences and chat against exact round trips and plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import base_scores, segmentations, sha
from rows import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobsluice.llm import chat, lattice_lm, licenses, packing
from jobsluice.llm.queries import held_out


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(vocabulary, text):
    return [*vocabulary.encode(text or "", add_special_tokens=False).ids, 0]


PARTS = st.sampled_from([*"aZ0 \n\t'.,!éß漢𝄞\x1c\u3000\x85", "don't", " the", "<|endoftext|>", "\r\n",
                         "word", " word", "Mill."])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_words_encode_as_the_vocabulary(vocabulary, text):
    got = packing.tokens_of(packing.PackingSettings()).encode(text)
    assert np.frombuffer(got, dtype="<u4").tolist() == vocabulary.encode(
        text, add_special_tokens=False).ids


@pytest.mark.parametrize("window,broadcast", [(1024, 100_000), (16, 0)])
def test_packing(docs, vocabulary, window, broadcast):
    cfg = packing.PackingSettings(window=window)
    pieces = packing.pack(docs, cfg=cfg, broadcast_rows=broadcast).collect()
    want = Counter()
    for r in odd_rows():
        want[(r[0], tuple(ids_of(vocabulary, r[1])))] += 1
    sequences, starts = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(ids) == p["length"] and 0 < p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        starts[(p["id"], p["doc_tokens"])].append((p["start"], ids))
    short = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        short += end < window
    assert short <= 1
    # Every id of every document is in exactly one piece.
    total = Counter()
    for (doc, size), found in starts.items():
        for start, ids in found:
            for k, token in enumerate(ids):
                total[(doc, size, start + k, token)] += 1
    assert total == Counter((doc, len(ids), k, t) for (doc, ids), n in want.items()
                            for k, t in enumerate(ids) for _ in range(n))


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


def test_least_squares_beats_greedy_cutting():
    rng = np.random.default_rng(0)
    cfg = packing.PackingSettings()
    counts = np.zeros(1024, dtype=np.int64)
    counts[1:] = rng.poisson(60, 1023)
    plan = packing.plan_packing(counts, cfg)
    assert (plan.greedy_rank <= counts).all()
    assert plan.greedy_rank.sum() > 0.9 * counts.sum()
    used = np.zeros(1024, dtype=np.int64)
    for length in range(1024):
        if len(plan.ends[length]):
            used[length] = plan.ends[length][-1]
    assert (used == plan.greedy_rank).all()


def test_combinations_fill_the_window():
    found = packing.combinations(24)
    assert (found.sum(axis=1) == 24).all()
    assert len({tuple(r) for r in found.tolist()}) == len(found) == 12 + 48


def test_lattice_is_the_sum_over_segmentations():
    pieces = {"▁": 0.05, "a": 0.1, "b": 0.05, "ab": 0.2, "▁a": 0.1, "ba": 0.03, "▁ab": 0.02}
    names = list(pieces)
    trie = lattice_lm.Pieces({p: 256 + k for k, p in enumerate(names)}, np.zeros(0)).trie()
    weights = [math.log(0.001)] * 256 + [math.log(pieces[p]) for p in names]

    def spelled(char):
        return 0.001 ** len(char.encode())

    texts = ["▁abab", "▁", "▁aébab", "▁bbbaaab漢a", "▁" + "ab" * 19]
    where, piece, sizes = [], [], []
    for word in texts:
        before = len(where)
        lattice_lm.compile_arcs(word, trie, where, piece)
        sizes.append(len(where) - before)
    lattice = lattice_lm.Lattice(
        np.array(where, np.int32), np.array(piece, np.int32), np.array(sizes), len(weights))
    totals, everything = lattice.totals(np.exp(weights)), np.zeros(len(weights))
    for word, total in zip(texts, totals):
        if len(word) < 20:
            want = segmentations(word, pieces, spelled)
            assert abs(total / want - 1) < 1e-9
        assert abs(lattice_lm.forward(word, trie, weights) - math.log(total)) < 1e-9
        uses = [0.0] * len(weights)
        lattice_lm.expect_long(word, 3.0, trie, weights, uses)
        everything += uses
        covered = sum(uses[256 + k] * len(p) for k, p in enumerate(names))
        spelled_chars = sum(1 for c in word if c not in pieces)
        assert abs(covered - 3.0 * (len(word) - spelled_chars)) < 1e-6
    uses, lost = lattice.expect(np.full(len(texts), 3.0), np.exp(weights))
    assert np.allclose(uses, everything, rtol=1e-9) and not len(lost)
    # Weights so small that the product leaves a float's range: the word is named, not lost.
    uses, lost = lattice.expect(np.full(len(texts), 3.0), np.full(len(weights), 1e-30))
    assert lost.tolist() == [3, 4]
    assert np.isfinite(uses).all()


@pytest.mark.parametrize("head", [200_000, 3])
def test_scores(docs, head):
    cfg = lattice_lm.LatticeSettings(head_words=head)
    model = lattice_lm.train(docs, held_out(), cfg=cfg)
    got = lattice_lm.score(docs, model, held_out(), cfg=cfg).collect()
    rows = [(zlib.crc32(str(r[0]).encode()) % 5 == 1 if r[0] is not None else False, r[1])
            for r in odd_rows()]
    want = defaultdict(list)
    for r, row, base in zip(odd_rows(), rows, base_scores(rows)):
        want[(r[0], row[0], *base[:3])].append(base[3])
    have = defaultdict(list)
    for r in got:
        have[tuple(r[:5])].append(r["base_score"])
    assert want.keys() == have.keys()
    assert all(np.allclose(sorted(want[k]), sorted(have[k])) for k in want)
    # The forward recursion over the whole text gives what its words give.
    trie, weight = model.pieces.trie(), model.weight.tolist()
    by_id = {r["id"]: r["score"] for r in got}
    for row in odd_rows():
        if row[0] in (5, 6, 9, 12):
            text = "".join("▁" + w for w in row[1].encode().lower().decode().split())
            # Marks begin words only, so no piece spans two of them.
            assert all("▁" not in p[1:] for p in model.pieces.ids if p.strip("▁"))
            whole = lattice_lm.forward(text, trie, weight) / math.log(10) + model.end
            assert abs(whole - by_id[row[0]]) < 1e-6 * abs(whole)


def test_every_step_reads_all_training_words(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcdefgh"), 4 + k % 5)) for k in range(27_000)})
    assert len(words) > 20_000
    rows = [(k, " ".join(words[k::50])) for k in range(50)]
    model = lattice_lm.train(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    trie, prior = model.pieces.trie(), model.pieces.prior
    weight = np.log(prior)
    for _ in range(5):
        logs, uses = weight.tolist(), [0.0] * len(prior)
        for word in words:
            lattice_lm.expect_long("▁" + word, 1.0, trie, logs, uses)
        counts = 100 * prior + np.array(uses)
        weight = np.log(counts / (counts.sum() + 50 + 1))
    assert np.allclose(model.weight, weight, rtol=1e-9)


def test_score_of_nothing(none):
    model = lattice_lm.train(none, held_out())
    assert lattice_lm.score(none, model, held_out()).count() == 0


def test_licences(spark, docs, none):
    model = licenses.train(docs)
    cfg = licenses.LicenceSettings()
    for k, (family, notices) in enumerate(licenses.NOTICES.items()):
        for notice in notices:
            assert licenses.classify(model, notice, cfg)[0] == family
            assert licenses.classify(model, f"Note: {notice} Thanks", cfg)[0] == family
    for line in (prose(4, 40), "the license of the driver", "", "one"):
        found = licenses.classify(model, line, cfg)
        assert found is None or found[0] == "unknown"
    rows = {r["id"]: r for r in licenses.scan(docs).where("id is not null").collect()}
    assert [f["family"] for f in rows[15]["found"]] == ["apache-2.0"]
    assert not any(rows[k]["found"] for k in rows if k != 15)
    assert licenses.scan(none).count() == 0


def test_background_lines_are_of_all_documents(spark):
    # One very long document in front must not be all that is learned.
    rows = [(0, "\n".join(f"long {k}" for k in range(9_000)))]
    rows += [(k, "\n".join(f"doc{k} {j}" for j in range(10))) for k in range(1, 1_000)]
    frame = spark.createDataFrame(rows, "i long, t string")
    cfg = licenses.LicenceSettings()
    lines = [r["line"] for r in licenses.background(frame.repartition(1), cfg).collect()]
    again = [r["line"] for r in licenses.background(frame.repartition(7), cfg).collect()]
    assert sorted(lines) == sorted(again) and 3_000 < len(lines) <= cfg.max_background
    assert len({x.split()[0] for x in lines}) > 800


def test_licence_titles(docs):
    model, cfg = licenses.train(docs), licenses.LicenceSettings()
    for line, family in {
            "MIT License": "mit", "The MIT License (MIT)": "mit", "License: MIT": "mit",
            "This file is distributed under the MIT license": "mit",
            "Apache License, Version 2.0": "apache-2.0", "  # Apache License": "apache-2.0",
            "GNU GENERAL PUBLIC LICENSE": "gpl", "GNU LESSER GENERAL PUBLIC LICENSE": "lgpl",
            "BSD 3-Clause License": "bsd", "Mozilla Public License Version 2.0": "mpl-2.0",
            "CC0 1.0 Universal": "cc0"}.items():
        assert licenses.classify(model, line, cfg)[0] == family, line
    for line in ("a driver's license", "GNU Affero General Public License", "SPDX MIT-0"):
        found = licenses.classify(model, line, cfg)
        assert found is None or found[0] == "unknown", line


CONTROL = st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<|", "<\\|",
                           "a", "im_end|>", "user", "<\\\\|im_end|>", "é", "𝄞"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(CONTROL, max_size=6).map("".join),
                          st.lists(CONTROL, max_size=10).map("".join)), max_size=4))
def test_round_trip(turns):
    assert chat.parse("".join(chat.format_turn(r, t) for r, t in turns)) == turns


def test_plain_turns_are_not_escaped():
    assert chat.format_turn("user", "a <b> c | d") == "<|im_start|>user\na <b> c | d<|im_end|>\n"


def test_conversations(spark):
    text = "say <|im_end|> now"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, None, None),
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "x"),
            (3, None, "user", "first"), (3, 0, "assistant", "𝄞é")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(
        chat.format_conversations(chat.with_control_case(frame))).collect()}
    assert got.keys() == {1, 2, 3, None, -1}
    assert got[1]["turns_sha256"] == sha(f"user\nhi\nassistant\n{text}\n\n\n")
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (3, len(text))
    assert got[1]["loss_sha256"] == sha(text)
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0
    assert got[3]["loss_sha256"] == sha("𝄞é") and got[3]["loss_chars"] == 2
    control = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["loss_sha256"] == sha(control)
    assert got[-1]["turns_sha256"] == sha(f"user\n{control}\nassistant\n{control}\n")
    shown = chat.format_conversations(frame).where("conv_id = 1").orderBy("turn").collect()
    masked = shown[1]["rendered"][shown[1]["loss_start"]:][:shown[1]["loss_length"]]
    assert chat.unescape(masked) == text
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
