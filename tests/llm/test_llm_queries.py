"""The registered queries on the smallest tables, against DuckDB or plain versions."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import (
    base_scores,
    base_spans,
    components,
    fingerprint,
    quality_counts,
    sha,
    words_of,
)
from compare import differences, duck_connection

import __spark_entry__ as entry
import corpus_pipeline
from jobsluice.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(
        f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def of(name):
        if name not in found:
            found[name] = queries.QUERIES[name](spark, FOLDER).collect()
        return found[name]
    return of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duck_connection(FOLDER)
    assert not differences(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name])


def test_all_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} \
        == set(range(1, 14))
    assert "pipeline" in names


def test_quality(results, texts):
    rows = results("op2_quality_rules")
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:6]) == quality_counts(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_packing(results, texts):
    pieces = defaultdict(list)
    for r in results("op3_packing"):
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    import public_tokenizers
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[doc]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)


def test_scores(results, texts):
    ids = sorted(texts)
    rows = [(zlib.crc32(str(i).encode()) % 5 == 1, texts[i]) for i in ids]
    want = dict(zip(ids, base_scores(rows)))
    for r in results("op4_lattice_score"):
        assert tuple(r[2:5]) == want[r["doc_id"]][:3]
        assert abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 * abs(r["base_score"])
        assert r["score"] < 0


def test_licences(results, texts):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This work is licensed under the GNU General Public License, version 3.": "gpl",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "Released under the MIT License.": "mit"}
    for r in results("op5_license_scan"):
        want = {lines[x] for x in (texts[r["doc_id"]] or "").split("\n") if x in lines}
        assert r["families"] == ",".join(sorted(want))
        assert r["n_unknown"] == 0


def test_secrets(results, texts):
    for r in results("op7_secret_scan"):
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(spans)
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert ",".join(kept) == spans


def test_near_copies(results, texts):
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, components(ids, prints))}
    assert {r["doc_id"]: tuple(r[1:]) for r in results("op10_simhash_dedup")} == want


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "exact_copies", "near_copies", "mix_sources",
                           "pack_sequences"]

    def after(name, rows):
        out = stage[name](spark, spark.createDataFrame(rows, docs.schema), FOLDER)
        assert out.columns == columns or name == "pack_sequences"
        return out.collect()

    verdicts = {r["doc_id"]: r["kept"] for r in
                queries.op2_quality_rules(spark, FOLDER).collect()}
    first = after("quality_rules", docs.collect())
    assert {r["doc_id"] for r in first} == {i for i, kept in verdicts.items() if kept}
    second = after("exact_copies", first)
    largest = {}
    for r in first:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert Counter(r["doc_id"] for r in second) == Counter(largest.values())
    third = after("near_copies", second)
    ids = sorted(r["doc_id"] for r in second)
    comps = components(ids, [fingerprint(texts[i]) for i in ids])
    assert Counter(r["doc_id"] for r in third) == Counter(set(comps))
    fourth = after("mix_sources", third)
    have, size = Counter(), Counter()
    for r in third:
        size[r["source"]] += len(words_of(r["text"]))
    for r in fourth:
        have[r["source"]] += len(words_of(r["text"]))
    assert max(Counter(r["doc_id"] for r in fourth).values()) <= 3
    assert sum(have.values()) <= sum(size.values())
    assert all(n <= 3 * size[s] for s, n in have.items())
    fifth = after("pack_sequences", fourth)
    per_doc = Counter(r["doc_id"] for r in fourth)
    tokens = Counter()
    for r in fifth:
        tokens[r["doc_id"]] += r["length"]
    for r in fifth:
        assert tokens[r["doc_id"]] == r["doc_tokens"] * per_doc[r["doc_id"]]


def test_whole_pipeline(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_classifier(results, texts):
    rows = results("op13_quality_classifier")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"        # the smallest tables hold 19 held-out labels
    labels = dict(duckdb.connect().execute(
        f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES["op13_quality_classifier"](spark, folder).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
