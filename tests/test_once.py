"""Work that several readers share is done once, and Python gets small values."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsluice.functions import clean
from jobsluice.functions.dates import first_date
from jobsluice.operators.discovery import board_evidence
from jobsluice.plans.run import empty_state, run
from jobsluice.sources import trackers
from jobsluice.sources.base import LANDED_SCHEMA, POSTING_SCHEMA, flat, label, records, scalar
from jobsluice.sources.careers import embedded_postings
from jobsluice.sources.details import extract_descriptions
from jobsluice.sources.json_boards import resolve_multi_location
from jobsluice.streaming import increment

T0 = 1793534400


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_evidence_of_boards_is_judged_once(spark):
    rows = spark.createDataFrame(
        [("Acme", "ML Intern", "Toronto, ON", "u", str(i), "s", False, 0, [], [], "", "", "", "",
          "lever", "a") for i in range(3)], POSTING_SCHEMA + ", platform string, token string")
    answered = spark.createDataFrame([("lever", "a"), ("lever", "b")],
                                     "platform string, token string")
    found = board_evidence(rows, T0, answered=answered)
    # The union and its anti join read it; neither repeats the rules over the rows.
    assert "rlike" not in plan(found)
    assert {r["token"]: (r["jobs"], r["student"]) for r in found.collect()} == {
        "a": (3, 3), "b": (0, 0)}


def test_rows_of_a_run_are_recorded_once(spark):
    sources = spark.createDataFrame(
        [], "label string, name string, platform string, token string, kind string, "
        "ai_native boolean, location string, country string")
    body = json.dumps({"jobs": [{"id": 1, "title": "ML Intern", "absolute_url": "https://x.io/1",
                                 "location": {"name": "Toronto, ON"}}]})
    landed = spark.createDataFrame(
        [("Acme", "greenhouse", "acme", "Acme", "", T0, 0, True, body)], LANDED_SCHEMA)
    jobs = run(landed, sources, empty_state(spark), T0).state.jobs
    # Stored and new rows read the same recorded table: fingerprints are made before it.
    assert "sha1" not in plan(jobs)
    assert [(r["uid"], r["misses"]) for r in jobs.collect()] == [("greenhouse:acme:1", 0)]


def test_a_streamed_run_publishes_a_stored_jobs_table(spark, tmp_path, monkeypatch):
    sources = spark.createDataFrame(
        [], "label string, name string, platform string, token string, kind string, "
        "ai_native boolean, location string, country string")
    body = json.dumps({"jobs": [{"id": 1, "title": "ML Intern", "absolute_url": "https://x.io/1",
                                 "location": {"name": "Toronto, ON"}}]})
    spark.createDataFrame([("Acme", "greenhouse", "acme", "Acme", "", T0, 0, True, body)],
                          LANDED_SCHEMA).write.parquet(f"{tmp_path}/landing")
    met = []
    monkeypatch.setattr(increment, "publish_state", lambda after, *rest: met.append(
        (plan(after.jobs), [r["uid"] for r in after.jobs.collect()])))
    increment.run_increment(spark, f"{tmp_path}/landing", f"{tmp_path}/state",
                            f"{tmp_path}/checkpoint", sources, T0).awaitTermination()
    # It is read twice from there on: no join may be left to do.
    assert "join" not in met[0][0] and met[0][1] == ["greenhouse:acme:1"]


def test_python_decodes_rows_not_tables(spark, tmp_path, monkeypatch):
    log = str(tmp_path)

    @F.pandas_udf(T.StringType())
    def decode(text: pd.Series) -> pd.Series:
        import html
        import uuid
        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(max(len(s or "") for s in text)))
        return text.map(lambda s: None if s is None else html.unescape(s))

    monkeypatch.setattr(clean, "_decode", decode)
    lines = "".join(f"| A &amp; B {i} | Data Intern | Toronto | [x](https://a.io/{i}?a=1&amp;b=2) |\n"
                    for i in range(500))
    body = "| Company | Role | Location | Application |\n|---|---|---|---|\n" + lines
    files = spark.createDataFrame(
        [("s", "Acme", "o/r", "main", "README.md", T0, body)],
        "source string, company string, repo string, branch string, path string, "
        "fetched_at bigint, body string")
    rows = trackers.tracker_tables(files, T0).select("company", "url").collect()
    assert {(r["company"], r["url"]) for r in rows} == {
        (f"A & B {i}", f"https://a.io/{i}?a=1&b=2") for i in range(500)}
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) < 200


def test_a_date_reads_its_text_once(spark):
    jobs = records(spark.createDataFrame([("[]",)], "body string"), "$")
    dated = jobs.select(first_date(scalar("a"), scalar("b"), as_of=T0).alias("d"))
    assert plan(dated).count("try_variant_get") == 3  # with the one that finds the records


def test_fields_under_many_keys_are_looked_up_at_once(spark):
    jobs = records(spark.createDataFrame(
        [('[{"term": "x", "location": {"name": "A \\"1\\""}, "offices": [true, {"name": ""}, 3]},'
          '{"offices": [[[["in", ["out"]]]], "B", {"a": "C"}, {"a": "D"}, {"a": "E"}]}, 5]',)],
        "body string"), "$")
    found = jobs.select(flat(["location", "offices"]).alias("out"))
    assert plan(found).count("try_variant_get") == 2
    assert [r["out"] for r in found.collect()] == [
        ['A "1"', "remote", ""], ["in", "B", "C", "D", "E"], []]


def test_labels_of_every_shape(spark):
    jobs = records(spark.createDataFrame([(json.dumps([
        {"a": " x "}, {"a": {"city": "", "title": "t", "text": " u "}}, {"a": ["p", {"name": "q"}]},
        {"a": "[s"}, {"a": "{s"}, {"a": []}, {"a": {}}, {"a": None}, {"a": 5}, {}, "a"]),)],
        "body string"), "$")
    got = jobs.select(label("a").alias("a")).collect()
    assert [r["a"] for r in got] == ["x", "u", "p, q", "[s", "{s", "", "", "", "5", "", ""]
    # The fields of an object are read in one go.
    assert "schema_of_variant" not in plan(jobs.select(label("a")))
    assert "['city']" not in plan(jobs.select(label("a")))


def test_postings_of_a_page_are_parsed_once(spark):
    pages = spark.createDataFrame([("s", "u", 1, ['{"title": "A"}', '{"title": ""}', "{"])],
                                  "source string, url string, fetched_at long, nodes array<string>")
    found = embedded_postings(pages, T0)
    assert plan(found).count("parsejson") == 1
    assert [(r["pos"], r["title"]) for r in found.collect()] == [(0, "A")]


def test_python_reads_a_detail_once(spark):
    rows = spark.createDataFrame([("1", "https://a.b/1", "")],
                                 "uid string, url string, inline_description string")
    details = spark.createDataFrame([("https://a.b/1", 1, "<p>a &amp;amp; b</p>")],
                                    "url string, fetched_at long, body string")
    found = extract_descriptions(rows, details, T0)
    assert plan(found).count("_decode_twice(") == 1 and plan(found).count("job_nodes(") == 1
    assert [(r["uid"], r["text"]) for r in found.collect()] == [("1", "a & b")]


def test_places_of_a_detail_are_parsed_once(spark):
    rows = spark.createDataFrame(
        [("c", title, place, "https://x.y/en-US/Jobs/job/1", uid, "s", False, 0, [], [], "", "",
          "", "") for uid, title, place in [("1", "ML Intern", "2 Locations"), ("2", "Cook", "A")]],
        POSTING_SCHEMA)
    body = json.dumps({"jobPostingInfo": {"location": "A", "additionalLocations": ["B"]}})
    details = spark.createDataFrame(
        [("s", "/job/1", 1, body)],
        "source string, external_path string, fetched_at long, body string")
    found = resolve_multi_location(rows, details, T0)
    # The rows, whose keys are counted before they are joined, are stored by then.
    assert plan(found).count("parsejson") == 1
    assert plan(found).count("rlike") == 0
    assert {r["uid"]: r["location"] for r in found.collect()} == {"1": "A, B", "2": "A"}
