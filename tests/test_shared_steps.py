"""What a run's steps share is made once: keys, fingerprints, terms, dates and links."""

import json

from pyspark.sql import functions as F

from jobsluice.functions import clean, identity, vocab
from jobsluice.functions.boards import board_of, with_board
from jobsluice.operators import state
from jobsluice.operators.roles import KEYS, with_role_keys
from jobsluice.sources import careers, sitemaps
from jobsluice.sources.base import LANDED_SCHEMA, POSTING_SCHEMA
from jobsluice.streaming import increment

T0 = 1793534400


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_role_keys_read_a_link_once(spark):
    rows = spark.createDataFrame(
        [("Acme Inc.", "ML Intern", "https://www.x.io/jobs/12345"), ("Acme", "ML Intern", None)],
        "company string, title string, url string")
    keyed = with_role_keys(rows)
    # The id is in two keys and in the tests of both.
    assert plan(keyed).count(vocab.REQ_PATH.lower()) == 1
    assert [[r[k] for k in KEYS if r[k]] for r in keyed.collect()] == [r["k"] for r in rows.select(
        identity.role_keys(F.col("company"), F.col("title"), F.col("url")).alias("k")).collect()]
    assert [r["key_req"] for r in keyed.where("url is not null").collect()] == ["req:acme:12345"]
    # A fingerprint that is known is not made again.
    known = with_role_keys(rows.withColumn("key_fp", F.lit("fp:known")))
    assert "sha1" not in plan(known)
    assert {r["key_fp"] for r in known.collect()} == {"fp:known"}


def test_the_jobs_table_takes_the_fingerprint_that_keys_were_made_of(spark):
    verdict = "struct<tier:string,reason:string,ai_terms:array<string>>"
    rows = spark.createDataFrame(
        [("Acme", "ML Intern, Summer 2027", "Toronto", "u", "a", "s", False, 0, [], [], "", "", "",
          "", ("strict", "why", []), "g", False, False, False, "print")],
        f"{POSTING_SCHEMA}, verdict {verdict}, group_id string, seeded boolean, "
        "notified boolean, digested boolean, _fingerprint string")
    made = state.job_rows(rows, T0)
    assert "sha1" not in plan(made)
    # The terms are parsed once for their label, which reads them three times.
    assert plan(made).count(vocab.CYCLE_BARE.lower()) == 1
    row = made.first()
    assert (row["fingerprint"], row["term"]) == ("print", "Summer 2027")
    assert state.job_rows(rows.drop("_fingerprint"), T0).first()["fingerprint"] == rows.select(
        identity.fingerprint(F.col("company"), F.col("title"))).first()[0]


def test_patterns_of_boards_are_tried_on_their_anchors(spark):
    links = ["https://JOBS.Lever.co/Acme/0000abcd-0000", "https://Job-Boards.eu.Greenhouse.io/a/jobs/1",
             "https://boards.greenhouse.io/embed/job_app?x=1&for=b", "https://c.Eightfold.ai/Careers/job/1",
             "https://a.wd5.myworkdayjobs.com/en-US/S/job/x", "https://wd5.myworkdaysite.com/recruiting/a/S/job/x",
             "https://e.fa.ca2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/1",
             "https://d.com/jobs/1?ICIMS=1", "https://x.iCIMS.com/jobs/1/dev", "https://s.com/Job/T/600000/",
             "https://a.b.jobs.personio.de/job/1", "https://x.io/1", "", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "i int, url string")
    found = {r["i"]: r["platform"] for r in with_board(rows, keep_all=True).collect()}
    assert [found[i] for i in range(len(links))] == [
        "lever", "greenhouse", "greenhouse", "eightfold", "workday", "workday", "oracle", "jibe",
        "icims", "successfactors", "personio", None, None, None]
    assert [r[0] and r[0].split()[0] for r in rows.orderBy("i").select(
        board_of(F.col("url"))).collect()] == [found[i] for i in range(len(links))]
    patterns = [vocab.WORKDAY_POSTING, vocab.WORKDAY_SITE_POSTING, vocab.ORACLE_POSTING,
                vocab.EIGHTFOLD_POSTING, vocab.JIBE_POSTING, vocab.ICIMS_POSTING,
                vocab.SUCCESSFACTORS_POSTING, *[p for _, p in vocab.SLUG_POSTINGS]]
    assert list(vocab.BOARD_ANCHORS) == patterns
    tested = plan(with_board(rows, keep_all=True))
    assert all(anchor in tested for anchor in vocab.BOARD_ANCHORS.values())


def test_a_streamed_run_publishes_stored_tables(spark, tmp_path, monkeypatch):
    sources = spark.createDataFrame(
        [], "label string, name string, platform string, token string, kind string, "
        "ai_native boolean, location string, country string")
    body = json.dumps({"jobs": [{
        "id": 1, "title": "ML Intern", "location": {"name": "Toronto, ON"},
        "absolute_url": "https://jobs.lever.co/acme/0000abcd-0000-4000-8000-000000000001"}]})
    spark.createDataFrame([("Acme", "greenhouse", "acme", "Acme", "", T0, 0, True, body)],
                          LANDED_SCHEMA).write.parquet(f"{tmp_path}/landing")
    met = {}
    monkeypatch.setattr(increment, "publish_state", lambda after, *rest: met.update({
        name: (plan(getattr(after, name)), getattr(after, name).count())
        for name in ("jobs", "role_keys", "discovered", "candidates")}))
    increment.run_increment(spark, f"{tmp_path}/landing", f"{tmp_path}/state",
                            f"{tmp_path}/checkpoint", sources, T0).awaitTermination()
    # Digests and writes read each of them: nothing may be left to do.
    assert not any("join" in made or "aggregate" in made for made, _ in met.values())
    assert {name: n for name, (_, n) in met.items()} == {
        "jobs": 1, "role_keys": 3, "discovered": 1, "candidates": 1}


def test_entries_of_sitemaps_are_dated_once(spark):
    root = "https://x.io/sitemap.xml"
    entry = "<url><loc>https://x.io/{}/1</loc><lastmod>2026-10-31</lastmod></url>"
    child = "https://x.io/jobs.xml"
    files = spark.createDataFrame(
        [("a", "Acme", root, p, T0, root, b) for p, b in [
            (None, f"<urlset>{entry.format('jobs')}{entry.format('about')}</urlset>"),
            ("ABOUT", f"<urlset>{entry.format('jobs')}{entry.format('about')}</urlset>")]]
        + [("b", "Acme", root, "", T0, root,
            f'<s:sitemapindex xmlns:s="http://s.org"><s:sitemap ><s:loc>{child}</s:loc></s:sitemap>'
            "</s:sitemapindex>"),
           ("b", "Acme", root, "", T0, child, f"<urlset>{entry.format('jobs')}</urlset>")],
        "source string, company string, sitemap_url string, pattern string, fetched_at bigint, "
        "url string, body string")
    found = sitemaps.sitemap_entries(files, T0)
    assert plan(found).count("just posted") == 1
    assert sorted((r["source"], r["loc"], r["modified"] > 0) for r in found.collect()) == [
        ("a", "https://x.io/about/1", True), ("a", "https://x.io/jobs/1", True),
        ("b", "https://x.io/jobs/1", True)]
    # A file that names no children is not parsed for them.
    assert sitemaps.CHILD_TAG in plan(found)


def test_links_of_careers_pages_are_made_once(spark):
    pages = spark.createDataFrame(
        [("s", "Acme", "https://x.io/careers", T0, "<a href='/jobs/1'>Engineer</a>"
          "<a href='https://y.com/1'>Other</a><a href='https://y.com/job/2'>A job</a>")],
        "source string, company string, url string, fetched_at bigint, html string")
    found = careers.page_links(pages)
    # The rules of relative links stand in the plan once, whatever reads the link.
    once = plan(pages.select(clean.absolute_url(F.col("url"), F.col("html"))))
    marker = "|$)"
    assert 0 < plan(found).count(marker) <= once.count(marker)
    assert sorted(r["url"] for r in found.collect()) == [
        "https://x.io/jobs/1", "https://y.com/job/2"]
