"""Case tables for the classifier and the functions under it."""

import pytest
from pyspark.sql import functions as F

from jobsluice.functions import boards, clean, cycles, dates, describe, identity, places, vocab
from jobsluice.functions.classify import NO_AI, classify
from jobsluice.operators import state
from jobsluice.session import materialise
from jobsluice.settings import Settings

NOV_2026 = 1_793_534_400
NO_AI = "no AI signal"

# title, location, AI-native employer, work term -> tier, reason
VERDICTS = [
    ("Machine Learning Intern", "Toronto, ON", False, "", "strict", "ai + student + ontario"),
    ("Software Engineer Intern", "Toronto, ON", True, "", "strict", "ai + student + ontario"),
    ("Software Engineer Intern", "Toronto, ON", False, "", "loose", NO_AI),
    ("ML Engineer - Summer 2027", "Remote, Canada", False, "", "strict", "ai + student + ontario"),
    ("ML Intern", "Toronto, ON", False, "Winter 2027", "loose", "earlier cycle"),
    ("ML Intern - Fall 2027", "Toronto, ON", False, "", "loose", "later cycle"),
    ("ML Intern - Fall 2026", "Toronto, ON", False, "", None, "cycle already passed"),
    ("ML Intern - Winter 2027, Summer 2027", "Toronto", False, "", "strict",
     "ai + student + ontario"),
    ("New Grad ML Engineer", "Toronto, ON", False, "", "loose", "new grad, not internship"),
    ("Senior ML Engineer", "Toronto, ON", False, "", None, "not student level"),
    ("ML Intern", "Vancouver, BC", False, "", None, "outside Ontario"),
    ("ML Intern", "Toronto, ON; Vancouver, BC", False, "", "strict", "ai + student + ontario"),
    ("ML Intern", "Ottawa, ON", False, "", None, "outside commute area"),
    ("ML Intern", "Ottawa, ON; Toronto, ON", False, "", "strict", "ai + student + ontario"),
    ("ML Intern", "Waterloo, IA", False, "", None, "outside Ontario"),
    ("ML Intern", "Waterloo, Ontario", False, "", "strict", "ai + student + ontario"),
    ("ML Intern", "Concord, CA", False, "", None, "outside Ontario"),
    ("ML Intern", "Markham, CA", False, "", "strict", "ai + student + ontario"),
    ("ML Intern", "Hybrid, on-site", False, "", None, "no Canadian location"),
    ("ML Intern", "Canada", False, "", "loose", "Canada, province not named"),
    ("ML Intern", "London, UK", False, "", None, "outside Ontario"),
    ("ML Intern", "SF", False, "", None, "outside Ontario"),
    ("ML Intern", "", False, "", None, "no Canadian location"),
    ("Analog Design Intern", "Toronto, ON", False, "", "other", "off-field"),
    ("ML Firmware Intern", "Toronto, ON", False, "", "strict", "ai + student + ontario"),
    ("Warehouse Student", "Toronto, ON", False, "", "other", "not tech"),
    ("Store Student", "Toronto, ON", False, "", None, "store or shift role"),
    ("IT Co-op", "Toronto, ON", False, "", "loose", NO_AI),
    ("Make it happen Co-op", "Toronto, ON", False, "", "other", "not tech"),
    ("Unpaid ML Intern", "Toronto, ON", False, "", None, "reject term"),
]


def test_verdicts(spark):
    rows = [(i, t, "Acme", loc, [], [term], "", "", native)
            for i, (t, loc, native, term, *_) in enumerate(VERDICTS)]
    df = spark.createDataFrame(
        rows, "i int, title string, company string, location string, loc_extra array<string>, "
              "cycle_extra array<string>, employment_type string, country string, "
              "ai_native boolean")
    got = {r["i"]: (r["tier"], r["reason"]) for r in classify(df, NOV_2026).select(
        "i", "verdict.tier", "verdict.reason").collect()}
    want = {i: tuple(v[4:]) for i, v in enumerate(VERDICTS)}
    assert {i: (VERDICTS[i], got[i]) for i in want if got[i] != want[i]} == {}


def test_description_makes_a_role_strict(spark):
    rows = [("Software Developer Co-op", "PyTorch, CUDA and MLOps"),
            ("Software Developer Co-op", "We are AI powered"), ("Software Developer Co-op", None)]
    df = spark.createDataFrame(rows, "title string, description string").selectExpr(
        "*", "'A' as company", "'Toronto' as location", "cast(array() as array<string>) as loc_extra",
        "cast(array() as array<string>) as cycle_extra", "'' as employment_type", "'' as country",
        "false as ai_native")
    got = classify(df, NOV_2026, description="description").select(
        "verdict.tier", F.array_join("verdict.ai_terms", ", ").alias("t")).collect()
    assert sorted(map(tuple, got)) == [("loose", ""), ("loose", ""),
                                       ("strict", "PyTorch, MLOps, CUDA")]


CASES = [
    (lambda c: F.array_join(cycles.parse_cycles(c, NOV_2026).cast("array<string>"), " "), [
        ("Summer 2026, Winter '27", "202605 202701"), ("2027 Winter - Dev", "202701"),
        ("Dev W27", "202701"), ("Dev, Winter", "202701"), ("Dev (Fall)", "202709"),
        ("Summer of code", ""), ("", "")]),
    (places.location_scope, [
        ("1 Hamilton Rd, Windsor, CT", "elsewhere"), ("Remote in Canada", "ontario"),
        ("Toronto, ONT, Canada", "ontario"), ("Québec", "elsewhere"), ("MONTRÉAL", "elsewhere"),
        ("London, on site", "unknown"), ("Cambridge, MA", "elsewhere"),
        ("Cambridge, Ontario", "ontario"), ("US-CT-WINDSOR LOCKS", "elsewhere"),
        ("Ontario, California", "elsewhere"), ("Brampton, Ontario, CA", "ontario")]),
    (identity.normalize_company, [
        ("Cohere Inc.", "cohere"), ("Bank of Montreal", "bmo"), ("A & B Ltd", "aandb"),
        ("Global Systems Canada", "")]),
    (identity.normalize_title, [
        ("Intern, ML Engineer", "engineer intern ml"), ("ML Co-op (Winter 2027) R-12345", "coop ml"),
        ("Data Internship - 4 months", "data intern")]),
    (identity.requisition_id, [
        ("https://x.com/c?gh_jid=123", "123"),
        ("https://t.wd1.myworkdayjobs.com/S/job/T/Dev_R-0000188001-1?x", "R0000188001"),
        ("https://x.com/jobs/12345-dev", "12345"), ("https://x.com/jobs/12", ""), ("", "")]),
    (lambda c: dates.parse_date(c, NOV_2026).cast("string"), [
        ("2026-10-01", "1790812800"), ("2026-10-01T12:00:00-0400", "1790870400"),
        ("1790812800000", "1790812800"), ("Posted Today", str(NOV_2026)), ("2026", "0"),
        ("soon", "0"), (None, "0")]),
    (lambda c: dates.parse_table_date(c, NOV_2026).cast("string"), [
        ("3d", str(NOV_2026 - 3 * 86400)), ("1mo", str(NOV_2026 - 30 * 86400)),
        ("Dec 31", "1767139200"), ("Oct 1", "1790812800"), ("Feb 30", "0"), ("", "0")]),
    (boards.board_of, [
        ("https://jobs.ashbyhq.com/Acme/0000abcd-1", "ashby Acme"),
        ("https://t.wd3.myworkdayjobs.com/en-US/Site/job/X/Y_R1",
         "workday https://t.wd3.myworkdayjobs.com/wday/cxs/t/Site/jobs"),
        ("https://wd3.myworkdaysite.com/recruiting/t/Site/job/X",
         "workday https://t.wd3.myworkdayjobs.com/wday/cxs/t/Site/jobs"),
        ("https://api.bamboohr.com/careers/1", None), ("https://x.com", None), (None, None)]),
    (clean.safe_url, [("HTTP://a.b", "HTTP://a.b"), ("javascript:x", ""), ("http://a\nb", "")]),
    (lambda c: F.array_join(describe.description_terms(c), ","), [
        ("LLMs and a transformer station", "LLMs"), ("transformers", "transformers"),
        ("gpt-4 chatbots", "LLM APIs,conversational AI"), ("our AI products", "")]),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_cases(spark, number):
    fn, pairs = CASES[number]
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(pairs)], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", fn(F.col("s")).alias("v")).collect()}
    assert {pairs[i][0]: got[i] for i in got if got[i] != pairs[i][1]} == {}


# One phrase for each way to write each term.
PHRASES = """machine learning|deep-learning|llms|LLM|large language models|pytorch|tensorflow|jax
scikit-learn|sklearn|train ml models|training the model|model training|fine-tuning|finetune|nlp
natural language processing|computer vision|mlops|rag|retrieval augmented|embeddings|vector store
vectordatabase|reinforcement learning|data science|data scientist|feature engineering|neural nets
neuralnetworks|transformers|transformer station|cuda|generative ai|genai|gen ai|ml engineer
ml  platform|ai agents|llm-agent|agentic|prompt engineering|promptdesign|prompts|openai|anthropic
claude|gemini|gpt-4|chatgpt|llama|mistral|azure openai|bedrock|vertex ai|langchain|langgraph
llama index|hugging face|autogen|crewai|model context protocol|chatbots|conversational ai|copilot
inference|model deployment|evals|ai features|ml applications|llm capability|ai-capabilities
ai assistants|ml workflows|ai integration|aimodels|ai pipelines|ml systems|ai/ml|plain words"""


def test_anchors_lose_no_term(spark):
    """Anchored matching names and counts what every pattern, tried on every text, does."""
    assert set(vocab.DESCRIPTION_ANCHORS) == {label for label, _ in vocab.DESCRIPTION_TERMS}
    phrases = PHRASES.replace("\n", "|").split("|")
    odd = str.maketrans("ski", "\u017f\u212a\u0130"), str.maketrans("i", "\u0131")
    texts = [form for p in phrases for form in (
        p, p.upper(), p.title(), p.translate(odd[0]), p.translate(odd[1]), f"x{p}y",
        f"{p} and {p.upper()}, {phrases[len(p) % 7]}")] + ["", None, " ".join(phrases)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    every = [(label, F.regexp_count("s", F.lit(f"(?iU){p}")))
             for label, p in vocab.DESCRIPTION_TERMS]
    terms = describe.description_terms(F.col("s"))
    rows = df.select(
        "s", terms.alias("terms"), describe.description_mentions(F.col("s")).alias("mentions"),
        describe.description_mentions(F.col("s"), terms).alias("again"),
        F.array(*[F.struct(F.lit(label).alias("label"), n.alias("n")) for label, n in every])
        .alias("every")).collect()
    for r in rows:
        counts = {x["label"]: x["n"] for x in r["every"]}
        assert r["terms"] == [label for label, n in counts.items() if n], r["s"]
        if r["s"] is not None:
            assert r["mentions"] == r["again"] == sum(counts.values()), r["s"]
    named = {label for r in rows for label in r["terms"]}
    assert named == set(vocab.DESCRIPTION_ANCHORS)


def test_new_description_rules_judge_stored_rows_once_more(spark):
    """Strict rules leave the row loose; other rules requeue and promote it; the same ones rest."""
    row = {c: None for c in state.JOBS_COLUMNS} | {
        "uid": "u1", "company": "Acme", "title": "Software Developer Intern (Summer 2027)",
        "location": "Toronto, ON", "source": "s", "tier": "loose", "reason": NO_AI,
        "first_seen": NOV_2026, "posted_at": NOV_2026, "group_id": "u1", "last_seen": NOV_2026,
        "misses": 0}
    jobs = spark.createDataFrame([tuple(row[c] for c in state.JOBS_COLUMNS)], state.JOBS_SCHEMA)
    described = spark.createDataFrame(
        [("u1", "LLMs and transformers, deep learning, computer vision, PyTorch", "", 0)],
        "uid string, text string, place string, posted bigint")
    reads = spark.createDataFrame([], state.DESCRIPTIONS_SCHEMA)
    rules = spark.createDataFrame([], state.RULES_SCHEMA)
    strict, tiers = Settings(desc_min_terms=90, desc_min_mentions=90), []
    for cfg in (strict, strict, Settings(), Settings()):
        before = reads
        reads, rules = state.requeue_for_rules(reads, jobs, rules, NOV_2026, cfg)
        queued = state.description_backlog(jobs, reads, None, NOV_2026, cfg).count()
        jobs = materialise(state.backfill(jobs, reads, described, NOV_2026, cfg), "jobs")
        reads = materialise(state.record_descriptions(reads, state.read_descriptions(
            described.withColumn("error", F.lit(None).cast("string")), NOV_2026)), "reads")
        tiers.append((queued, before.count(), jobs.first()["tier"]))
    assert tiers == [(1, 0, "loose"), (0, 1, "loose"), (1, 1, "strict"), (0, 1, "strict")]
    assert rules.count() == 1
