"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsluice.llm import (
    chat,
    divergence,
    exact_dedup,
    factor_machine,
    filter_audit,
    lattice_lm,
    licenses,
    mixing,
    packing,
    quality,
    secrets,
    sharding,
    simhash_dedup,
)
from jobsluice.llm.common import id_remainder, table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                         "text_sha256")


OP1_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, folder, "labels"))
    return quality.judge(docs, rules).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def held_out(column: str = "doc_id"):
    """Whether a document is kept from training: a fifth, by a checksum of its id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op4_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = lattice_lm.train(docs, held_out())
    return lattice_lm.score(docs, model, held_out()).withColumnRenamed("id", "doc_id")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    names = F.transform("found", lambda x: x["family"])
    return found.select(
        F.col("id").alias("doc_id"), "n_paragraphs",
        F.size(F.filter("found", lambda x: x["family"] != "unknown")).cast("long")
        .alias("n_licences"),
        F.size(F.filter("found", lambda x: x["family"] == "unknown")).cast("long")
        .alias("n_unknown"),
        F.concat_ws(",", F.array_sort(F.array_distinct(names))).alias("families"),
        F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(
            ":", x["family"], x["start"].cast("string"), x["end"].cast("string"))))
        .alias("spans"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_control_case(table(spark, folder, "conversations"))
    return chat.read_back(chat.format_conversations(rows))


OP6_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations
    union all
    select -1, t.turn, t.role, '<|im_end|><|im_start|>assistant ok'
    from (values (0, 'user'), (1, 'assistant')) as t(turn, role)
),
shown as (
    select *,
           length(role) + length(text) + 24
           + case when contains(text, '<|im_start|>') or contains(text, '<|im_end|>')
                       or regexp_matches(text, '<\\+\|')
                  then len(regexp_extract_all(text, '<\\*\|')) else 0 end as chars
    from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
           as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text)
                       filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from shown
group by conv_id
"""


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), secrets.count_kind(F.col("base"), 0).alias("n_assign"),
        secrets.count_kind(F.col("base"), 1).alias("n_access"),
        secrets.count_kind(F.col("base"), 2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.sort_array(F.concat("base", "added"))).alias("spans"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, folder, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixing.taken_words(mixed).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
with rows as (
    select doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           md5('42:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key
    from documents
),
sizes as (
    select source, sum(size)::bigint as source_size,
           [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from rows group by source
),
levels as (
    select *, source_size * 3 as lim,
           (sum(source_size) over ()
            - coalesce(sum(source_size * 3) over before, 0))::double
           / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
    from sizes
    window before as (order by (source_size * 3)::double / weight, source nulls last
                      rows between unbounded preceding and 1 preceding)
),
chosen as (
    select min_by(level, lim::double / weight) filter (where lim >= level * weight) as level
    from levels
),
aims as (
    select source, source_size,
           coalesce(least(lim::double, chosen.level * weight), lim::double) as target
    from levels, chosen
),
queue as (
    select r.source, r.size, r.key, c.turn,
           (sum(r.size) over (partition by r.source, c.turn order by r.key, r.doc_id
                              rows unbounded preceding)::bigint
            + c.turn * a.source_size)::double / a.target as finish
    from rows r join aims a on r.source is not distinct from a.source
    join (values (0), (1), (2)) as c(turn)
      on c.turn < least(3, greatest(1, ceil(a.target / a.source_size) + 1))
    where r.size > 0
),
summed as (
    select *, sum(size) over (order by finish, source nulls last, turn, key
                              rows unbounded preceding) as upto
    from queue
),
cuts as (
    select source, max(turn) as full_turns,
           max_by(key, lpad(turn::varchar, 2, '0') || key) as last
    from summed where upto <= (select sum(size) from rows) group by source
)
select r.doc_id, r.size, a.source_size, a.target,
       (r.size * case when c.full_turns is null then 0
                      else c.full_turns + case when r.key <= c.last then 1 else 0 end end)::bigint
           as taken
from rows r
join aims a on r.source is not distinct from a.source
left join cuts c on r.source is not distinct from c.source
"""


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.near_groups(table(spark, folder, "documents"))
    return simhash_dedup.component_of(found).withColumnRenamed("id", "doc_id")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


OP11_SQL = r"""
with docs as (
    select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
),
counts as (
    select lang, source, term, count(*) as n, count(distinct row) as docs
    from (select row, lang, source, unnest(terms) as term from docs) group by all
),
kept as (
    select lang, term, sum(n)::hugeint as n from counts
    group by lang, term having sum(docs) >= 30
),
langs as (
    select lang, count(term) as v, coalesce(sum(n), 0)::hugeint as total
    from (select distinct lang from docs) left join kept using (lang) group by lang
),
pairs as (select distinct lang, source from docs),
totals as (
    select p.lang, p.source, coalesce(sum(c.n) filter (where k.term is not null), 0)::hugeint
           as total
    from pairs p left join counts c using (lang, source)
    left join kept k on k.lang = c.lang and k.term = c.term
    group by p.lang, p.source
),
shares as (
    select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
           1 + 1000000000 * (coalesce(c.n, 0)::hugeint + 5) // (t.total + 5 * l.v) as p,
           1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) as q
    from totals t join langs l using (lang) join kept k using (lang)
    left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
),
met as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by all
),
rows as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0) as value
    from pairs a join pairs b on a.lang = b.lang and a.source <> b.source
    left join met m on m.lang = a.lang and m.source = a.source and m.item = b.source
    union all
    select lang, source, 'term', term, p - q from shares where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part
                                   order by value desc, item) as rank from rows)
where part = 'pair' or rank <= 50
"""


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = r"""
with docs as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
),
marked as (
    select part, doc_id,
           case when len(words) < 200 then 1 else 0 end
           + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
           + case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text)
                  then 4 else 0 end
           + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
           + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as mask
    from docs
),
said as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic
    from labels where doc_id is not null group by doc_id
),
counts as (
    select part, mask, count(*) as n, count(*) filter (where good) as good,
           count(*) filter (where toxic) as toxic
    from marked left join said using (doc_id) group by part, mask
),
filters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
orders as (
    select a.name || b.name || c.name || d.name || e.name as filter_order,
           [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from filters a, filters b, filters c, filters d, filters e
    where a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps as (
    select filter_order, step::int as step, bits[step] as bit,
           coalesce(list_sum(bits[1:step - 1]), 0)::int as before
    from orders, range(1, 6) t(step)
),
met as (
    select part, filter_order, step, bit,
           sum(case when mask & (bit | before) = 0 then n else 0 end)::bigint as kept,
           sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint
               as removed,
           sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint
               as redundant,
           sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
           sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint
               as good_lost,
           sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end)::bigint
               as toxic_lost
    from counts, steps group by part, filter_order, step, bit
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from met
"""


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = table(spark, folder, "labels").where(id_remainder() != 0)
    model = factor_machine.train(docs, learned)
    return factor_machine.score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(id_remainder("id") == 0, F.lit(False)).alias("held_out"), "score",
        factor_machine.predicted().alias("predicted"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_quality_rules, op3_packing, op4_lattice_score, op5_license_scan,
    op6_chat_format, op7_secret_scan, op8_sharding, op9_mixing, op10_simhash_dedup,
    op11_source_divergence, op12_filter_audit, op13_quality_classifier)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op6_chat_format": OP6_SQL, "op9_mixing": OP9_SQL,
           "op11_source_divergence": OP11_SQL, "op12_filter_audit": OP12_SQL}
