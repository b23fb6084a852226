"""Queries on texts, dates, the audit, the feedback store, batches and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import dates, hashing, text
from plumbline.operators import audit, batches, feedback, ingest, pipeline, validate
from plumbline.sources import records

from .registry import ROWS, latest_rows, query

TOKENS = r"coalesce(regexp_extract_all(lower({0}), '([a-z0-9]+|[\x{{3400}}-\x{{9fff}}])', 1), [])"


@query(f"select doc_id, len({TOKENS.format('text')}) as n_tokens, coalesce({TOKENS.format('text')}[1], '') as first_token from documents")
def token_lists(t):
    w = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first_token"))


def shingles_sql(table: str, key: str, column: str, n: int = 8) -> str:
    return f"""w_{table} as (select {key}, {TOKENS.format(column)} as ws from {table} where {column} is not null),
x_{table} as (select distinct {key}, array_to_string(ws[i:i + {n - 1}], ' ') as shingle from (select {key}, ws, unnest(generate_series(1, len(ws) - {n - 1})) as i from w_{table} where len(ws) >= {n}))"""


@query(f"with {shingles_sql('documents', 'doc_id', 'text')} select doc_id, count(*) as shingles from x_documents group by 1")
def shingle_counts(t):
    return audit.shingle_rows(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("shingles"))


VALUES = "case when substr(ltrim(criteria), 1, 1) = '{' and json_valid(criteria) then array_to_string(list_transform(json_keys(criteria), lambda k: json_extract_string(criteria, '$.\"' || k || '\"')), ' ') else criteria end"
PAIRS = f"""items_ as (select item_id, concat_ws(' ', nullif(state_str, ''), nullif(instructions, ''), nullif(array_to_string(options, ' '), '')) as surface from eval_items),
train_ as (select row_id, concat_ws(' ', nullif(state, ''), nullif(instructions, ''), nullif(array_to_string(meta.options, ' '), ''), nullif(array_to_string(a.levels, ' '), ''),
    nullif({VALUES}, '')) as surface from row_examples left join attr_levels a on meta.attribute = a.attribute where split in ('train', 'val')
  union all select 'feedback-' || id, concat_ws(' ', nullif(state, ''), nullif(question.instructions, ''), nullif(array_to_string(question.options, ' '), ''),
    nullif(array_to_string(question.levels, ' '), '')) from feedback_records),
{shingles_sql('items_', 'item_id', 'surface')}, {shingles_sql('train_', 'row_id', 'surface')},
pairs_ as (select item_id, row_id, count(*) as shared from x_items_ join x_train_ using (shingle) group by 1, 2)"""


def item_surfaces(t):
    return t("eval_items").select("item_id", text.surface(F.col("state_str"), F.col("instructions"), F.array_join("options", " ")).alias("surface"))


def training_surfaces(t):
    """All text of training and held-out rows and of feedback: state, instructions, options, levels, the values of criteria."""
    criteria = F.transform(F.map_values(F.from_json("criteria", "map<string,string>")), lambda v: v)
    values = F.when(
        (F.substring(F.ltrim("criteria"), 1, 1) == "{") & F.try_parse_json("criteria").isNotNull(), F.array_join(criteria, " ")
    ).otherwise(F.col("criteria"))
    r = t("row_examples").where("split in ('train', 'val')").withColumn("attribute", F.col("meta.attribute")).join(t("attr_levels"), "attribute", "left")
    rows = r.select(
        "row_id",
        text.surface(F.col("state"), F.col("instructions"), F.array_join("meta.options", " "), F.array_join("levels", " "), values).alias("surface")
    )
    q = text.surface(F.col("state"), F.col("question.instructions"), F.array_join("question.options", " "), F.array_join("question.levels", " "))
    return rows.unionByName(t("feedback_records").select(F.concat(F.lit("feedback-"), "id").alias("row_id"), q.alias("surface")))


def pairs(t):
    return audit.overlap_pairs(item_surfaces(t), "item_id", "surface", training_surfaces(t), "row_id", "surface")


@query(f"with {PAIRS} select * from pairs_")
def audit_pairs(t):
    return pairs(t)


@query(
    f"with {PAIRS} select count(*) as pairs, count(distinct item_id) as items, count(distinct row_id) as train_rows, sum(shared)::bigint as hits "
    f"from pairs_"
)
def audit_summary(t):
    return pairs(t).agg(
        F.count("*").alias("pairs"), F.count_distinct("item_id").alias("items"), F.count_distinct("row_id").alias("train_rows"),
        F.sum("shared").alias("hits")
    )


@query(
    f"with {PAIRS}, n as (select *, row_number() over (partition by item_id order by shared desc, row_id) as rn from pairs_) select item_id, "
    f"row_id, shared from n where rn <= 3"
)
def audit_top3(t):
    return ingest.first_n_per_group(pairs(t), "item_id", [F.desc("shared"), F.col("row_id")], 3)


@query(f"with {PAIRS} select count(*) = 0 as passed from pairs_")
def audit_gate(t):
    """Whether a run may go on; pipeline.refuse_hits stops it."""
    return pairs(t).agg((F.count("*") == 0).alias("passed"))


@query("select doc_id, sha256(concat_ws(chr(31), source, text)) as content_hash, floor(length(coalesce(text, '')) / 4)::bigint as estimated from documents")
def content_hashes(t):
    return t("documents").select(
        "doc_id", hashing.content_hash(F.col("source"), F.col("text")).alias("content_hash"),
        text.estimated_tokens(F.coalesce("text", F.lit(""))).alias("estimated")
    )


@query("select sha256(text) as cache_key, count(*) as n, min(row_id) as first_row from passes where text is not null group by 1")
def pass_cache_keys(t):
    return t("passes").where("text is not null").groupBy(F.sha2("text", 256).alias("cache_key")).agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row")
    )


@query(
    f"with {ROWS} select row_id, coalesce(concat_ws(' | ', 'true: ' || json_extract_string(criteria, '$.true'), 'false: ' || "
    f"json_extract_string(criteria, '$.false')), '') as pair from rows_ where criteria is not null"
)
def criteria_pairs(t):
    return latest_rows(t).where("criteria is not null").select("row_id", text.criteria_pair(F.col("criteria")).alias("pair"))


@query(f"""with {ROWS}, o as (select row_id, meta.options as o, label from rows_ where primitive = 'choice' and len(meta.options) between 2 and 26)
select row_id, array_to_string(list_transform(o, lambda x, i: chr((64 + i)::int) || ') ' || x), chr(10)) as lines, chr((65 + label)::int) as letter from o""")
def lettered_options(t):
    o = latest_rows(t).where("primitive = 'choice' and size(meta.options) between 2 and 26").select("row_id", F.col("meta.options").alias("o"), "label")
    return o.select("row_id", text.lettered_lines(F.col("o")).alias("lines"), text.letter_of(F.col("o"), F.get("o", F.col("label"))).alias("letter"))


@query("select id, replace(replace(replace(state, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') as wire from feedback_records where state is not null")
def wire_escapes(t):
    return t("feedback_records").where("state is not null").select("id", text.compact_json(F.col("state")).alias("wire"))


PARTS = "list_transform({0}, lambda k: to_json(k)::varchar || ': ' || to_json(json_extract_string(state, '$.\"' || k || '\"'))::varchar)"
OBJECT = "substr(ltrim(state), 1, 1) = '{' and json_valid(state)"


@query(f"""select id, sha256(case when {OBJECT} then '{{' || array_to_string({PARTS.format('list_sort(json_keys(state))')}, ', ') || '}}' else to_json(state)::varchar end) as sha, lower(state_sha256) as stored
from feedback_records where state is not null""")
def canonical_hashes(t):
    """sha256 of the state's canonical JSON beside the stored one; the SQL knows objects of strings only, as all states here are."""
    f = t("feedback_records").where("state is not null")
    return f.select("id", F.sha2(text.canonical_json("state"), 256).alias("sha"), F.lower("state_sha256").alias("stored"))


@query(f"""select id, case when {OBJECT} then '{{' || array_to_string({PARTS.format('json_keys(state)')}, ', ') || '}}' end as parsed from feedback_records where state is not null""")
def parsed_answers(t):
    """JSON objects out of fenced or surrounded text."""
    s = t("feedback_records").where("state is not null")
    fenced = F.when(
        F.length("state") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "state", F.lit("\n```\nDone."))
    ).otherwise(F.concat(F.lit("Answer:\n"), "state", F.lit("\nDone.")))
    return s.select("id", text.loose_json(fenced).alias("parsed"))


@query(f"""with {ROWS} select row_id, sha256('Give the probability that the answer is yes, as JSON with one field p between 0 and 1.' || chr(10) || chr(10) || 'State:' || chr(10) || state || chr(10) || chr(10) || 'Question:' || chr(10) || instructions
|| coalesce(chr(10) || chr(10) || 'Yes means: ' || json_extract_string(criteria, '$.true'), '')) as prompt_key from rows_ where primitive = 'noul' and state is not null""")
def teacher_prompts(t):
    r = latest_rows(t).where("primitive = 'noul' and state is not null")
    return r.select(
        "row_id", F.sha2(text.judge_prompt(F.col("state"), F.col("instructions"), F.get_json_object("criteria", "$.true")), 256).alias("prompt_key")
    )


@query("""select o_orderkey, (o_orderdate::date + interval 3 month)::date as plus3, (year(o_orderdate::date + 100) - year(o_orderdate)) * 12 + month(o_orderdate::date + 100) - month(o_orderdate) - case when day(o_orderdate::date + 100) < day(o_orderdate) then 1 else 0 end as months,
floor((day(o_orderdate) - 1) / 7)::bigint as week, monthname(o_orderdate) || ' ' || day(o_orderdate) || case when day(o_orderdate) between 11 and 13 then 'th' when day(o_orderdate) % 10 = 1 then 'st' when day(o_orderdate) % 10 = 2 then 'nd' when day(o_orderdate) % 10 = 3 then 'rd' else 'th' end || ', ' || year(o_orderdate) as long_form
from orders""")
def date_functions(t):
    d = F.to_date("o_orderdate")
    return t("orders").select(
        "o_orderkey", dates.month_add(d, F.lit(3)).alias("plus3"), dates.months_complete(d, F.date_add(d, 100)).cast("long").alias("months"),
        dates.week_of_month(d).alias("week"), dates.long_date(d).alias("long_form")
    )


@query("""with o as (select o_orderkey, o_orderdate::date as d, o_orderkey % 12 as n from orders where o_orderkey is not null),
c as (select o_orderkey, d, n, case when n = 0 then d else list_filter(generate_series(d + 1, d + (2 * n + 12)::int, interval 1 day), lambda x: isodow(x) < 6 and x::date not in (date '1995-12-25', date '1996-01-01'))[n]::date end as due from o) select o_orderkey, due from c""")
def business_days(t):
    holidays = F.array(F.lit("1995-12-25").cast("date"), F.lit("1996-01-01").cast("date"))
    return t("orders").where("o_orderkey is not null").select(
        "o_orderkey", dates.business_day_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 12).cast("int"), holidays).alias("due")
    )


@query("""select o_orderpriority, count(*) as n, sum(case when greatest(o_orderdate::date, l_shipdate::date) <= least(o_orderdate::date + 60, l_shipdate::date + 10) then 1 else 0 end)::bigint as overlapping
from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def window_overlap(t):
    """Orders' first 60 days against the 10 days after shipping."""
    o, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.when(dates.overlaps(o, F.date_add(o, 60), s, F.date_add(s, 10)), 1).otherwise(0)).alias("overlapping")
    )


FEEDBACK = "f_ as (select * exclude (rn) from (select *, row_number() over (partition by id order by received_at desc) as rn from feedback_records) where rn = 1)"


def store(t):
    return records.last_wins(t("feedback_records"), ["id"], "received_at")


@query(f"""with {FEEDBACK}, e as (select id, array_to_string(list_filter([
case when coalesce(kind in ('correction', 'confirmation', 'outcome', 'rejection'), false) then null else 'kind' end,
case when coalesce(served_as, '') = '' then 'served_as' end, case when question is null then 'question' end,
case when coalesce(question.type in ('noul', 'choice', 'score'), false) then null else 'question.type' end,
case when question.instructions is null then 'question.instructions' end,
case when question.type = 'choice' and coalesce(len(question.options), 0) = 0 then 'question.options' end,
case when question.type = 'score' and coalesce(len(question.levels), 0) = 0 then 'question.levels' end,
case when coalesce(length(state_sha256), 0) <> 64 then 'state_sha256' end,
case when feedback.answer is null then 'feedback.answer' end,
case when privacy is not null and privacy.retention_days is null then 'privacy.retention_days' end,
case when review is not null and not coalesce(review.status in ('pending', 'confirmed', 'rejected'), false) then 'review.status' end], lambda x: x is not null), ',') as errors from f_) select id, errors from e""")
def feedback_validate(t):
    return store(t).select("id", F.array_join(feedback.errors(), ",").alias("errors"))


@query(f"""with {FEEDBACK}, twice as (select id from f_ union all select id from f_ where batch_no = 1) select id, count(*) as n from twice group by id having count(*) > 1""")
def feedback_duplicates(t):
    """A store to which the first batch was appended once more: the ids that stand in it twice."""
    s = store(t)
    return feedback.duplicates(s.unionByName(s.where("batch_no = 1")))


@query(f"""with {FEEDBACK} select 'kind' as dimension, kind as value, count(*) as n from f_ group by 2 union all select 'status', coalesce(review.status, 'none'), count(*) from f_ group by 2
union all select 'served_as', served_as, count(*) from f_ group by 2 union all select 'all', 'all', count(*) from f_""")
def feedback_stats(t):
    return feedback.stats(store(t))


@query(f"with {FEEDBACK} select id from f_ where ts >= 1738000000.0 or coalesce(review.status, '') = 'confirmed'")
def feedback_prune(t):
    return feedback.prune(store(t), 1738000000.0).select("id")


@query(f"""with {FEEDBACK} select 'feedback-' || id as row_id, question.type as primitive, question.instructions as instructions, feedback.answer as answer,
case when question.type = 'choice' then coalesce(list_position(question.options, feedback.answer), 0) - 1 when question.type = 'score' then coalesce(list_position(question.levels, feedback.answer), 0) - 1 end::int as label
from f_ where review.status = 'confirmed' and not coalesce(privacy.opt_out, false)""")
def feedback_export(t):
    return feedback.export(store(t)).select("row_id", "primitive", "instructions", "answer", "label")


@query(f"""with {FEEDBACK} select id, json_extract_string(state, '$.note') is not null as had_note, case when json_extract_string(state, '$.note') is not null then '<redacted>' end as note, json_extract_string(state, '$.plan') as plan
from f_ where state is not null and json_valid(state) and substr(ltrim(state), 1, 1) = '{{'""")
def feedback_redact(t):
    s = store(t).where("state is not null and substring(ltrim(state), 1, 1) = '{'").where(F.expr("try_parse_json(state) is not null"))
    hidden = feedback.redact(s, ["note"])
    note = F.get_json_object("state", "$.note")
    return hidden.select("id", note.isNotNull().alias("had_note"), note.alias("note"), F.get_json_object("state", "$.plan").alias("plan"))


@query(
    f"with {FEEDBACK} select id, case when review.status = 'pending' and batch_no <= 3 then 'rejected' else review.status end as status, case "
    f"when review.status = 'pending' and batch_no <= 3 then 'stale' else review.note end as note from f_"
)
def feedback_review(t):
    s = store(t)
    d = s.where("review.status = 'pending' and batch_no <= 3").select(
        "id", F.lit("rejected").alias("status"), F.lit("sweep").alias("reviewer"), F.lit("stale").alias("note"), F.lit(0.0).alias("reviewed_ts")
    )
    return feedback.review(s, d).select("id", "review.status", "review.note")


@query("""select item_id, case when state_str is null then 'state' when not coalesce(qtype in ('noul', 'choice', 'score'), false) then 'type' when coalesce(instructions, '') = '' then 'instructions'
when qtype = 'choice' and coalesce(len(options), -1) not between 2 and 255 then 'criteria' when qtype = 'choice' and len(list_filter(options, lambda o: coalesce(o, '') = '')) > 0 then 'criteria.option'
when qtype = 'score' and coalesce(len(options), 5) not between 2 and 10 then 'criteria' end as error_field from eval_items""")
def request_validate(t):
    five = F.array(*[F.lit(str(i)) for i in range(5)])
    return t("eval_items").select(
        "item_id",
        validate.first_error(F.col("state_str"), F.col("qtype"), F.col("instructions"), F.col("options"), F.coalesce("options", five)).alias("error_field")
    )


@query("""select p_partkey, (ceil(ceil((p_partkey % 4000 + 16) / 16.0) / 2) * 2 * ceil(ceil((p_size * 40 + 16) / 16.0) / 2) * 2 / 4)::bigint as tokens from part""")
def image_token_counts(t):
    return t("part").select(
        "p_partkey",
        validate.image_tokens((F.col("p_partkey") % 4000 + 16).cast("double"), (F.col("p_size") * 40 + 16).cast("double")).alias("tokens")
    )


FULL = "r.total + o.cost > 16384"


@query(f"""with recursive n as (select count(*) // 50001 + 1 as parts from passes),
c as (select row_id, qtype, floor(length(coalesce(text, '')) / 4)::bigint + 24 as cost, cast('0x' || substr(sha256(row_id), 1, 8) as bigint) % parts as part from passes, n),
o as (select *, row_number() over (partition by qtype, part order by cost, row_id) as rn from c),
r as (select row_id, qtype, part, rn, cost, 0 as batch, 0 as slot, cost as total from o where rn = 1
  union all select o.row_id, o.qtype, o.part, o.rn, o.cost, case when {FULL} then r.batch + 1 else r.batch end, case when {FULL} then 0 else r.slot + 1 end,
    case when {FULL} then o.cost else r.total + o.cost end from r join o on o.qtype = r.qtype and o.part = r.part and o.rn = r.rn + 1)
select row_id, qtype, cost, part * 4294967296 + batch as batch, slot from r""")
def pack_batches(t):
    """Passes into batches of at most 16 384 estimated tokens, within a question type."""
    p = t("passes").select("row_id", "qtype", text.pass_cost(F.coalesce("text", F.lit("")), F.lit(False)).alias("tokens"))
    return batches.pack(p, "row_id", "qtype", "tokens", 16_384)


@query("select event_type as stage, max_by(event_id, ts) as last_event, max(ts) as ts, count(*) as events from events group by 1")
def manifest_status(t):
    return pipeline.latest_status(t("events"), "event_type", "ts", "event_id").select(
        F.col("event_type").alias("stage"), F.col("status").alias("last_event"), "ts", "events"
    )


@query(
    "select avg(n) as tokens_per_decision, round(avg(n) * 1000 * 0.14 / 1e6, 9) as usd_per_1k from (select floor(length(text) / 4) as n from "
    "passes where text is not null and length(text) >= 4)"
)
def token_cost(t):
    n = t("passes").where("text is not null and length(text) >= 4").select(text.estimated_tokens(F.col("text")).alias("n"))
    return n.agg(F.avg("n").alias("tokens_per_decision"), F.round(F.avg("n") * 1000 * 0.14 / 1e6, 9).alias("usd_per_1k"))


@query("""with o as (select o_custkey, strftime(o_orderdate, '%Y') as y, sum(o_totalprice) as v from orders group by 1, 2), t as (select *, lag(v) over (partition by o_custkey order by y) as before from o)
select y, sum(case when v > before then 1 else 0 end)::bigint as up, sum(case when v < before then 1 else 0 end)::bigint as down from t where before is not null group by 1""")
def trend_counts(t):
    o = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    b = o.withColumn("before", F.lag("v").over(Window.partitionBy("o_custkey").orderBy("y"))).where("before is not null")
    return b.groupBy("y").agg(
        F.sum(F.when(F.col("v") > F.col("before"), 1).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("v") < F.col("before"), 1).otherwise(0)).alias("down")
    )
