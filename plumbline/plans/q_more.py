"""Queries on teachers, requests, replay mixes and wider searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import hashing, prob, text
from plumbline.operators import ingest
from plumbline.sources import records

from .q_scores import answers, answers_sql
from .registry import CONFIDENCE, GROUPED, ROUNDED, ROWS, grouped, latest_rows, query, softmax_sql, unit_sql


@query(f"""with {GROUPED}, q_ as (select row_id, keys, {softmax_sql('z')} as pz, list_sort(keys) as shown from g_ where qtype = 'choice' and len(keys) between 2 and 26),
l_ as (select row_id, list_transform(shown, lambda k: pz[list_position(keys, k)]) as p from q_) select row_id, array_to_string(list_transform(p, lambda x, i: chr((64 + i)::int) || '=' || printf('%.4f', x)), ',') as letters from l_""")
def teacher_letters(t):
    """A teacher's distribution over named options as one over letters in the order shown, made to sum to 1 again."""
    g = grouped(t).where("qtype = 'choice' and size(keys) between 2 and 26").withColumn("p", prob.softmax(F.col("z"))).withColumn("shown", F.array_sort("keys"))
    p = F.transform("shown", lambda k: F.element_at("p", F.array_position("keys", k).cast("int")))
    g = g.select("row_id", p.alias("p")).select("row_id", F.transform("p", lambda x: x / prob.total(F.col("p"))).alias("p"))
    return g.select(
        "row_id",
        F.array_join(F.transform("p", lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit("="), F.format_string("%.4f", x))), ",").alias("letters")
    )


@query(f"""with {GROUPED}, a_ as (select *, {softmax_sql('y')} as q, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) as norm from g_ where gold >= 0)
select qtype, round(avg(0.5 * -list_sum(list_transform(list_zip(q, z), lambda x: x[1] * (x[2] - norm))) + 0.5 * (norm - z[gold + 1])), 6) as loss from a_ group by 1""")
def mixed_cross_entropy(t):
    """Half the cross entropy against a teacher's distribution, half that against gold."""
    g = grouped(t).where("gold >= 0").withColumn("q", prob.softmax(F.col("y")))
    soft = prob.group_ce(F.col("z"), F.col("q")) * F.size("z")
    norm = F.array_max("z") + F.log(prob.total(F.transform("z", lambda s: F.exp(s - F.array_max("z")))))
    hard = norm - F.element_at("z", F.col("gold") + 1)
    return g.groupBy("qtype").agg(F.round(F.avg(0.5 * soft + 0.5 * hard), 6).alias("loss"))


@query(f"""with {ROWS}, n as (select row_id, regexp_replace(row_id, '-[0-9]+$', '') as source_name, row_number() over (partition by regexp_replace(row_id, '-[0-9]+$', '') order by row_id) as rn from rows_),
c as (select row_id, source_name, case when source_name in ('zhintent', 'fiscore') then 2 else 1 end as k from n where rn <= 40) select row_id, source_name, unnest(generate_series(1, k)) as copy from c""")
def rebalanced_sources(t):
    """At most 40 rows of a source, small sources twice."""
    r = latest_rows(t).select("row_id", records.source_name(F.col("row_id")).alias("source_name"))
    cut = ingest.first_n_per_group(r, "source_name", "row_id", 40)
    return ingest.oversample(
        cut, F.when(F.col("source_name").isin("zhintent", "fiscore"), 2).otherwise(1)
    ).select("row_id", "source_name", F.col("copy").cast("long").alias("copy"))


@query(f"""with {ROWS}, u as (select row_id, 'held' as part, state from rows_ where split = 'val' union all by name select row_id, 'replay' as part, state from rows_ where split = 'train' and {unit_sql("'replay'", 'row_id')} < 0.2)
select row_id, regexp_replace(row_id, '-[0-9]+$', '') as source_name, part, sha256('order' || chr(31) || row_id) as rank,
  coalesce(length(state), 0) as chars from u""")
def replay_mix(t):
    """Held-out rows beside a fixed fifth of the training rows, each with its place in a shuffle."""
    r = latest_rows(t)
    held = r.where("split = 'val'").withColumn("part", F.lit("held"))
    replay = r.where("split = 'train'").where(hashing.unit(F.lit("replay"), F.col("row_id")) < 0.2).withColumn("part", F.lit("replay"))
    return held.unionByName(replay).select(
        "row_id", records.source_name(F.col("row_id")).alias("source_name"), "part",
        hashing.content_hash(F.lit("order"), F.col("row_id")).alias("rank"), F.coalesce(F.length("state"), F.lit(0)).cast("long").alias("chars")
    )


@query("""select item_id, qtype, case qtype when 'noul' then 1 when 'choice' then coalesce(len(options), 0) else 5 end as passes, sha256(concat_ws(chr(31), state_str, instructions)) as request_key from eval_items""")
def request_passes(t):
    """How many passes a request needs: one, one per option, or one per level."""
    n = F.when(F.col("qtype") == "noul", 1).when(F.col("qtype") == "choice", F.coalesce(F.size("options"), F.lit(0))).otherwise(5)
    return t("eval_items").select(
        "item_id", "qtype", n.cast("long").alias("passes"), hashing.content_hash(F.col("state_str"), F.col("instructions")).alias("request_key")
    )


@query("""with u as (select item_id, state_str, options, generate_subscripts(options, 1) - 1 as pos from eval_items where qtype = 'choice' and len(options) > 0),
s as (select item_id, options, list((""" + unit_sql("'mock'", "state_str", "options[pos + 1]") + """ - 0.5) * 8 order by pos) as z from u group by item_id, options),
a_ as (select item_id, options, """ + softmax_sql("z") + " as p from s), " + ROUNDED.format("a_") + """ select item_id, options[list_position(r, list_max(r))] as choice, list_max(r) as p, """ + CONFIDENCE + " as confidence from r4_")
def mock_answers(t):
    """Answers of a stand-in scorer that hashes state and option: equal content, equal answer."""
    i = t("eval_items").where("qtype = 'choice' and size(options) > 0")
    z = F.transform("options", lambda o: (hashing.unit(F.lit("mock"), F.col("state_str"), o) - 0.5) * 8)
    a = i.select("item_id", "options", prob.softmax(z).alias("p")).withColumn("r", prob.rounded(F.col("p")))
    return a.select(
        "item_id", F.element_at("options", prob.first_top(F.col("r")) + 1).alias("choice"), F.array_max("r").alias("p"),
        prob.confidence(F.col("r")).alias("confidence")
    )


@query("""select item_id, length(coalesce(state_str, '')) // 4 + length(coalesce(instructions, '')) // 4 as input_tokens, 2 * (length(coalesce(gold, '')) // 4 + 10) as output_tokens from eval_items""")
def committee_usage(t):
    """Input counted once, outputs of both members summed."""
    out = text.estimated_tokens(F.coalesce("gold", F.lit(""))) + 10
    return t("eval_items").select(
        "item_id",
        (text.estimated_tokens(F.coalesce("state_str", F.lit(""))) + text.estimated_tokens(F.coalesce("instructions", F.lit("")))).alias("input_tokens"),
        (out * 2).alias("output_tokens")
    )


@query(f"""with {answers_sql()}, x as (select row_id, unnest(list_zip(keys, r)) as kr from r4_ where qtype = 'choice')
select row_id, kr[1] as option, kr[2] as p from x where kr[2] > 0.01""")
def shown_options(t):
    """Options of more than one percent."""
    a = answers(t).where("qtype = 'choice'").select("row_id", F.explode(F.arrays_zip("keys", "r")).alias("x"))
    return a.select("row_id", F.col("x.keys").alias("option"), F.col("x.r").alias("p")).where("p > 0.01")


@query("""with p as (select family, count(*) as n from (select coalesce(meta.family, 'none') as family from row_examples) group by 1), s as (select sum(n) as total from p) select family, n, round(n / total, 6) as share from p, s""")
def family_shares(t):
    p = t("row_examples").groupBy(F.coalesce("meta.family", F.lit("none")).alias("family")).agg(F.count("*").alias("n"))
    total = t("row_examples").agg(F.count("*").alias("total"))
    return p.join(F.broadcast(total)).select("family", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


@query("select name, description, length(description) > 10 and length(description) < 500 as accepted from option_desc")
def accepted_descriptions(t):
    return t("option_desc").select("name", "description", ((F.length("description") > 10) & (F.length("description") < 500)).alias("accepted"))


@query("select attribute, len(levels) as n, len(levels) = 5 and len(list_filter(levels, lambda x: coalesce(x, '') = '')) = 0 as accepted from attr_levels")
def accepted_levels(t):
    full = (F.size("levels") == 5) & ~F.exists("levels", lambda x: F.coalesce(x, F.lit("")) == "")
    return t("attr_levels").select("attribute", F.size("levels").cast("long").alias("n"), full.alias("accepted"))
