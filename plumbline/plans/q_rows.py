"""Queries on rows: scans, splits, filters, joins, expansion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import hashing, text
from plumbline.operators import expand, ingest
from plumbline.sources import records

from .registry import ROWS, latest_passes, latest_rows, query

PASSES = "p_ as (select * exclude (rn) from (select *, row_number() over (partition by row_id, kind, key order by expanded_at desc) as rn from passes) where rn = 1)"
VAL = "(cast('0x' || substr(sha256({0}), 1, 8) as bigint) % 10 = 0)"
NAME = "regexp_replace(row_id, '-[0-9]+$', '')"


@query(f"with {ROWS} select row_id, primitive, label, split, {NAME} as source_name from rows_")
def rows_last_wins(t):
    return latest_rows(t).select("row_id", "primitive", "label", "split", records.source_name(F.col("row_id")).alias("source_name"))


@query(f"select distinct row_id, {VAL.format('row_id')} as is_val, coalesce(split = 'val', false) as stated from row_examples where row_id is not null")
def split_is_val(t):
    return t("row_examples").where("row_id is not null").select(
        "row_id", hashing.is_val(F.col("row_id")).alias("is_val"), F.coalesce(F.col("split") == "val", F.lit(False)).alias("stated")
    ).distinct()


@query(
    f"with r as (select distinct row_id from row_examples) select {NAME} as source_name, {VAL.format('row_id')} as is_val, count(*) as n from r "
    f"group by 1, 2"
)
def split_counts(t):
    r = ingest.split(t("row_examples").select("row_id").distinct())
    return r.groupBy(records.source_name(F.col("row_id")).alias("source_name"), "is_val").agg(F.count("*").alias("n"))


@query(f"with r as (select distinct row_id from row_examples where {VAL.format('row_id')}) select count(*) as val_rows from r")
def distinct_val_rows(t):
    return t("row_examples").where(hashing.is_val(F.col("row_id"))).agg(F.count_distinct("row_id").alias("val_rows"))


@query(
    "select count(*) as shared from (select row_id from row_examples where split = 'train' intersect select row_id from row_examples where "
    "split in ('val', 'gate'))"
)
def splits_disjoint(t):
    r = t("row_examples")
    return r.where("split = 'train'").select("row_id").intersect(r.where("split in ('val', 'gate')").select("row_id")).agg(F.count("*").alias("shared"))


@query(f"with {ROWS} select row_id, primitive from rows_ where primitive = 'noul'")
def primitive_filter(t):
    return latest_rows(t).where("primitive = 'noul'").select("row_id", "primitive")


@query(f"with {ROWS} select row_id from rows_ where not (row_id like 'zh%' or row_id like 'policysynth%')")
def prefix_exclusion(t):
    return latest_rows(t).where(~(F.col("row_id").startswith("zh") | F.col("row_id").startswith("policysynth"))).select("row_id")


@query(
    f"with {ROWS}, n as (select row_id, {NAME} as source_name, row_number() over (partition by {NAME} order by row_id) as rn from rows_) select "
    f"row_id, source_name from n where rn <= 5"
)
def first_n_per_source(t):
    r = latest_rows(t).select("row_id", records.source_name(F.col("row_id")).alias("source_name"))
    return ingest.first_n_per_group(r, "source_name", "row_id", 5)


@query(f"with r as (select distinct row_id from row_examples where {VAL.format('row_id')}) select row_id from r order by row_id limit 25")
def first_val_rows(t):
    """The first 25 held-out rows in order of their ids: a slice for monitoring."""
    return t("row_examples").where(hashing.is_val(F.col("row_id"))).select("row_id").distinct().orderBy("row_id").limit(25)


@query("""select min(doc_id) as doc_id, text from (select doc_id, trim(text, ' ') as text from documents) where text <> '' group by text""")
def distinct_first_text(t):
    return ingest.distinct_first(t("documents"), "text", "doc_id")


@query("""with d as (select min(doc_id) as doc_id from (select doc_id, trim(text, ' ') as text from documents) where text <> '' group by text) select doc_id, row_number() over (order by doc_id) - 1 as dense_id from d""")
def dense_ids(t):
    return ingest.dense_numbers(ingest.distinct_first(t("documents"), "text", "doc_id").select("doc_id"), "doc_id", "dense_id")


@query("""with n as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as n from documents) select doc_id, source, n, floor(n / 7)::bigint as chunk from n""")
def chunks_per_source(t):
    d = ingest.dense_numbers(t("documents").select("doc_id", "source"), "doc_id", "n", "source")
    return d.select("doc_id", "source", F.col("n").cast("long").alias("n"), F.floor(F.col("n") / 7).alias("chunk"))


@query("""with u as (unpivot (select row_id, scored_at, p, std, weight from soft_labels) on p, std, weight into name attribute value value) select row_id, scored_at, attribute, value from u where value is not null""")
def unpivot_attributes(t):
    return ingest.unpivot(t("soft_labels").select("row_id", "scored_at", "p", "std", "weight"), ["row_id", "scored_at"], ["p", "std", "weight"])


@query(f"with {ROWS} select row_id, case when label = 0 then 1 else 0 end as label_binary from rows_ where primitive = 'noul' and label is not null")
def label_remap(t):
    return latest_rows(t).where("primitive = 'noul' and label is not null").select("row_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label_binary"))


@query(f"with {ROWS} select row_id, meta.options[1] as first_option, len(meta.options) as n_options from rows_ where len(meta.options) > 0")
def first_option(t):
    return latest_rows(t).where("size(meta.options) > 0").select(
        "row_id", F.element_at("meta.options", 1).alias("first_option"), F.size("meta.options").cast("long").alias("n_options")
    )


@query("select doc_id, substr(text, 1, 1200) as text, length(text) > 1200 as was_cut from documents where text is not null")
def truncate_text(t):
    return t("documents").where("text is not null").select("doc_id", F.substring("text", 1, 1200).alias("text"), (F.length("text") > 1200).alias("was_cut"))


@query("""with u as (select row_id as id, 'rows' as origin, state as text from row_examples union all by name select item_id as id, 'items' as origin, state_str as text from eval_items union all by name
select id, 'feedback' as origin, state as text from feedback_records) select origin, count(*) as n, count(text) as with_text, sum(length(text))::bigint as chars from u group by origin""")
def union_sources(t):
    a = t("row_examples").select(F.col("row_id").alias("id"), F.lit("rows").alias("origin"), F.col("state").alias("text"))
    b = t("eval_items").select(F.col("item_id").alias("id"), F.lit("items").alias("origin"), F.col("state_str").alias("text"))
    c = t("feedback_records").select("id", F.lit("feedback").alias("origin"), F.col("state").alias("text"))
    u = a.unionByName(b, True).unionByName(c, True)
    return u.groupBy("origin").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"))


@query(
    f"with {ROWS} select r.row_id from rows_ r where r.primitive = 'noul' and not exists (select 1 from soft_labels s where s.row_id = r.row_id "
    f"and s.p is not null)"
)
def resume_unlabelled(t):
    rows = latest_rows(t).where("primitive = 'noul'").select("row_id")
    return records.not_yet(rows, t("soft_labels").where("p is not null"), ["row_id"])


@query(
    f"with {ROWS} select row_id, concat_ws(' ', nullif(state, ''), nullif(instructions, ''), nullif(array_to_string(meta.options, ' '), ''), "
    f"nullif(meta.attribute, '')) as surface from rows_"
)
def criteria_surface(t):
    return latest_rows(t).select(
        "row_id", text.surface(F.col("state"), F.col("instructions"), F.array_join("meta.options", " "), F.col("meta.attribute")).alias("surface")
    )


SOFT = "soft_ as (select * exclude (rn) from (select *, row_number() over (partition by row_id order by scored_at desc) as rn from soft_labels) where rn = 1)"


def latest_soft(t):
    return records.last_wins(t("soft_labels"), ["row_id"], "scored_at")


@query(f"with {ROWS}, {SOFT} select r.row_id, s.p, s.weight from rows_ r left join soft_ s on r.row_id = s.row_id where r.primitive = 'noul'")
def soft_label_join(t):
    return latest_rows(t).where("primitive = 'noul'").select("row_id").join(latest_soft(t).select("row_id", "p", "weight"), "row_id", "left")


@query(
    f"with {ROWS}, o as (select row_id, unnest(meta.options) as key from rows_ where primitive = 'choice') select o.key, d.description, count(*) "
    f"as n from o left join option_desc d on o.key = d.name group by 1, 2"
)
def option_descriptions(t):
    o = latest_rows(t).where("primitive = 'choice'").select(F.explode("meta.options").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return o.join(t("option_desc").withColumnRenamed("name", "key"), "key", "left").select("key", "description", "n")


@query(
    f"with {ROWS} select r.row_id, r.meta.attribute as attribute, len(a.levels) as n_levels from rows_ r join attr_levels a on r.meta.attribute "
    f"= a.attribute where r.primitive = 'score'"
)
def attribute_levels(t):
    return latest_rows(t).where("primitive = 'score'").select("row_id", "meta.attribute").join(t("attr_levels"), "attribute").select(
        "row_id", "attribute", F.size("levels").cast("long").alias("n_levels")
    )


KEPT = """case when cast('0x' || substr(sha256(row_id), 1, 8) as bigint) % 10 = 0 or len(options) <= {most} then true
  else pos = label or rank <= {most} - 1 end"""
EXPAND = f"""{ROWS}, {SOFT},
o1_ as (select row_id, label, meta.options as options, generate_subscripts(meta.options, 1) - 1 as pos from rows_ where primitive = 'choice' and len(meta.options) > 0),
o2_ as (select *, row_number() over (partition by row_id, pos is not distinct from label order by sha256('options|' || row_id || '|' || pos)) as rank from o1_),
lv_ as (select r.row_id, r.label, generate_subscripts(a.levels, 1) - 1 as pos from rows_ r join attr_levels a on r.meta.attribute = a.attribute where r.primitive = 'score'),
e_ as (
  select r.row_id, 'noul' as qtype, 'noul' as kind, null::varchar as key, 0 as pos, case when not {VAL.format('r.row_id')} and s.p is not null then s.p else r.label end as target,
    case when not {VAL.format('r.row_id')} then coalesce(s.weight, 1.0) else 1.0 end as weight, r.label::double as gold, s.p as soft
  from rows_ r left join soft_ s on r.row_id = s.row_id where r.primitive = 'noul'
  union all select row_id, 'choice', 'choice_opt', options[pos + 1], pos, case when pos = label then 1.0 else 0.0 end, 1.0, label::double, null from o2_ where {KEPT.format(most=4)}
  union all select row_id, 'score', 'score_lvl', pos::varchar, pos, case when pos = label then 1.0 else 0.0 end, 1.0, label::double, null from lv_)"""


@query(f"with {EXPAND} select row_id, qtype, kind, key, pos::int as pos, target, weight, gold, soft from e_")
def expand_passes(t):
    return expand.expand(latest_rows(t), t("option_desc"), t("attr_levels"), latest_soft(t), 4, False)


REST = "list_filter(json_keys(instructions), lambda k: k <> 'question')"
PAIR = "to_json(k)::varchar || ': ' || json_extract(instructions, '$.\"' || k || '\"')::varchar"
ASK = f"""case when substr(ltrim(instructions), 1, 1) <> '{{' or not json_valid(instructions) then instructions
  else json_extract_string(instructions, '$.question') || case when len({REST}) > 0 then chr(10) || '{{' || array_to_string(list_transform({REST}, lambda k: {PAIR}), ', ') || '}}' else '' end end"""
MEANT = "coalesce(concat_ws(' | ', 'true: ' || json_extract_string(criteria, '$.true'), 'false: ' || json_extract_string(criteria, '$.false')), '')"
LINE = "chr(10) || chr(10) || '[{0}] ' || q || chr(10) || "


@query(f"""with {ROWS}, t_ as (select *, {ASK} as q, {MEANT} as meant, meta.options as options, meta.attribute as attribute from rows_),
o_ as (select *, unnest(options) as o from t_ where primitive = 'choice'),
l_ as (select t_.*, a.levels, generate_subscripts(a.levels, 1) as pos from t_ join attr_levels a on t_.attribute = a.attribute where primitive = 'score'),
e_ as (select row_id, null::varchar as key, state || chr(10) || chr(10) || '[noul] ' || q || case when meant <> '' then chr(10) || 'criteria - ' || meant else '' end || chr(10) || 'answer:' as text
  from t_ where primitive = 'noul'
union all select row_id, o, state || {LINE.format('choice')} 'option - ' || o || coalesce(': ' || description, '') || chr(10) || 'answer:' from o_ left join option_desc d on d.name = o
union all select row_id, (pos - 1)::varchar, state || {LINE.format('score')} 'level ' || pos || ' of ' || len(levels) || ' - ' || levels[pos] || chr(10) || 'answer:' from l_)
select row_id, key, sha256(text) as text_key, length(text) as chars from e_""")
def expand_pass_texts(t):
    """Every option and level with its serialised text; a row without a state has a null text."""
    e = expand.expand(latest_rows(t), t("option_desc"), t("attr_levels"), latest_soft(t), 255)
    return e.select("row_id", "key", F.sha2("text", 256).alias("text_key"), F.length("text").cast("long").alias("chars"))


@query(
    f"with {EXPAND} select qtype, kind, count(*) as passes, count(distinct row_id) as n_rows, sum(target) as targets from e_ where qtype <> "
    f"'noul' group by 1, 2"
)
def option_subset_counts(t):
    e = expand.expand(latest_rows(t), t("option_desc"), t("attr_levels"), latest_soft(t), 4, False).where("qtype <> 'noul'")
    return e.groupBy("qtype", "kind").agg(F.count("*").alias("passes"), F.count_distinct("row_id").alias("n_rows"), F.sum("target").alias("targets"))


@query(f"""with {PASSES} select row_id, qtype, array_to_string(list(coalesce(key, '') order by pos, key), '|') as keys, list_sum(list(target order by pos, key)) as targets,
coalesce(list_position(list(target order by pos, key), 1.0), 0)::bigint - 1 as gold from p_ group by row_id, qtype""")
def regroup_passes(t):
    g = expand.regroup(latest_passes(t))
    return g.select(
        "row_id", "qtype", F.array_join(F.transform("keys", lambda k: F.coalesce(k, F.lit(""))), "|").alias("keys"),
        F.aggregate("target", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("targets"),
        (F.array_position("target", 1.0) - 1).alias("gold")
    )


@query(
    f"with {ROWS}, k as (select row_id, case when row_id like 'zh%' then 3 when row_id like 'fiscore%' then 2 else 1 end as k from rows_) select "
    f"row_id, unnest(generate_series(1, k)) as copy from k"
)
def oversample_sources(t):
    k = F.when(F.col("row_id").startswith("zh"), 3).when(F.col("row_id").startswith("fiscore"), 2).otherwise(1)
    return ingest.oversample(latest_rows(t).select("row_id"), k).select("row_id", F.col("copy").cast("long").alias("copy"))


@query("""with a as (select row_id, kind, key, count(*) as a from passes group by 1, 2, 3), k as (select row_id, kind, key, max(expanded_at) as last from passes group by 1, 2, 3)
select count(*) as keys, sum(case when a.a > 1 then 1 else 0 end)::bigint as repeated from a join k on a.row_id = k.row_id and a.kind = k.kind and a.key is not distinct from k.key""")
def null_safe_key_join(t):
    p = t("passes")
    a = p.groupBy("row_id", "kind", "key").agg(F.count("*").alias("a"))
    k = p.groupBy(F.col("row_id").alias("r"), F.col("kind").alias("k"), F.col("key").alias("other")).agg(F.max("expanded_at").alias("last"))
    j = a.join(k, (F.col("row_id") == F.col("r")) & (F.col("kind") == F.col("k")) & F.col("key").eqNullSafe(F.col("other")))
    return j.agg(F.count("*").alias("keys"), F.sum(F.when(F.col("a") > 1, 1).otherwise(0)).alias("repeated"))


@query(f"""with {ROWS}, o as (select distinct unnest(meta.options) as name from rows_ where primitive = 'choice'), d as (select distinct name from option_desc)
select coalesce(o.name, d.name) as name, o.name is not null as used, d.name is not null as described from o full join d on o.name = d.name where o.name is null or d.name is null""")
def key_set_difference(t):
    o = latest_rows(t).where("primitive = 'choice'").select(F.explode("meta.options").alias("name")).distinct().withColumn("u", F.lit(True))
    d = t("option_desc").select("name").distinct().withColumn("d", F.lit(True))
    return o.join(d, "name", "full").where("u is null or d is null").select(
        "name", F.col("u").isNotNull().alias("used"), F.col("d").isNotNull().alias("described")
    )


@query("select doc_id, sha256('order-7' || chr(31) || doc_id) as rank from documents")
def shuffle_by_hash(t):
    return ingest.shuffled(t("documents").select(F.col("doc_id")), "order-7", "doc_id").select("doc_id", "rank")


@query(f"""with {ROWS} select {NAME} as source_name, primitive, count(*) as n, avg(case when primitive = 'noul' then label end) as positive_rate, avg(strlen(state)) as mean_state_bytes from rows_ group by 1, 2""")
def summary_counters(t):
    r = latest_rows(t)
    return r.groupBy(records.source_name(F.col("row_id")).alias("source_name"), "primitive").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("primitive") == "noul", F.col("label"))).alias("positive_rate"),
        F.avg(F.octet_length("state")).alias("mean_state_bytes")
    )


@query(f"""with {ROWS}, o as (select meta.options[label + 1] as option, row_id from rows_ where primitive = 'choice' and label is not null),
n as (select *, row_number() over (partition by option order by row_id) as rn from o where option is not null) select option, string_agg(row_id, ',' order by row_id) as examples from n where rn <= 5 group by option""")
def examples_per_option(t):
    r = latest_rows(t).where("primitive = 'choice' and label is not null").select(
        F.get(F.col("meta.options"), F.col("label")).alias("option"), "row_id"
    ).where("option is not null")
    first = ingest.first_n_per_group(r, "option", "row_id", 5)
    return first.groupBy("option").agg(F.array_join(F.sort_array(F.collect_list("row_id")), ",").alias("examples"))


@query("""with s as (select row_id, count(*) filter (where p between 0 and 1) as k_ok, avg(p) filter (where p between 0 and 1) as p, stddev_pop(p) filter (where p between 0 and 1) as std from soft_labels group by row_id)
select row_id, k_ok, round(p, 6) as p, round(std, 6) as std, round(least(1.0, greatest(0.25, 1.0 - std)), 6) as weight from s where k_ok > 0""")
def soft_label_aggregate(t):
    s = t("soft_labels").where("p between 0 and 1").groupBy("row_id").agg(F.count("*").alias("k_ok"), F.avg("p").alias("p"), F.stddev_pop("p").alias("std"))
    return s.select(
        "row_id", "k_ok", F.round("p", 6).alias("p"), F.round("std", 6).alias("std"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.25), 1.0 - F.col("std"))), 6).alias("weight")
    )


@query("""with v as (select vec_id, label, list_sum(list_transform(embedding, lambda x: x::double)) as s from embeddings), n as (select *, row_number() over (partition by label order by s desc, vec_id) as rn from v)
select label, vec_id, round(s, 3) as s from n where rn <= 3""")
def top3_per_label(t):
    v = t("embeddings").select("vec_id", "label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("s"))
    return ingest.first_n_per_group(v, "label", [F.desc("s"), F.col("vec_id")], 3).select("label", "vec_id", F.round("s", 3).alias("s"))


@query("""select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth, o_totalprice - max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) < -100000.0 as dropped from orders""")
def running_best(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    best = F.max("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("nth"), (F.col("o_totalprice") - best < -100000.0).alias("dropped"))
