"""Queries on sources and sinks: builders of labelled rows, loads that merge, staged and counted writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import hashing
from plumbline.sources import builders, places, records, sinks

from .registry import ROWS, latest_rows, query

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SIDES = "to_json({{'true': '{0}', 'false': '{1}'}})"
ITEMS = "i_ as (select cast(substr(item_id, 6) as int) as ord, * from eval_items)"


def rows_sql(row_id: str, primitive: str, state: str, instructions: str, label: str, criteria: str = "null::varchar", options: str = "null::varchar", attribute: str = "null::varchar") -> str:
    return f"""{row_id} as row_id, '{primitive}' as primitive, {state}::varchar as state, {instructions} as instructions, {criteria}::varchar as criteria,
({label})::int as label, {options} as options, {attribute} as attribute"""


def shown(df):
    """The rows of a builder with the options in one text."""
    return df.withColumn("options", F.array_join("options", "|"))


def items(t):
    return t("eval_items").withColumn("ord", F.substring("item_id", 6, 9).cast("int"))


@query(f"""with {ITEMS} select {rows_sql("'reading-' || ord", 'noul', "to_json({'passage': state_str})", "'Does `passage` answer `' || instructions || '` with yes?'", 'ord % 2',
    SIDES.format('the passage answers the question with yes', 'the passage does not support a yes answer'))} from i_ where ord < 150""")
def build_reading(t):
    source = items(t).select("ord", F.col("state_str").alias("passage"), F.col("instructions").alias("question"), (F.col("ord") % 2).alias("label"))
    return shown(builders.build("reading", source, 150))


@query(f"""with c_ as (select doc_id, trim(text, {SPACE}) as claim, trim(source, {SPACE}) as evidence, doc_id % 2 as label from documents),
f_ as (select *, row_number() over (partition by claim order by doc_id) as nth from c_ where claim <> '' and evidence <> ''),
n_ as (select *, row_number() over (order by doc_id) - 1 as i from f_ where nth = 1)
select {rows_sql("'claims-' || i", 'noul', "to_json({'claim': claim, 'evidence': evidence})", "'Is `claim` supported by `evidence`?'", 'case when label = 0 then 1 else 0 end',
    SIDES.format('the claim is supported by the evidence', 'the claim is contradicted by or unrelated to the evidence'))} from n_ where i < 300""")
def build_claims(t):
    source = t("documents").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("claim"), F.col("source").alias("evidence"), (F.col("doc_id") % 2).alias("label")
    )
    return shown(builders.build("claims", source, 300))


@query(f"""with {ITEMS} select {rows_sql("'entailment-' || ord", 'noul', "to_json({'premise': state_str})", "'Is `hypothesis` true given `premise`? Hypothesis: ' || instructions",
    'case when ord % 4 - 1 = 0 then 1 else 0 end', SIDES.format('the hypothesis is entailed by the premise', 'the hypothesis is not entailed by the premise'))}
from i_ where ord < 200 and ord % 4 - 1 <> -1""")
def build_entailment(t):
    source = items(t).select("ord", F.col("state_str").alias("premise"), F.col("instructions").alias("hypothesis"), (F.col("ord") % 4 - 1).alias("label"))
    return shown(builders.build("entailment", source, 200))


@query(f"""select {rows_sql("'intents-' || doc_id", 'choice', "to_json({'query': text})", "'What is the customer''s intent?'", 'doc_id % 3', options="'ask|tell|other'")}
from documents where doc_id < 200""")
def build_intents(t):
    source = t("documents").select(F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % 3).alias("label"))
    return shown(builders.build("intents", source, 200, names=["ask", "tell", "other"]))


@query(f"""with r_ as (select doc_id as ord, source as prompt, text as response, case when doc_id % 3 <> 0 then doc_id % 5 end as usefulness, doc_id % 4 as flow
from documents where doc_id < 250),
u_ as (select *, 'usefulness' as attr, usefulness as rating from r_ union all select *, 'flow', flow from r_)
select {rows_sql("'ratings-' || ord || '-' || attr", 'score', "to_json({'prompt': prompt, 'response': substr(response, 1, 1200)})", "'How would you rate `response` on ' || attr || '?'",
    'rating', attribute='attr')} from u_ where rating is not null""")
def build_ratings(t):
    rated = [F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5).alias("usefulness"), (F.col("doc_id") % 4).alias("flow")]
    source = t("documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("prompt"), F.col("text").alias("response"), *rated)
    return shown(builders.build("ratings", source, 250, attributes=["usefulness", "flow"]))


@query(f"""with l_ as (select doc_id, text, row_number() over (order by doc_id) - 1 as i from documents where doc_id % 4 <> 0)
select {rows_sql("'emotions-' || i", 'choice', "to_json({'comment': text})", "'Which emotion does `comment` most express?'", 'doc_id % 3', options="'joy|anger|calm'")}
from l_ where i < 150""")
def build_emotions(t):
    none = F.array().cast("array<bigint>")
    source = t("documents").select(
        F.col("doc_id").alias("ord"), "text", F.when(F.col("doc_id") % 4 == 0, none).otherwise(F.array(F.col("doc_id") % 3, F.lit(1))).alias("labels")
    )
    return shown(builders.build("emotions", source, 150, names=["joy", "anger", "calm"]))


@query(f"""with {ITEMS}, k_ as (select *, row_number() over (order by ord) - 1 as i from i_ where ord % 3 <> 0)
select {rows_sql("'entailment_zh-' || ord", 'noul', "to_json({'premise': state_str})", "'前提是否蕴含以下假设？假设：' || instructions", 'case when ord % 3 = 1 then 1 else 0 end',
    SIDES.format('前提蕴含该假设', '前提不蕴含该假设'))} from k_ where i < 100""")
def build_entailment_zh(t):
    label = F.element_at(F.array(*map(F.lit, ("-", "entailment", "neutral"))), F.col("ord") % 3 + 1)
    source = items(t).select("ord", F.col("state_str").alias("premise"), F.col("instructions").alias("hypothesis"), label.alias("label"))
    return shown(builders.build("entailment_zh", source, 100))


@query("""with f_ as (select id, 0 as ordinal, state from feedback_records union all select row_id, 1, state from row_examples)
select ordinal, count(*) as n, count(state) as with_state from f_ group by 1""")
def union_with_ordinals(t):
    """Tables one after another, each row with the number of its table."""
    tables = [t("feedback_records").select("id", "state"), t("row_examples").select(F.col("row_id").alias("id"), "state")]
    return records.with_ordinals(tables).groupBy("ordinal").agg(F.count("*").alias("n"), F.count("state").alias("with_state"))


@query("""select name as key, case when name like '%card%' then 'about cards' else description end as value from option_desc union all select 'new option', 'added'""")
def merged_maps(t):
    """Two files of one JSON object each; of keys in both that of the later file holds."""
    first = t("option_desc").select("name", "description")
    spark, folder = first.sparkSession, places.fresh_folder(first.sparkSession, "maps")
    second = first.where("name like '%card%'").select("name", F.lit("about cards").alias("description"))
    second = second.unionByName(spark.createDataFrame([("new option", "added")], "name string, description string"))
    for i, part in enumerate((first, second)):  # small fixed tables
        whole = part.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "description")))).alias("value"))
        whole.coalesce(1).write.text(f"{folder}/{i}")
    return records.read_maps(spark, [f"{folder}/0", f"{folder}/1"]).select("key", F.get_json_object("value", "$").alias("value"))


@query(
    "select id, batch_no, received_at from feedback_records where batch_no > 2 union all select id, 0, received_at from feedback_records where "
    "batch_no <= 2"
)
def staged_rewrite(t):
    """A table replaced by what was made of it."""
    f = t("feedback_records").select("id", "batch_no", "received_at")
    spark, path = f.sparkSession, places.fresh_folder(f.sparkSession, "rewrite")
    f.where("batch_no is not null").write.parquet(path)
    sinks.rewrite(spark.read.parquet(path).withColumn("batch_no", F.when(F.col("batch_no") > 2, F.col("batch_no")).otherwise(0)), path)
    return spark.read.schema(f.schema).parquet(path)


@query("select label, count(*) as n, round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 2) as total from embeddings group by 1")
def sharded_checkpoint(t):
    """Vectors in eight counted shards, read back after the counts were compared."""
    e = t("embeddings")
    path = places.fresh_folder(e.sparkSession, "shards")
    sinks.write_shards(e, path, "vec_id", 8)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return sinks.read_shards(e.sparkSession, path).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(total), 2).alias("total"))


@query(f"""with {ROWS} select row_id || '.bin' as name, octet_length(encode(state)) as bytes from rows_ where state is not null and primitive = 'score'""")
def files_once(t):
    """Content under a name, written once: the second and third call add nothing."""
    r = latest_rows(t).where("state is not null and primitive = 'score'").select(
        F.concat("row_id", F.lit(".bin")).alias("name"), F.encode("state", "utf-8").alias("content")
    )
    path = places.fresh_folder(r.sparkSession, "files")
    for part in (r, r, r.where("length(content) > 100")):
        sinks.write_files_once(part, path)
    return r.sparkSession.read.parquet(path).select("name", F.octet_length("content").alias("bytes"))


@query(f"""with {ROWS} select count(*) as n_rows, count(distinct source) as sources, count(*) filter (where split = 'val') as val_rows from rows_""")
def json_report(t):
    """One row of counts written as a JSON object and read back."""
    r = latest_rows(t)
    one = r.agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("sources"), F.count_if(F.col("split") == "val").alias("val_rows"))
    path = places.fresh_folder(one.sparkSession, "report") + ".json"
    sinks.write_report(one, path)
    return one.sparkSession.read.schema(one.schema).option("multiLine", True).json(path)


@query("""select '## Levels' || chr(10) || chr(10) || '| attribute | levels |' || chr(10) || '|---|---|' || chr(10)
|| string_agg('| ' || attribute || ' | ' || len(levels) || ' |', chr(10) order by attribute) || chr(10) as report from attr_levels""")
def markdown_report(t):
    a = t("attr_levels").select("attribute", F.size("levels").alias("levels")).orderBy("attribute")
    return a.sparkSession.createDataFrame([(sinks.markdown(a, "Levels"),)], "report string")


@query("""with g as (select unnest(['second', 'first']) as run, unnest([2, 1]) as nth, unnest([0.9, 0.5]) as value) select run, value >= 0.8 as all_pass, nth::bigint as nth from g""")
def verdict_history(t):
    """A verdict given twice: the earlier one stays."""
    spark = t("region").sparkSession
    path = places.fresh_folder(spark, "verdicts")
    for run, value in (("first", 0.5), ("second", 0.9)):
        gates = spark.createDataFrame(
            [("acc", value, ">=", 0.8)], "name string, value double, cmp string, bar double"
        ).withColumn("passed", F.col("value") >= F.col("bar"))
        kept = sinks.keep_verdict(gates, path, run)
    return kept.select("run", "all_pass", F.when(F.col("run") == "first", 1).otherwise(2).cast("long").alias("nth"))


@query(f"""with {ROWS} select row_id, null::varchar as image, split from rows_""")
def columns_added_and_dropped(t):
    """An empty image column beside the rows, the text and all columns that begin with _ dropped."""
    r = latest_rows(t).withColumn("_note", hashing.content_hash(F.col("row_id"))).withColumn("image", F.lit(None).cast("string"))
    return r.drop(*[c for c in r.columns if c.startswith("_")]).select("row_id", "image", "split")


@query("""select row_id from (select distinct row_id from row_examples) order by row_id""")
def first_rows_all(t):
    """A slice of 0 means all rows."""
    return records.first_rows(t("row_examples").select("row_id").distinct(), "row_id", 0)
