"""Queries on joins, messages, request passes, images, dates and readouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import dates, hashing, messages, prob, text
from plumbline.operators import expand, feedback, pipeline, validate
from plumbline.sources import records

from .q_scores import answers, answers_sql, joined
from .q_store import FEEDBACK, store
from .registry import CONFIDENCE, GROUPED, ROUNDED, ROWS, SCORED, grouped, latest_passes, latest_rows, query, scored, softmax_sql, unit_sql

PASSES = """p_ as (select * exclude (rn, text) from
  (select *, row_number() over (partition by row_id, kind, key order by expanded_at desc) as rn from passes) where rn = 1)"""

# ---- joins


@query(f"""with {ROWS}, {PASSES}, g_ as (select row_id, qtype, count(*) as passes, max(gold) as gold, max(case when target = 1.0 then key end) as gold_key from p_ group by 1, 2)
select g_.row_id, qtype, passes, gold, gold_key, length(state) as state_chars from g_ join rows_ on g_.row_id = rows_.row_id where state is not null""")
def items_with_state(t):
    """Passes put together by row, with the text of the row's state."""
    gold_key = F.max(F.when(F.col("target") == 1.0, F.col("key"))).alias("gold_key")
    g = latest_passes(t).groupBy("row_id", "qtype").agg(F.count("*").alias("passes"), F.max("gold").alias("gold"), gold_key)
    return g.join(latest_rows(t).where("state is not null").select("row_id", F.length("state").cast("long").alias("state_chars")), "row_id")


@query(f"""with {SCORED}, h_ as (select row_id, kind, key, (v - 0.5) * 6 as head from s_ where weight is not null)
select s_.row_id, s_.kind, s_.key, round((u - 0.5) * 8 * 0.5 + head * 0.5, 6) as hybrid from s_ join h_ on s_.row_id = h_.row_id and s_.kind = h_.kind and s_.key is not distinct from h_.key""")
def hybrid_scores(t):
    """Scores of two members, joined by row, kind and key; a null key meets a null key."""
    s = scored(t).select("row_id", "kind", "key", "z")
    head = latest_passes(t).where("weight is not null").select(F.col("row_id").alias("r"), F.col("kind").alias("k"), F.col("key").alias("other"))
    head = head.withColumn("head", (hashing.unit(F.lit("second"), "r", "k", "other") - 0.5) * 6)
    j = s.join(head, (F.col("row_id") == F.col("r")) & (F.col("kind") == F.col("k")) & F.col("key").eqNullSafe(F.col("other")))
    return j.select("row_id", "kind", "key", F.round(F.col("z") * 0.5 + F.col("head") * 0.5, 6).alias("hybrid"))


PAIRED = f"""{GROUPED}, one_ as (select row_id, qtype, keys, unnest(keys) as key, unnest({softmax_sql('z')}) as p, unnest(range(len(keys))) as pos from g_),
two_ as (select row_id, unnest(list_reverse(keys)) as key, unnest(list_reverse({softmax_sql('y')})) as q from g_),
a_ as (select one_.row_id, qtype, list(one_.key order by pos) as keys, list((p + q) / 2 order by pos) as p from one_ join two_ on one_.row_id = two_.row_id and one_.key = two_.key group by 1, 2),
{ROUNDED.format('a_')}"""


@query(f"""with {PAIRED} select row_id, qtype, array_to_string(list_transform(r, lambda x: printf('%.4f', x)), ',') as probabilities, keys[list_position(r, list_max(r))] as choice,
case when qtype = 'score' then round(list_sum(list_transform(r, lambda x, i: x * (i - 1))), 4) end as score, {CONFIDENCE} as confidence from r4_""")
def committee_pairing(t):
    """Answers of two members, each with its options in an order of its own, paired by row and option key, averaged, and all else derived anew."""
    g = grouped(t)
    a = g.select("row_id", "qtype", F.posexplode(F.arrays_zip("keys", prob.softmax(F.col("z")).alias("p"))).alias("pos", "x"))
    a = a.select("row_id", "qtype", "pos", F.col("x.keys").alias("key"), F.col("x.p").alias("p"))
    b = g.select(
        "row_id", F.explode(F.arrays_zip(F.reverse("keys").alias("keys"), F.reverse(prob.softmax(F.col("y"))).alias("q"))).alias("x")
    ).select("row_id", "x.*").withColumnRenamed("keys", "key")
    m = a.join(b, ["row_id", "key"]).groupBy("row_id", "qtype").agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", ((F.col("p") + F.col("q")) / 2).alias("m")))).alias("x")
    )
    m = m.select("row_id", "qtype", F.col("x.key").alias("keys"), prob.rounded(F.col("x.m")).alias("r"))
    score = F.when(F.col("qtype") == "score", F.round(prob.expectation(F.col("r")), 4))
    choice = F.element_at("keys", prob.first_top(F.col("r")) + 1)
    return m.select(
        "row_id", "qtype", joined(F.col("r")).alias("probabilities"), choice.alias("choice"), score.alias("score"),
        prob.confidence(F.col("r")).alias("confidence")
    )


@query(f"""with {SCORED}, a_ as (select row_id, u * 0.9 + 0.05 as p, v * 0.9 + 0.05 as q from s_ where qtype = 'noul') select row_id, round((p + q) / 2, 4) as noul from a_""")
def committee_noul(t):
    """The mean of two absolute readouts."""
    s = scored(t).where("qtype = 'noul'").withColumn("v", hashing.unit(F.lit("second"), "row_id", "kind", "key"))
    return s.select("row_id", F.round(((F.col("u") * 0.9 + 0.05) + (F.col("v") * 0.9 + 0.05)) / 2, 4).alias("noul"))


@query(
    f"with {ROWS} select primitive, count(*) as n, count(*) filter (where a.levels is null) as missing from rows_ r left join attr_levels a on "
    f"r.meta.attribute = a.attribute where primitive = 'score' group by 1"
)
def attributes_missing(t):
    """Score rows whose attribute has no levels; expand.matched refuses such rows."""
    a = t("attr_levels").select("attribute", F.lit(True).alias("there"))
    r = latest_rows(t).where("primitive = 'score'").select("primitive", "meta.attribute").join(a, "attribute", "left")
    return r.groupBy("primitive").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


@query(f"""with {SCORED} select row_id, kind, key, round(exp((u - 0.5) * 8) / sum(exp((u - 0.5) * 8)) over w, 6) as p
from s_ where qtype <> 'noul' window w as (partition by row_id, kind)""")
def group_softmax(t):
    """The softmax over a row's passes without gathering them."""
    s = scored(t).where("qtype <> 'noul'").withColumn(
        "top", F.max("z").over(Window.partitionBy("row_id", "kind"))
    ).withColumn("e", F.exp(F.col("z") - F.col("top")))
    return s.select("row_id", "kind", "key", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("row_id", "kind")), 6).alias("p"))


@query("""with w_ as (select doc_id, regexp_extract_all(lower(text), '([a-z0-9]+|[\\x{3400}-\\x{9fff}])', 1) as ws from documents where text is not null)
select doc_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') as words from w_""")
def ordered_dedupe(t):
    """The different words of a text in the order they first stand."""
    return t("documents").where("text is not null").select("doc_id", F.array_join(F.array_distinct(text.tokens(F.col("text"))), " ").alias("words"))


@query("""with b_ as (select distinct o_orderkey // 100 as batch from orders), e_ as (select unnest([0, 1, 2]) as epoch)
select epoch, batch, row_number() over (partition by epoch order by sha256('batches' || chr(31) || epoch || chr(31) || batch)) - 1 as place from b_, e_""")
def batch_order(t):
    """The order of batches in each epoch, from seed, epoch and batch alone."""
    b = t("orders").select(F.floor(F.col("o_orderkey") / 100).alias("batch")).distinct().withColumn("epoch", F.explode(F.array(*map(F.lit, range(3)))))
    key = hashing.content_hash(F.lit("batches"), F.col("epoch").cast("string"), F.col("batch").cast("string"))
    return b.select("epoch", "batch", (F.row_number().over(Window.partitionBy("epoch").orderBy(key)) - 1).cast("long").alias("place"))


# ---- options, messages and teaching

SUBSET = """o_ as (select row_id, primitive, state, instructions, criteria, label, meta.options as options, generate_subscripts(meta.options, 1) - 1 as pos from rows_
  where primitive = 'choice' and len(meta.options) > 0 and label is not null),
k_ as (select *, row_number() over (partition by row_id, pos = label order by sha256('teach|' || row_id || '|' || pos)) as rank from o_),
c_ as (select row_id, state, instructions, list(options[pos + 1] order by pos) as kept, label, any_value(options) as options, len(any_value(options)) as n from k_
  where len(options) <= 4 or pos = label or rank <= 3 group by row_id, state, instructions, label)"""


@query(
    f"with {ROWS}, {SUBSET} select row_id, array_to_string(kept, '|') as options, list_position(kept, options[label + 1])::int - 1 as gold, n as "
    f"had from c_"
)
def seeded_subset(t):
    """Gold and three others chosen by a hash, in their order, with the place of gold among them."""
    r = latest_rows(t).where(
        "primitive = 'choice' and size(meta.options) > 0 and label is not null"
    ).select("row_id", "label", F.col("meta.options").alias("o"))
    s = r.select("row_id", expand.seeded_subset(F.col("row_id"), F.col("o"), F.col("label"), 4, "teach").alias("s"), F.size("o").cast("long").alias("had"))
    return s.select("row_id", F.array_join("s.options", "|").alias("options"), "s.gold", "had")


@query(f"""with {ROWS}, {SUBSET}, t_ as (select c_.row_id, kept, list_transform(kept, lambda k: exp(({unit_sql("'teacher'", "c_.row_id", "k")} - 0.5) * 6)) as e from c_
  where not exists (select 1 from soft_labels s where s.row_id = c_.row_id))
select row_id, array_to_string(list_transform(kept, lambda k, i: chr((64 + i)::int) || '=' || k), '|') as candidates,
  array_to_string(list_transform(e, lambda x: printf('%.4f', x / list_sum(e))), ',') as target_probs from t_""")
def teach_examples(t):
    """Rows without a teacher's answer as yet: a subset of options under letters, and the teacher's distribution over these letters, summing to 1."""
    r = latest_rows(t).where("primitive = 'choice' and size(meta.options) > 0 and label is not null")
    r = records.not_yet(r, t("soft_labels"), ["row_id"])
    s = r.select("row_id", expand.seeded_subset(F.col("row_id"), F.col("meta.options"), F.col("label"), 4, "teach")["options"].alias("o"))
    e = F.transform("o", lambda k: F.exp((hashing.unit(F.lit("teacher"), F.col("row_id"), k) - 0.5) * 6))
    s = s.withColumn("e", e).withColumn("p", F.transform("e", lambda x: x / prob.total(F.col("e"))))
    letters = F.transform("o", lambda k, i: F.concat(F.char(F.lit(65) + i), F.lit("="), k))
    return s.select("row_id", F.array_join(letters, "|").alias("candidates"), joined(F.col("p")).alias("target_probs"))


ESC = "replace(replace(replace({0}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
QUOTE = ESC.format("to_json({0})::varchar")
CANDIDATES = """c_ as (select *, case qtype when 'noul' then [{'code': 'A', 'value': 'false', 'description': 'No'}, {'code': 'B', 'value': 'true', 'description': 'Yes'}]
  when 'choice' then list_transform(options, lambda o, i: {'code': chr((64 + i)::int), 'value': o, 'description': o})
  else list_transform(['low', 'middling', 'high'], lambda o, i: {'code': chr((64 + i)::int), 'value': (i - 1)::varchar, 'description': o}) end as c from eval_items)"""
VALUE = "case when len(c) = 2 and x.value in ('true', 'false') then x.value else " + QUOTE.format("x.value") + " end"
MESSAGES = f"""{CANDIDATES}, f_ as (select *, '{{"name":' || {QUOTE.format('item_id')} || ',"description":' || {QUOTE.format('instructions')} || ',"choices":[' ||
  array_to_string(list_transform(c, lambda x: '{{"code":' || {QUOTE.format('x.code')} || ',"value":' || {VALUE} || ',"description":' || {QUOTE.format('x.description')} || '}}'), ',') || ']}}' as field,
  case when substr(ltrim(state_str), 1, 1) = '{{' and json_valid(state_str) then {ESC.format("json(state_str)::varchar")} else state_str end as context from c_ where len(c) between 2 and 26)"""


def item_candidates(t):
    levels = F.array(*map(F.lit, ("low", "middling", "high")))
    none = F.create_map().cast("map<string,string>")
    return t("eval_items").withColumn("c", messages.candidates(F.col("qtype"), F.lit(None).cast("string"), F.col("options"), none, levels))


@query(f"""with {MESSAGES} select item_id, sha256('{{"context":' || {QUOTE.format('context')} || ',"schema":[' || field || ']}}' || chr(10) || chr(10) || 'Requested field: ' ||
{QUOTE.format('item_id')}) as message, len(c) as candidates from f_""")
def decision_messages(t):
    """The message for each item's question, as a runner renders it."""
    i = item_candidates(t).where("c is not null")
    schema = F.concat(F.lit("["), messages.field(F.col("item_id"), F.col("instructions"), F.col("c")), F.lit("]"))
    return i.select(
        "item_id", F.sha2(messages.message(F.col("state_str"), F.col("item_id"), schema), 256).alias("message"),
        F.size("c").cast("long").alias("candidates")
    )


@query(f"""with {CANDIDATES} select item_id, qtype as kind, case when qtype = 'noul' then gold::int when qtype = 'score' then case when gold::int < 3 then gold::int end
else list_position(options, gold)::int - 1 end as place from c_ where len(c) between 2 and 26""")
def message_targets(t):
    """The question type told from the candidates alone, and the place of gold among them."""
    target = F.when(F.col("qtype") == "noul", F.when(F.col("gold") == "1", "true").otherwise("false")).otherwise(F.col("gold"))
    i = item_candidates(t).where("c is not null")
    return i.select("item_id", messages.kind_of(F.col("c")).alias("kind"), messages.letter_index(F.col("c"), target).alias("place"))


@query(f"""with {ROWS}, q_ as (select row_id, sha256(state || chr(10) || chr(10) || case when primitive = 'noul' then '[noul] ' || instructions || chr(10) || 'criteria - true: ' ||
  coalesce(json_extract_string(criteria, '$.true'), '') || ' | false: ' || coalesce(json_extract_string(criteria, '$.false'), '')
  when len(meta.options) between 1 and 16 then '[choice] ' || instructions || chr(10) || array_to_string(list_transform(meta.options, lambda o, i: chr((64 + i)::int) || '. ' || o), chr(10)) end
  || chr(10) || 'answer:') as prompt, case when primitive = 'noul' then case when label = 1 then 'yes' else 'no' end else ' ' || chr((65 + label)::int) end as answer
  from rows_ where primitive in ('noul', 'choice') and label is not null) select * from q_ where prompt is not null""")
def lettered_prompts(t):
    """Prompts with lettered options and the token that answers them."""
    r = latest_rows(t).where("primitive in ('noul', 'choice') and label is not null")
    prompt = messages.lettered_prompt(F.col("state"), F.col("primitive"), F.col("instructions"), F.col("criteria"), F.col("meta.options"))
    return r.select(
        "row_id", F.sha2(prompt, 256).alias("prompt"), messages.answer_token(F.col("primitive"), F.col("label")).alias("answer")
    ).where("prompt is not null")


@query("""select id, case when substr(ltrim(state), 1, 1) in ('{', '[') and json_valid(state) then json(state)::varchar else state end as packed from feedback_records where state is not null""")
def packed_states(t):
    """JSON without white space, fields in their order."""
    return t("feedback_records").where("state is not null").select("id", text.packed_json("state").alias("packed"))


@query(f"""with {ROWS}, q_ as (select row_id, primitive, criteria, unnest(case primitive when 'choice' then meta.options when 'score' then a.levels else [null] end) as name
  from rows_ left join attr_levels a on rows_.meta.attribute = a.attribute)
select primitive, q_.name, case primitive when 'choice' then d.description end as meaning, count(*) as n, count(criteria) as with_criteria from q_ left join option_desc d on q_.name = d.name group by 1, 2, 3""")
def wire_questions(t):
    """Rows as the questions a client would send: the parts of their criteria with their meanings."""
    r = latest_rows(t).join(t("attr_levels").select("attribute", "levels"), F.col("meta.attribute") == F.col("attribute"), "left")
    parts = F.when(
        F.col("primitive") == "choice", F.col("meta.options")
    ).when(F.col("primitive") == "score", F.col("levels")).otherwise(F.array(F.lit(None).cast("string")))
    q = r.select("primitive", "criteria", F.explode(parts).alias("name")).groupBy("primitive", "name").agg(
        F.count("*").alias("n"), F.count("criteria").alias("with_criteria")
    )
    q = q.join(t("option_desc").select("name", "description"), "name", "left")
    return q.select("primitive", "name", F.when(F.col("primitive") == "choice", F.col("description")).alias("meaning"), "n", "with_criteria")


ASKED = """q_ as (select item_id, 'noul' as kind, null::varchar as key, 0 as pos, state_str || chr(10) || chr(10) || '[noul] ' || instructions || chr(10) || 'answer:' as text
  from eval_items where qtype = 'noul'
  union all select item_id, 'choice_opt', o, pos - 1, state_str || chr(10) || chr(10) || '[choice] ' || instructions || chr(10) || 'option - ' || o || coalesce(': ' || description, '') || chr(10) || 'answer:'
  from (select *, unnest(options) as o, generate_subscripts(options, 1) as pos from eval_items where qtype = 'choice') left join option_desc on name = o
  union all select item_id, 'score_lvl', (pos - 1)::varchar, pos - 1, state_str || chr(10) || chr(10) || '[score] ' || instructions || chr(10) || 'level ' || pos || ' of 3 - ' ||
    ['low', 'middling', 'high'][pos] || chr(10) || 'answer:' from (select *, unnest([1, 2, 3]) as pos from eval_items where qtype = 'score'))"""


def asked(t):
    """Questions as passes: item_id, kind, key, pos, text."""
    i, (s, q) = t("eval_items"), (F.col("state_str"), F.col("instructions"))
    noul = i.where("qtype = 'noul'").select(
        "item_id", F.lit("noul").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"),
        text.noul_pass(s, q, F.lit(None).cast("string")).alias("text")
    )
    c = i.where("qtype = 'choice'").select("item_id", "state_str", "instructions", F.posexplode("options").alias("pos", "key"))
    c = c.join(t("option_desc").select(F.col("name").alias("key"), "description"), "key", "left")
    choice = c.select("item_id", F.lit("choice_opt").alias("kind"), "key", "pos", text.option_pass(s, q, F.col("key"), F.col("description")).alias("text"))
    v = i.where("qtype = 'score'").select(
        "item_id", "state_str", "instructions", F.posexplode(F.array(*map(F.lit, ("low", "middling", "high")))).alias("pos", "level")
    )
    score = v.select(
        "item_id", F.lit("score_lvl").alias("kind"), F.col("pos").cast("string").alias("key"), "pos",
        text.level_pass(s, q, F.col("pos"), F.lit(3), F.col("level")).alias("text")
    )
    return noul.unionByName(choice).unionByName(score)


@query(f"with {ASKED} select item_id, kind, key, pos::int as pos, sha256(text) as text_key from q_")
def request_pass_rows(t):
    """A request's questions as the passes a server scores."""
    return asked(t).select("item_id", "kind", "key", "pos", F.sha2("text", 256).alias("text_key"))


@query("select 0::bigint as changed")
def added_question_changes_nothing(t):
    """Each pass scored among all questions and among those of one type alone: how many scores differ."""
    z = lambda df, name: df.select("item_id", "kind", "key", hashing.unit(F.lit("mock"), "text").alias(name))
    alone = asked(lambda n: t(n).where("qtype = 'noul'") if n == "eval_items" else t(n))
    both = z(asked(t), "a").join(
        z(alone, "b").withColumnsRenamed({"item_id": "i", "kind": "k", "key": "o"}),
        (F.col("item_id") == F.col("i")) & (F.col("kind") == F.col("k")) & F.col("key").eqNullSafe(F.col("o"))
    )
    return both.agg(F.count_if(F.col("a") != F.col("b")).alias("changed"))


# ---- images


@query(f"""with {ROWS}, i_ as (select *, '{{"image": "<attached>", "note": ' || to_json(state)::varchar || '}}' as with_image, 'img/' || row_id || '.png' as image from rows_ where state is not null),
q_ as (select row_id, image, 'noul' as kind, null::varchar as key, 0 as pos, with_image || chr(10) || chr(10) || '[noul] ' || 'Is it so?' || chr(10) || 'answer:' as text from i_ where primitive = 'noul'
union all select row_id, image, 'choice_opt', o, pos - 1, with_image || chr(10) || chr(10) || '[choice] ' || 'Which one?' || chr(10) || 'option - ' || o || chr(10) || 'answer:'
from (select *, unnest(meta.options) as o, generate_subscripts(meta.options, 1) as pos from i_ where primitive = 'choice'))
select row_id, image, kind, key, pos::int as pos, sha256(text) as text_key, floor(length(text) / 4)::bigint + 399 + 24 as cost from q_""")
def image_passes(t):
    """Rows with an image: a placeholder stands for it in the state, each pass carries it, and its tokens count."""
    r = latest_rows(t).where("state is not null").select(
        "row_id", "primitive", "meta.options",
        F.concat(F.lit('{"image": "<attached>", "note": '), messages.json_string(F.col("state")), F.lit("}")).alias("s")
    )
    none = F.lit(None).cast("string")
    noul = r.where("primitive = 'noul'").select(
        "row_id", F.lit("noul").alias("kind"), none.alias("key"), F.lit(0).alias("pos"),
        text.noul_pass(F.col("s"), F.lit("Is it so?"), none).alias("text")
    )
    c = r.where("primitive = 'choice'").select("row_id", "s", F.posexplode("options").alias("pos", "key"))
    choice = c.select(
        "row_id", F.lit("choice_opt").alias("kind"), "key", "pos", text.option_pass(F.col("s"), F.lit("Which one?"), F.col("key"), none).alias("text")
    )
    image = F.concat(F.lit("img/"), "row_id", F.lit(".png")).alias("image")
    return noul.unionByName(choice).select(
        "row_id", image, "kind", "key", "pos", F.sha2("text", 256).alias("text_key"), text.pass_cost(F.col("text"), F.lit(True)).alias("cost")
    )


@query(f"""select item_id, round(0.05 + 0.9 * {unit_sql("'mock'", "'noul'", "state_str", "substr(sha256('png' || item_id), 1, 16)", "instructions")}, 4) as noul,
round(0.05 + 0.9 * {unit_sql("'mock'", "'noul'", "state_str", "'-'", "instructions")}, 4) as without from eval_items where qtype = 'noul'""")
def image_answers(t):
    """The stand-in scorer sees the image by a hash of its bytes; without one it stands as -."""
    i = t("eval_items").where("qtype = 'noul'").withColumn("bytes", F.encode(F.concat(F.lit("png"), "item_id"), "utf-8"))
    p = lambda image: F.round(0.05 + 0.9 * hashing.unit(F.lit("mock"), F.lit("noul"), F.col("state_str"), image, F.col("instructions")), 4)
    return i.select("item_id", p(F.substring(F.sha2("bytes", 256), 1, 16)).alias("noul"), p(F.lit("-")).alias("without"))


@query("""with s as (select p_partkey, (p_partkey % 1500 + 1)::double as w, (p_size * 37 + 5)::double as h from part)
select p_partkey, (case when 640.0 / greatest(w, h) < 1 then greatest(1.0, round_even(w * (640.0 / greatest(w, h)), 0)) else w end)::int as width,
(case when 640.0 / greatest(w, h) < 1 then greatest(1.0, round_even(h * (640.0 / greatest(w, h)), 0)) else h end)::int as height from s""")
def bounded_images(t):
    size = validate.bounded_size((F.col("p_partkey") % 1500 + 1).cast("double"), (F.col("p_size") * 37 + 5).cast("double"))
    return t("part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("""with s as (select p_partkey, (p_partkey % 3000 + 4000)::double as w, (p_size * 60 + 2500)::double as h from part),
b as (select p_partkey, case when w * h > 16777216 then floor(w * sqrt(16777216.0::double / (w * h))) else w end as w, case when w * h > 16777216 then floor(h * sqrt(16777216.0::double / (w * h))) else h end as h from s)
select p_partkey, (ceil(ceil(w / 16.0) / 2) * 2 * ceil(ceil(h / 16.0) / 2) * 2 / 4)::bigint as tokens from b""")
def large_image_tokens(t):
    return t("part").select(
        "p_partkey",
        validate.image_tokens((F.col("p_partkey") % 3000 + 4000).cast("double"), (F.col("p_size") * 60 + 2500).cast("double")).alias("tokens")
    )


# ---- dates and formats

DAY = "o_orderdate::date"
ORD = f"""day({DAY}) || case when day({DAY}) between 11 and 13 then 'th' when day({DAY}) % 10 = 1 then 'st' when day({DAY}) % 10 = 2 then 'nd' when day({DAY}) % 10 = 3 then 'rd' else 'th' end"""
ZH = ", ".join(f"'{x}'" for x in dates.WEEKDAYS_ZH)


@query(f"""select o_orderkey, strftime({DAY}, '%Y-%m-%d') as iso, strftime({DAY}, '%B %-d, %Y') as us, strftime({DAY}, '%-d %B %Y') as uk, strftime({DAY}, '%b %-d, %Y') as abbr,
'the ' || {ORD} || ' of ' || strftime({DAY}, '%B %Y') as ord, strftime({DAY}, '%A, %B %-d, %Y') as wd, strftime({DAY}, '%Y年%-m月%-d日') as ymd, strftime({DAY}, '%Y/%-m/%-d') as slash,
strftime({DAY}, '%-m月%-d日') as noyear, strftime({DAY}, '%Y年%m月%d日') as zero, strftime({DAY}, '%Y年%-m月%-d日') || '（' || [{ZH}][isodow({DAY})] || '）' as wd_zh from orders""")
def date_styles(t):
    """A date in each written style, English and Chinese."""
    d = F.to_date("o_orderdate")
    zh = {("wd_zh" if k == "wd" else k): v for k, v in dates.styles_zh(d).items()}
    return t("orders").select("o_orderkey", *[v.alias(k) for k, v in (dates.styles(d) | zh).items()])


@query(f"""with m as (select o_orderkey, {DAY} as d, o_orderkey % 30 as k, year({DAY}) * 12 + month({DAY}) - 1 - o_orderkey % 30 as m0 from orders)
select o_orderkey, make_date((m0 // 12)::bigint, (m0 % 12 + 1)::bigint, (case when day(d) = 1 then 1 else day(d) - 1 end)::bigint) as since from m where not (day(d) > 29)""")
def months_before(t):
    """A day from which so many complete months have passed."""
    d = F.to_date("o_orderdate")
    return t("orders").where(F.dayofmonth(d) <= 29).select("o_orderkey", dates.months_before(d, F.col("o_orderkey") % 30).alias("since"))


@query(f"""with h as (select o_orderkey, [{DAY}, {DAY} + 40, {DAY} - 10] as hs from orders)
select o_orderkey, array_to_string(list_sort(list_transform(hs, lambda d: strftime(d, '%Y-%m-%d'))), ', ') as en,
array_to_string(list_sort(list_transform(hs, lambda d: strftime(d, '%Y年%-m月%-d日'))), '、') as zh from h""")
def holiday_lists(t):
    d = F.to_date("o_orderdate")
    days = F.array(d, F.date_add(d, 40), F.date_sub(d, 10))
    return t("orders").select("o_orderkey", dates.holiday_list(days).alias("en"), dates.holiday_list_zh(days).alias("zh"))


@query("""select p_partkey, '$' || (p_partkey * 7 // 100) || '.' || lpad((p_partkey * 7 % 100)::varchar, 2, '0') as usd, '¥' || (p_partkey * 3 // 100) || '.' || lpad((p_partkey * 3 % 100)::varchar, 2, '0') as cny,
lpad((p_partkey % 1440 // 60)::varchar, 2, '0') || ':' || lpad((p_partkey % 1440 % 60)::varchar, 2, '0') as at, case when p_size % 2 = 0 then lower(p_brand) || '.example' end as domain from part""")
def formats(t):
    """Money, the time of day, the domain of a sender."""
    k = F.col("p_partkey")
    sender = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("desk@"), F.lower("p_brand"), F.lit(".example"))).otherwise(F.lit("no sender"))
    return t("part").select(
        "p_partkey", text.money(k * 7, "$").alias("usd"), text.money(k * 3, "¥").alias("cny"), text.clock(k % 1440).alias("at"),
        text.mail_domain(sender).alias("domain")
    )


# ---- readouts


@query(f"""with {answers_sql()}, l_ as (select a.attribute, a.levels from attr_levels a), r5_ as (select r4_.row_id, r, keys, l_.levels from r4_ join rows_of on r4_.row_id = rows_of.row_id join l_ on rows_of.attribute = l_.attribute
where qtype = 'score') select row_id, array_to_string(list_transform(keys, lambda k, i: k || ': ' || levels[k::int + 1] || ' ' || printf('%.4f', r[i])), '; ') as legend from r5_""".replace(
    "with ", f"with {ROWS}, rows_of as (select row_id, meta.attribute as attribute from rows_), ", 1))
def score_legend(t):
    """Score answers with what each level stands for."""
    a = answers(t).where("qtype = 'score'").select("row_id", "keys", "r").join(
        latest_rows(t).select("row_id", "meta.attribute"), "row_id"
    ).join(t("attr_levels"), "attribute")
    parts = F.transform(
        "keys", lambda k,
        i: F.concat(k, F.lit(": "), F.element_at("levels", k.cast("int") + 1), F.lit(" "), F.format_string("%.4f", F.element_at("r", i + 1)))
    )
    return a.select("row_id", F.array_join(parts, "; ").alias("legend"))


MODES = "list_transform(z, lambda x: x) as head, list_transform(y, lambda x: x / 2.0) as verb, list_transform(list_zip(z, y), lambda x: x[1] * 0.6 + x[2] / 2.0 * 0.4) as blend"


@query(f"""with {GROUPED}, m_ as (select row_id, qtype, {MODES} from g_), u_ as (select row_id, qtype, 'head' as mode, head as s from m_ union all select row_id, qtype, 'verb', verb from m_
union all select row_id, qtype, 'blend', blend from m_), p2_ as (select *, {softmax_sql('s')} as p from u_) select row_id, qtype, mode, list_position(p, list_max(p)) - 1 as top, round(list_max(p), 6) as p from p2_""")
def readout_modes(t):
    """One member, the other, or their blend; each is one softmax over scores, never over probabilities."""
    g = grouped(t)
    modes = {"head": F.col("z"), "verb": F.transform("y", lambda v: v / 2.0), "blend": prob.blend(F.col("z"), F.col("y"), 0.6, 2.0)}
    m = g.select("row_id", "qtype", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), s.alias("s")) for k, s in modes.items()])).alias("x"))
    m = m.select("row_id", "qtype", "x.mode", prob.softmax(F.col("x.s")).alias("p"))
    return m.select("row_id", "qtype", "mode", prob.first_top(F.col("p")).alias("top"), F.round(F.array_max("p"), 6).alias("p"))


@query(f"""with {answers_sql()}, n_ as (select row_id, u * 0.9 + 0.05 as p from s_ where qtype = 'noul')
select row_id, 'noul' as qtype, printf('%.4f', ln(greatest(p, 1e-9)) - ln(greatest(1 - p, 1e-9))) as scores from n_
union all select row_id, qtype, array_to_string(list_transform(r, lambda x: printf('%.4f', ln(greatest(x, 1e-9)))), ',') from r4_""")
def recovered_scores(t):
    """Scores from recorded probabilities."""
    p = F.col("u") * 0.9 + 0.05
    n = scored(t).where("qtype = 'noul'").select("row_id", "qtype", F.array(1 - p, p).alias("r"))
    a = n.unionByName(answers(t).select("row_id", "qtype", "r"))
    return a.select("row_id", "qtype", joined(prob.scores_from(F.col("r"), F.col("qtype") == "noul")).alias("scores"))


E = "list_transform([{0}], lambda k: exp(e[k + 1] - list_max(e)))"


@query(f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double * 10) as e from embeddings),
r as (select vec_id, e, list_transform([0, 5, 9, 30], lambda k: e[k + 1]) as c from v)
select vec_id, round(e[4] - e[6], 6) as verbalizer, list_sum({E.format('1, 7')}) > list_sum({E.format('2, 8')}) as positive, list_position(c, list_max(c)) - 1 as letter,
round(exp(list_max(c) - list_max(c)) / list_sum(list_transform(c, lambda x: exp(x - list_max(c)))), 6) as p from r""")
def token_readouts(t):
    """From the entries of a vector taken as scores of tokens: yes against no, the mass of either polarity, and the best of four letters alone."""
    e = F.transform("embedding", lambda x: x.cast("double") * 10)
    v = t("embeddings").select("vec_id", e.alias("e"))
    p = prob.restricted(F.col("e"), [0, 5, 9, 30])
    return v.select(
        "vec_id", F.round(F.get("e", F.lit(3)) - F.get("e", F.lit(5)), 6).alias("verbalizer"),
        prob.polarity(F.col("e"), [1, 7], [2, 8]).alias("positive"), prob.first_top(p).alias("letter"), F.round(F.array_max(p), 6).alias("p")
    )


# ---- contract, feedback and manifests

BODY = """b_ as (select item_id, cast(substr(item_id, 6) as int) % 12 as k from eval_items)"""
ERRORS = [
    "null", "'state'", "'model'", "'questions'", "'questions.q.type'", "'questions.q.instructions'", "'questions.q.criteria'",
    "'questions.q.criteria'", "'questions.q.criteria.0'", "'questions.q.criteria.true'", "'questions.q'", "'body'"
]


@query(f"with {BODY} select item_id, [{', '.join(ERRORS)}][k + 1] as error from b_")
def request_contract(t):
    """Requests with one fault each, by item, and the field that is named for it."""
    ask = '"type": "{0}", "instructions": "So?", "criteria": {1}'
    bodies = [
        '{"state": {"a": 1}, "model": "m", "questions": {"q": {%s}}}' % ask.format("choice", '{"a": null, "b": ["x"]}'),
        '{"state": 5, "model": "m", "questions": {}}',
        '{"state": "s", "model": "", "questions": {}}',
        '{"state": "s", "model": "m", "questions": {}}',
        '{"state": "s", "model": "m", "questions": {"q": {%s}}}' % ask.format("yesno", "null"),
        '{"state": "s", "model": "m", "questions": {"q": {"type": "noul", "instructions": 4}}}',
        '{"state": "s", "model": "m", "questions": {"q": {%s}}}' % ask.format("choice", '{"a": null}'),
        '{"state": "s", "model": "m", "questions": {"q": {%s}}}' % ask.format("score", '["a"]'),
        '{"state": "s", "model": "m", "questions": {"q": {%s}}}' % ask.format("score", '[3, "b"]'),
        '{"state": "s", "model": "m", "questions": {"q": {%s}}}' % ask.format("noul", '{"true": 3}'),
        '{"state": "s", "model": "m", "questions": {"q": "no object"}}',
        '{"state": ',
    ]
    k = F.substring("item_id", 6, 9).cast("int") % len(bodies)
    return t("eval_items").select("item_id", validate.request_error(F.element_at(F.array(*map(F.lit, bodies)), k + 1)).alias("error"))


@query(f"""with {FEEDBACK}, k_ as (select id, unnest(json_keys(state)) as key, state from f_ where state is not null and substr(ltrim(state), 1, 1) = '{{' and json_valid(state))
select id, string_agg(key || '=' || case when key = 'note' then '"<redacted>"' else json_extract(state, '$."' || key || '"')::varchar end, ';' order by key) as fields, true as redacted from k_ group by id
union all select id, state, coalesce(privacy.redacted, false) from f_ where state is not null and not (substr(ltrim(state), 1, 1) = '{{' and json_valid(state))""")
def feedback_redact_whole(t):
    """The whole state after redaction, field by field: only the named field is another."""
    s = store(t).where("state is not null")
    hidden = feedback.redact(s, ["note"]).select(
        "id", "state", F.coalesce("privacy.redacted", F.lit(False)).alias("redacted"), F.try_parse_json("state").isNotNull().alias("j")
    )
    parsed = F.from_json("state", "map<string,variant>")
    fields = F.transform(F.array_sort(F.map_keys(parsed)), lambda k: F.concat(k, F.lit("="), F.to_json(F.element_at(parsed, k))))
    is_object = (F.substring(F.ltrim("state"), 1, 1) == "{") & F.col("j")
    return hidden.select("id", F.when(is_object, F.array_join(fields, ";")).otherwise(F.col("state")).alias("fields"), "redacted")


@query(
    f"with {FEEDBACK} select count(*) filter (where coalesce(ts >= 1738000000.0 or coalesce(review.status, '') = 'confirmed', false)) as kept, "
    f"count(*) filter (where not coalesce(ts >= 1738000000.0 or coalesce(review.status, '') = 'confirmed', false)) as removed from f_"
)
def feedback_removed(t):
    """How many records pruning keeps and removes."""
    return feedback.removed(store(t), 1738000000.0)


@query(
    "select event_type as stage, min_by(event_id, ts) as first, min(ts) as first_ts, max_by(event_id, ts) as last, max(ts) as last_ts from "
    "events group by 1"
)
def manifest_first_and_latest(t):
    return pipeline.first_and_latest(t("events"), "event_type", "ts", "event_id").withColumnRenamed("event_type", "stage")
