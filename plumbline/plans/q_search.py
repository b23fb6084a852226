"""Queries on answers to items, axes, gates and parameter search."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import hashing, prob, text
from plumbline.operators import metrics, ranks, search
from plumbline.sources import records

from .q_scores import NOULS, nouls
from .registry import GROUPED, SCORED, grouped, query, scored, softmax_sql, unit_sql

LEVELS = ["0", "1", "2", "3", "4"]


def item_records(t):
    """What a stand-in scorer answers to each item: conf and label of its top answer, by item_id."""
    keys = F.when(F.col("qtype") == "noul", F.array(F.lit("noul"))).when(F.col("qtype") == "choice", F.col("options")).otherwise(F.array(*map(F.lit, LEVELS)))
    i = t("eval_items").select("item_id", "qtype", "state_str", keys.alias("keys")).where("size(keys) > 0")
    i = i.withColumn("u", F.transform("keys", lambda k: hashing.unit(F.lit("mock"), F.col("state_str"), k)))
    yes = F.get("u", F.lit(0)) * 0.9 + 0.05
    p = prob.softmax(F.transform("u", lambda u: (u - 0.5) * 8))
    i = i.withColumn("p", F.when(F.col("qtype") == "noul", F.array(1 - yes, yes)).otherwise(p))
    top = F.when(F.col("qtype") == "noul", F.when(yes >= 0.5, "1").otherwise("0")).otherwise(F.element_at("keys", prob.first_top(F.col("p")) + 1))
    return i.select("item_id", top.alias("label"), F.array_max("p").alias("conf"))


def tasks(t):
    tier = F.when(F.col("suite") == "board_easy", "easy").when(F.col("suite") == "board_hard", "hard").otherwise("standard")
    return t("eval_items").select("item_id", tier.alias("tier"), "qtype", F.col("gold").alias("expected"), "instructions", "state_str")


def judged(t):
    """Tasks with an expected answer and their records, by item_id: tier, qtype, conf, correct."""
    j = tasks(t).where("expected is not null").join(item_records(t), "item_id")
    return j.select("item_id", "tier", "qtype", "conf", (F.col("label") == F.col("expected")).alias("correct"))


JUDGED = f"""i_ as (select *, case suite when 'board_easy' then 'easy' when 'board_hard' then 'hard' else 'standard' end as tier,
  case qtype when 'noul' then ['noul'] when 'choice' then options else {LEVELS} end as keys from eval_items),
u_ as (select *, list_transform(keys, lambda k: {unit_sql("'mock'", "state_str", "k")}) as u from i_ where len(keys) > 0),
z_ as (select *, list_transform(u, lambda x: (x - 0.5) * 8) as z, u[1] * 0.9 + 0.05 as yes from u_),
p_ as (select *, case when qtype = 'noul' then [1 - yes, yes] else {softmax_sql('z')} end as p from z_),
j_ as (select item_id, tier, qtype, list_max(p) as conf,
  case when qtype = 'noul' then case when yes >= 0.5 then '1' else '0' end else keys[list_position(p, list_max(p))] end = gold as correct
  from p_ where gold is not null)"""


@query(f"with {JUDGED} select item_id, tier, qtype, round(conf, 6) as conf, correct from j_")
def judged_items(t):
    """The top label of all three question types: its confidence, and whether it is right."""
    return judged(t).select("item_id", "tier", "qtype", F.round("conf", 6).alias("conf"), "correct")


@query(f"with {JUDGED} select tier, count(*) as n, round(avg(case when correct then 1.0 else 0.0 end), 6) as acc from j_ group by 1")
def tier_accuracy(t):
    return judged(t).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc"))


AXES = f"""{JUDGED}, k_ as (select {', '.join(f"avg(case when correct then 1.0 else 0.0 end) filter (where tier = '{x}') as {x}" for x in metrics.CHANCE)} from j_),
b_ as (select least(9, floor(conf * 10))::int as bin, avg(conf) as c, avg(case when correct then 1.0 else 0.0 end) as f, count(*) as n from j_ group by 1),
e_ as (select sum(n * abs(c - f)) / sum(n) as ece from b_),
v_ as (select value, row_number() over (order by value) as rn, count(*) over () as n from events where value > 0),
s_ as (select max(case when rn = floor(n * 0.5) + 1 then value end) as p50, max(case when rn = floor(n * 0.95) + 1 then value end) as p95 from v_),
t_ as (select avg(n) * 1000 * 0.14 / 1e6 as usd from (select floor(length(state_str) / 4) + floor(length(instructions) / 4) as n from eval_items) where n > 0),
x_ as (select ece, p50, p95, usd, ({' + '.join(f'{w} * 100 * ({k} - {metrics.CHANCE[k]}) / (1 - {metrics.CHANCE[k]})' for k, w in metrics.TIER_WEIGHT.items())})
  / {sum(metrics.TIER_WEIGHT.values())} as intelligence from k_, e_, s_, t_),
a_ as (select intelligence, 100 * (1 - 2 * ece) as calibration, 80 - 10 * (log10(2 * p50) + log10(2 * p95)) as speed, 10 - 30 * log10(usd) as cost from x_)"""


@query(f"""with {AXES} select round(intelligence, 4) as intelligence, round(calibration, 4) as calibration, round(speed, 4) as speed, round(cost, 4) as cost,
round(case when least(intelligence, calibration, speed, cost) > 0
  then pow(intelligence * calibration * speed * cost, 0.25) * least(1.0, pow(intelligence / 50, 2.0)) end, 4) as composite from a_""")
def composite_axes(t):
    """The four axes and the composite: accuracies by tier, calibration of the top label, nearest-rank latencies, tokens at a price."""
    j = judged(t)
    acc = j.agg(*[F.avg(F.when(F.col("tier") == k, F.col("correct").cast("double"))).alias(k) for k in metrics.CHANCE])
    ece = metrics.ece(j.withColumn("t", F.col("correct").cast("double")), "conf", "t", 10).select("ece")
    seconds = t("events").where("value > 0").select("value")
    p50, p95 = (ranks.nearest(seconds, "value", q).withColumnRenamed("value", name) for q, name in ((0.5, "p50"), (0.95, "p95")))
    tokens = tasks(t).select((text.estimated_tokens(F.col("state_str")) + text.estimated_tokens(F.col("instructions"))).alias("n")).where("n > 0")
    usd = tokens.agg((F.avg("n") * 1000 * 0.14 / 1e6).alias("usd_per_1k"))
    one = acc
    for other in (ece, p50, p95, usd):  # a row each
        one = one.join(other)
    return metrics.composite(one).select(*[F.round(c, 4).alias(c) for c in ("intelligence", "calibration", "speed", "cost", "composite")])


@query(f"""with {JUDGED}, b_ as (select qtype, least(9, floor(conf * 10))::int as bin, avg(conf) as c, avg(case when correct then 1.0 else 0.0 end) as f, count(*) as n
from j_ group by 1, 2), e_ as (select qtype, sum(n * abs(c - f)) / sum(n) as ece from b_ group by 1)
select round(max(ece), 6) as measured, max(ece) <= 0.1 as passed from e_""")
def worst_ece_gate(t):
    """The gate on calibration is on the worst question type."""
    e = metrics.ece(judged(t).withColumn("t", F.col("correct").cast("double")), "conf", "t", 10, "qtype")
    return e.agg(F.round(F.max("ece"), 6).alias("measured"), (F.max("ece") <= 0.1).alias("passed"))


@query(f"""with {JUDGED}, b_ as (select tier, qtype, grouping_id(tier, qtype)::bigint as grain, least(9, floor(conf * 10))::int as bin, avg(conf) as c,
  avg(case when correct then 1.0 else 0.0 end) as f, count(*) as n from j_ group by grouping sets ((tier, qtype, least(9, floor(conf * 10))::int),
  (tier, least(9, floor(conf * 10))::int), (least(9, floor(conf * 10))::int)))
select tier, qtype, grain, sum(n)::bigint as n, round(sum(n * f) / sum(n), 6) as acc, round(sum(n * abs(c - f)) / sum(n), 6) as ece from b_ group by 1, 2, 3""")
def family_report(t):
    """Accuracy and calibration error by family and question type, by family, and over all: bins by grouping sets, then one sum."""
    j = judged(t).select("tier", "qtype", metrics.bin_of(F.col("conf"), 10).alias("bin"), "conf", F.col("correct").cast("double").alias("ok"))
    sets = [("tier", "qtype", "bin"), ("tier", "bin"), ("bin",)]
    b = j.groupingSets(sets, "tier", "qtype", "bin").agg(
        (F.grouping("tier") * 2 + F.grouping("qtype")).cast("long").alias("grain"), F.avg("conf").alias("c"), F.avg("ok").alias("f"), F.count("*").alias("n")
    )
    return b.groupBy("tier", "qtype", "grain").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("f")) / F.sum("n"), 6).alias("acc"), F.round(
            F.sum(F.col("n") * F.abs(F.col("c") - F.col("f"))) / F.sum("n"), 6
        ).alias("ece")
    )


@query(f"with {NOULS} select least(9, floor(p * 10))::int as bin, round(avg(p), 3) as conf, round(avg(t), 3) as freq, count(*) as n from n_ group by 1")
def reliability10(t):
    """The table of ten bins with three decimals."""
    return metrics.reliability(nouls(t), "p", "t", 10).select("bin", F.round("conf", 3).alias("conf"), F.round("freq", 3).alias("freq"), "n")


@query("""with p as (select unnest([0.05, 0.14, 0.30])::double as price), m as (select avg(value) as tokens from events where value is not null and value > 0)
select price, round(tokens, 6) as tokens_per_decision, round(tokens * 1000 * price / 1e6, 9) as usd_per_1k from m, p""")
def usage_cost(t):
    """Recorded usage at three prices a million tokens; decisions without recorded tokens don't count."""
    m = t("events").where("value > 0").agg(F.avg("value").alias("tokens"))
    m = m.select("tokens", F.explode(F.array(*map(F.lit, (0.05, 0.14, 0.30)))).alias("price"))
    return m.select("price", F.round("tokens", 6).alias("tokens_per_decision"), F.round(F.col("tokens") * 1000 * F.col("price") / 1e6, 9).alias("usd_per_1k"))


# ---- search

WEIGHTS = [x / 20 for x in range(21)]
TAUS = [0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]
BIASES = [1.0 + 0.25 * i for i in range(15)]


def blend_rows(t):
    """Rows with scores z of the one member and y of the other and the gold place: arrays of several options, and single numbers of noul."""
    g = grouped(t).where("gold >= 0").select("qtype", "z", "y", F.col("gold").cast("double").alias("gold"))
    n = scored(t).where("qtype = 'noul' and gold is not null")
    second = (hashing.unit(F.lit("second"), "row_id", "kind", "key") - 0.5) * 6
    return g, n.select("qtype", "z", second.alias("y"), "gold")


GRID = f"""{GROUPED}, r_ as (select qtype, z, y, gold::double as gold from g_ where gold >= 0
  union all select qtype, [(u - 0.5) * 8], [(v - 0.5) * 6], gold from s_ where qtype = 'noul' and gold is not null),
w_ as (select unnest({WEIGHTS})::double as w), t_ as (select unnest({TAUS})::double as tau), b_ as (select unnest({BIASES})::double as b),
c_ as (select 'noul' as qtype, w, tau, b from w_, t_, b_ union all select q, w, tau, 0.0 from w_, t_, (select unnest(['choice', 'score']) as q)),
s2_ as (select r_.qtype, w, tau, b, gold, list_transform(list_zip(z, y), lambda x: x[1] * w + (x[2] + b) / tau * (1.0 - w)) as s from r_ join c_ using (qtype)),
p2_ as (select *, case when qtype = 'noul' then [1 / (1 + exp(-s[1]))] else {softmax_sql('s')} end as p from s2_),
m_ as (select qtype, w, tau, b, round(avg(case when qtype = 'noul' then pow(p[1] - gold, 2)
  else list_sum(list_transform(p, lambda x, i: pow(x - case when i - 1 = gold then 1.0 else 0.0 end, 2))) end), 12) as brier from p2_ group by 1, 2, 3, 4),
o_ as (select *, row_number() over (partition by qtype order by brier, w, tau, b) as rn from m_)"""


@query(f"with {GRID} select qtype, w, tau, b, round(brier, 6) as brier from o_ where rn = 1")
def blend_grid(t):
    """For each question type the blend with the least Brier score: 2520 candidates for noul, 168 for the others; the first of equal ones holds."""
    several, single = blend_rows(t)
    multi = search.blend_grid_of_groups(several, WEIGHTS, TAUS)
    p = prob.sigmoid(F.col("z") * F.col("w") + (F.col("y") + F.col("b")) / F.col("tau") * (1.0 - F.col("w")))
    noul = search.blend_grid(single, F.pow(p - F.col("gold"), F.lit(2.0)), WEIGHTS, TAUS, BIASES)
    return multi.unionByName(noul)


OLD_WEIGHTS, OLD_TAUS = [x / 10 for x in range(11)], [0.5, 1.0, 2.0, 3.0, 4.0, 6.0]


@query(f"""with {NOULS}, w as (select unnest({OLD_WEIGHTS})::double as w), t_ as (select unnest({OLD_TAUS})::double as tau),
x as (select w, tau, round(avg(power(1 / (1 + exp(-(n_.z * w + ln(p / (1 - p)) / tau * (1 - w)))) - t, 2)), 6) as brier from n_, w, t_ group by 1, 2)
select w, tau, brier from x order by brier, w, tau limit 8""")
def grid_top8(t):
    """The eight best of the older grid, 66 blends on raw scores."""
    n = nouls(t).withColumn("y", F.log(F.col("p") / (1 - F.col("p"))))
    return search.grid_scores(n, OLD_WEIGHTS, OLD_TAUS).orderBy("brier", "w", "tau").limit(8)


SWEEP = ([0.0, 0.15, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0], [0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 12.0], [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0])
SWEPT = f"""{NOULS}, w_ as (select unnest({SWEEP[0]})::double as w), t_ as (select unnest({SWEEP[1]})::double as tau), b_ as (select unnest({SWEEP[2]})::double as b),
q_ as (select w, tau, b, t, ['easy', 'standard', 'hard'][length(row_id) % 3 + 1] as tier,
  1 / (1 + exp(-(z * w + (ln(p / (1 - p)) + b) / tau * (1 - w)))) as q from n_, w_, t_, b_),
c_ as (select *, greatest(q, 1 - q) as conf, case when (q >= 0.5) = (t >= 0.5) then 1.0 else 0.0 end as ok from q_),
e1_ as (select w, tau, b, least(9, floor(conf * 10))::int as bin, avg(conf) as c, avg(ok) as f, count(*) as n from c_ group by 1, 2, 3, 4),
e_ as (select w, tau, b, sum(n * abs(c - f)) / sum(n) as ece from e1_ group by 1, 2, 3),
k_ as (select w, tau, b, {', '.join(f"coalesce(avg(ok) filter (where tier = '{x}'), 0.0) as {x}" for x in metrics.CHANCE)} from c_ group by 1, 2, 3),
i_ as (select w, tau, b, ece, ({' + '.join(f'{x} * 100 * ({k} - {metrics.CHANCE[k]}) / (1 - {metrics.CHANCE[k]})' for k, x in metrics.TIER_WEIGHT.items())})
  / {sum(metrics.TIER_WEIGHT.values())} as intel from k_ join e_ using (w, tau, b)),
x_ as (select *, round(case when least(intel, 100 * (1 - 2 * ece)) > 0 then pow(intel * 100 * (1 - 2 * ece) * 70.0 * 40.0, 0.25) * least(1.0, pow(intel / 50, 2.0))
  end, 6) as score from i_)"""


@query(
    f"with {SWEPT} select w, tau, b, score, round(intel, 6) as intel, round(ece, 6) as ece from x_ order by score desc nulls last, round(intel, "
    f"6) desc, round(ece, 6) desc, w desc, tau desc, b desc limit 8"
)
def landscape_top8(t):
    """392 blends by the composite they give, speed and cost being fixed; the tuple orders from the score down."""
    n = nouls(t).withColumn("y", F.log(F.col("p") / (1 - F.col("p")))).withColumn(
        "tier", F.element_at(F.array(*map(F.lit, metrics.CHANCE)), F.length("row_id") % 3 + 1)
    )
    w, tau, b = search.candidates(*SWEEP)
    q = prob.sigmoid(F.col("z") * w + (F.col("y") + b) / tau * (1 - w))
    each = search.each_candidate(n, *SWEEP).withColumn("q", q)
    each = each.select("i", "tier", F.greatest("q", 1 - F.col("q")).alias("conf"), ((F.col("q") >= 0.5) == (F.col("t") >= 0.5)).cast("double").alias("ok"))
    bins = each.groupBy("i", "tier", metrics.bin_of(F.col("conf"), 10).alias("bin")).agg(
        F.sum("conf").alias("c"), F.sum("ok").alias("f"), F.count("*").alias("n")
    )
    whole = bins.groupBy("i", "bin").agg(
        F.sum("c").alias("c"), F.sum("f").alias("f"), F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("tier") == k, F.col("f"))).alias(f"f_{k}") for k in metrics.CHANCE],
        *[F.sum(F.when(F.col("tier") == k, F.col("n"))).alias(f"n_{k}") for k in metrics.CHANCE]
    )
    acc = [F.coalesce(F.sum(f"f_{k}") / F.sum(f"n_{k}"), F.lit(0.0)).alias(k) for k in metrics.CHANCE]
    x = whole.groupBy("i").agg((F.sum(F.abs(F.col("c") - F.col("f"))) / F.sum("n")).alias("ece"), *acc)
    intel = sum(
        (100 * (F.col(k) - metrics.CHANCE[k]) / (1 - metrics.CHANCE[k]) * f for k, f in metrics.TIER_WEIGHT.items()), F.lit(0.0)
    ) / sum(metrics.TIER_WEIGHT.values())
    x = x.withColumn("intel", intel).withColumn("calibration", 100 * (1 - 2 * F.col("ece")))
    score = F.pow(F.col("intel") * F.col("calibration") * 70.0 * 40.0, F.lit(0.25)) * F.least(F.lit(1.0), F.pow(F.col("intel") / 50, F.lit(2.0)))
    x = x.select(
        w.alias("w"), tau.alias("tau"), b.alias("b"), F.round(F.when(F.least("intel", "calibration") > 0, score), 6).alias("score"),
        F.round("intel", 6).alias("intel"), F.round("ece", 6).alias("ece")
    )
    return x.orderBy(*[F.desc(c) for c in ("score", "intel", "ece", "w", "tau", "b")]).limit(8)


def _round_sql(k: int, low: str, high: str, source: str) -> str:
    tau = f"exp({low} + i * ({high} - {low}) / 32)"
    return f"""a{k}_ as (select i, {low} as low, {high} as high, n_.t, 1 / (1 + exp(-n_.z / {tau})) as p from n_, {source} (select unnest(generate_series(0, 32)) as i)),
c{k}_ as (select i, low, high, least(14, floor(p * 15))::int as bin, avg(p) as conf, avg(t) as freq, count(*) as n from a{k}_ group by 1, 2, 3, 4),
d{k}_ as (select i, low, high, round(sum(n * abs(conf - freq)) / sum(n), 12) as ece from c{k}_ group by 1, 2, 3 order by ece, i limit 1),
r{k}_ as (select ece, low + i * (high - low) / 32 as mid, greatest(low, low + (i - 1) * (high - low) / 32) as lo, least(high, low + (i + 1) * (high - low) / 32) as hi from d{k}_)"""


@query(
    f"with {NOULS}, {_round_sql(1, 'ln(0.05)', 'ln(8.0)', '')}, {_round_sql(2, 'lo', 'hi', 'r1_,')}, {_round_sql(3, 'lo', 'hi', 'r2_,')} select "
    f"round(exp(mid), 4) as temperature, round(ece, 6) as ece from r3_"
)
def temperature_fit(t):
    """The temperature of least calibration error, in three scans of 33 points each."""
    return search.fit_temperature(nouls(t).select("z", "t"))


# ---- fidelity against a teacher

FAITHFUL = f"""{GROUPED}, n_ as (select regexp_replace(row_id, '-[0-9]+$', '') as src, 'noul' as qtype, greatest(u * 0.9 + 0.05, 0.95 - u * 0.9) as conf,
  (u * 0.9 + 0.05 > 0.5) = (soft > 0.5) as agree, (u * 0.9 + 0.05 > 0.5) = (gold >= 0.5) as hit, abs(u * 0.9 + 0.05 - soft) as dp, null::double as tv
  from s_ where qtype = 'noul' and soft is not null and gold is not null),
m_ as (select *, {softmax_sql('z')} as pa, {softmax_sql('y')} as pb from g_ where gold >= 0),
u_ as (select * from n_ union all select regexp_replace(row_id, '-[0-9]+$', ''), qtype, list_max(pa), list_position(pa, list_max(pa)) = list_position(pb, list_max(pb)),
  list_position(pa, list_max(pa)) - 1 = gold, null, list_sum(list_transform(list_zip(pa, pb), lambda x: abs(x[1] - x[2]))) / 2 from m_),
f_ as (select src, avg(case when agree then 1.0 else 0.0 end) as agreement, avg(dp) as dp, avg(tv) as tv, avg(case when hit then 1.0 else 0.0 end) as acc from u_ group by 1),
b_ as (select least(9, floor(conf * 10))::int as bin, avg(conf) as c, avg(case when agree then 1.0 else 0.0 end) as f, count(*) as n from u_ group by 1),
g2_ as (select (select count(*) from eval_items where gold is null) = 0 as no_errors, coalesce(bool_and(round(agreement, 4) >= 0.9), true) as agreement_all,
  coalesce(bool_and(coalesce(round(dp, 4) <= 0.1, true)), true) as dp_noul_all, coalesce(bool_and(coalesce(round(tv, 4) <= 0.15, true)), true) as tv_all,
  coalesce(max(round(acc, 4)) filter (where src = 'nlipair') >= 0.8, true) as nli_floor, coalesce(max(round(acc, 4)) filter (where src = 'policysynth') >= 0.85, true) as synth_floor,
  coalesce((select round(sum(n * abs(c - f)) / sum(n), 4) from b_) <= 0.1, true) as ece from f_),
q_ as (unpivot g2_ on no_errors, agreement_all, dp_noul_all, tv_all, nli_floor, synth_floor, ece into name gate value passed)"""


@query(f"with {FAITHFUL} select gate, passed from q_")
def fidelity_gates(t):
    """All gates against a teacher, by source where they are by source; what was not measured passes."""
    mark = lambda c: records.source_name(F.col(c)).alias("src")
    none = F.lit(None).cast("double")
    n = scored(t).where("qtype = 'noul' and soft is not null and gold is not null").withColumn("p", F.col("u") * 0.9 + 0.05)
    n = n.select(
        mark("row_id"), F.greatest("p", 1 - F.col("p")).alias("conf"), ((F.col("p") > 0.5) == (F.col("soft") > 0.5)).alias("agree"),
        ((F.col("p") > 0.5) == (F.col("gold") >= 0.5)).alias("right"), F.abs(F.col("p") - F.col("soft")).alias("dp"), none.alias("tv")
    )
    g = grouped(t).where("gold >= 0").withColumn("pa", prob.softmax(F.col("z"))).withColumn("pb", prob.softmax(F.col("y")))
    top = prob.first_top(F.col("pa"))
    g = g.select(
        mark("row_id"), F.array_max("pa").alias("conf"), (top == prob.first_top(F.col("pb"))).alias("agree"), (top == F.col("gold")).alias("right"),
        none.alias("dp"), prob.distance_tv(F.col("pa"), F.col("pb")).alias("tv")
    )
    u = n.unionByName(g).withColumn("ok", F.col("agree").cast("double"))
    r = lambda c: F.round(F.avg(c), 4)
    by = u.groupBy("src").agg(r("ok").alias("agreement"), r("dp").alias("dp"), r("tv").alias("tv"), r(F.col("right").cast("double")).alias("acc"))
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(True))), F.lit(True))
    floor = lambda src, bar: F.coalesce(F.max(F.when(F.col("src") == src, F.col("acc"))) >= bar, F.lit(True))
    one = by.agg(
        every(F.col("agreement") >= 0.9).alias("agreement_all"), every(F.col("dp") <= 0.1).alias("dp_noul_all"),
        every(F.col("tv") <= 0.15).alias("tv_all"), floor("nlipair", 0.8).alias("nli_floor"), floor("policysynth", 0.85).alias("synth_floor")
    )
    ece = metrics.ece(u, "conf", "ok", 10).select(F.coalesce(F.round("ece", 4) <= 0.1, F.lit(True)).alias("ece"))
    errors = t("eval_items").agg((F.count(F.when(F.col("gold").isNull(), 1)) == 0).alias("no_errors"))
    names = ["no_errors", "agreement_all", "dp_noul_all", "tv_all", "nli_floor", "synth_floor", "ece"]
    return errors.join(one).join(ece).unpivot([], names, "gate", "passed")  # a row each
