"""Queries on scores: answers, metrics, search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import prob
from plumbline.operators import metrics, ranks, search, vectors
from plumbline.sources import records

from .registry import CONFIDENCE, GROUPED, ROUNDED, SCORED, grouped, query, scored, softmax_sql


def nouls(t):
    """Held-out style noul predictions: p of the mock score, t the gold label."""
    return scored(t).where("qtype = 'noul' and gold is not null").select(
        "row_id", records.source_name(F.col("row_id")).alias("source_name"), (F.col("u") * 0.9 + 0.05).alias("p"), F.col("gold").alias("t"), "soft",
        "weight", "z"
    )


NOULS = SCORED + ", n_ as (select row_id, regexp_replace(row_id, '-[0-9]+$', '') as source_name, u * 0.9 + 0.05 as p, gold as t, soft, weight, (u - 0.5) * 8 as z from s_ where qtype = 'noul' and gold is not null)"


def bins_sql(bins: int) -> str:
    return f"b_ as (select least({bins - 1}, floor(p * {bins}))::int as bin, avg(p) as conf, avg(t) as freq, count(*) as n from n_ group by 1)"


@query(f"with {SCORED} select row_id, kind, key, round(u, 9) as u from s_")
def mock_unit(t):
    return scored(t).select("row_id", "kind", "key", F.round("u", 9).alias("u"))


@query(f"with {NOULS}, {bins_sql(15)} select bin, round(conf, 6) as conf, round(freq, 6) as freq, n from b_")
def reliability_bins(t):
    return metrics.reliability(nouls(t), "p", "t", 15).select("bin", F.round("conf", 6).alias("conf"), F.round("freq", 6).alias("freq"), "n")


@query(f"with {NOULS}, {bins_sql(15)} select round(sum(n * abs(conf - freq)) / sum(n), 6) as ece, sum(n)::bigint as n from b_")
def ece15(t):
    return metrics.ece(nouls(t), "p", "t", 15).select(F.round("ece", 6).alias("ece"), "n")


@query(f"with {NOULS}, {bins_sql(10)} select round(sum(n * abs(conf - freq)) / sum(n), 6) as ece, sum(n)::bigint as n from b_")
def ece10(t):
    return metrics.ece(nouls(t), "p", "t", 10).select(F.round("ece", 6).alias("ece"), "n")


@query(f"""with {NOULS}, b_ as (select source_name, least(14, floor(p * 15))::int as bin, avg(p) as conf, avg(t) as freq, count(*) as n from n_ group by 1, 2),
e_ as (select source_name, sum(n * abs(conf - freq)) / sum(n) as ece, sum(n)::bigint as n from b_ group by 1), a_ as (select source_name, avg(case when (p >= 0.5) = (t >= 0.5) then 1.0 else 0.0 end) as acc from n_ group by 1)
select e_.source_name, round(ece, 6) as ece, n, round(acc, 6) as acc from e_ join a_ on e_.source_name = a_.source_name""")
def subset_metrics(t):
    n = nouls(t)
    acc = n.groupBy("source_name").agg(F.avg(((F.col("p") >= 0.5) == (F.col("t") >= 0.5)).cast("double")).alias("acc"))
    return metrics.ece(n, "p", "t", 15, "source_name").join(acc, "source_name").select(
        "source_name", F.round("ece", 6).alias("ece"), "n", F.round("acc", 6).alias("acc")
    )


@query(
    f"with {NOULS} select round(avg(power(p - t, 2)), 6) as brier, round(avg(case when (p >= 0.5) = (t >= 0.5) then 1.0 else 0.0 end), 6) as "
    f"accuracy from n_"
)
def brier_and_accuracy(t):
    return nouls(t).agg(
        F.round(F.avg(F.pow(F.col("p") - F.col("t"), F.lit(2.0))), 6).alias("brier"),
        F.round(F.avg(((F.col("p") >= 0.5) == (F.col("t") >= 0.5)).cast("double")), 6).alias("accuracy")
    )


@query(
    f"with {NOULS} select row_id, round(case when p >= 0.5 then p else 1 - p end, 6) as conf, (p >= 0.5) = (t >= 0.5) as correct, p >= 0.5 as "
    f"at_least, p > 0.5 as above from n_"
)
def top_label(t):
    p = F.col("p")
    return nouls(t).select(
        "row_id", F.round(F.when(p >= 0.5, p).otherwise(1 - p), 6).alias("conf"), ((p >= 0.5) == (F.col("t") >= 0.5)).alias("correct"),
        (p >= 0.5).alias("at_least"), (p > 0.5).alias("above")
    )


@query(f"with {NOULS} select round(avg(abs(p - soft)), 6) as mean_abs_dp, count(*) as n from n_ where soft is not null")
def fidelity_delta(t):
    return nouls(t).where("soft is not null").agg(F.round(F.avg(F.abs(F.col("p") - F.col("soft"))), 6).alias("mean_abs_dp"), F.count("*").alias("n"))


@query(f"with {NOULS} select round(avg(coalesce(weight, 1.0) * (greatest(z, 0.0) - z * t + ln(1 + exp(-abs(z))))), 6) as loss from n_")
def weighted_bce(t):
    return nouls(t).agg(F.round(F.avg(F.coalesce("weight", F.lit(1.0)) * prob.bce_with_logits(F.col("z"), F.col("t"))), 6).alias("loss"))


@query(
    f"with {NOULS} select row_id, round(1 / (1 + exp(-z)), 6) as p, round(ln(least(1 - 1e-9, greatest(1e-9, p)) / (1 - least(1 - 1e-9, "
    f"greatest(1e-9, p)))), 6) as back, round(p, 4) as noul from n_"
)
def noul_answer(t):
    return nouls(t).select(
        "row_id", F.round(prob.sigmoid(F.col("z")), 6).alias("p"), F.round(prob.logit(F.col("p")), 6).alias("back"), F.round("p", 4).alias("noul")
    )


def answers(t, temperature: float = 1.0):
    g = grouped(t).withColumn("p", prob.softmax(F.col("z"), temperature))
    return g.withColumn("r", prob.rounded(F.col("p")))


def answers_sql(temperature: float = 1.0) -> str:
    return f"{GROUPED}, a_ as (select *, {softmax_sql('z', temperature)} as p from g_), {ROUNDED.format('a_')}"


def joined(xs):
    return F.array_join(F.transform(xs, lambda x: F.format_string("%.4f", x)), ",")


JOINED = "array_to_string(list_transform(r, lambda x: printf('%.4f', x)), ',')"


@query(
    f"with {answers_sql(0.8)} select row_id, {JOINED} as probabilities, keys[list_position(r, list_max(r))] as choice, {CONFIDENCE} as "
    f"confidence from r4_ where qtype = 'choice'"
)
def choice_answer(t):
    a = answers(t, 0.8).where("qtype = 'choice'")
    return a.select(
        "row_id", joined(F.col("r")).alias("probabilities"), F.element_at("keys", prob.first_top(F.col("r")) + 1).alias("choice"),
        prob.confidence(F.col("r")).alias("confidence")
    )


@query(
    f"with {answers_sql()} select row_id, {JOINED} as probabilities, round(list_sum(list_transform(r, lambda x, i: x * (i - 1))), 4) as score, "
    f"{CONFIDENCE} as confidence from r4_ where qtype = 'score'"
)
def score_answer(t):
    a = answers(t).where("qtype = 'score'")
    return a.select(
        "row_id", joined(F.col("r")).alias("probabilities"), F.round(prob.expectation(F.col("r")), 4).alias("score"),
        prob.confidence(F.col("r")).alias("confidence")
    )


@query(
    f"with {answers_sql()} select qtype, count(*) as n, max(abs(list_sum(list_transform(r, lambda x: x::decimal(10, 4))) - 1))::double as off "
    f"from r4_ group by 1"
)
def exact_sum(t):
    a = answers(t).select(
        "qtype",
        F.aggregate(F.transform("r", lambda x: x.cast("decimal(10,4)")), F.lit(0).cast("decimal(20,4)"), lambda s, x: (s + x).cast("decimal(20,4)")).alias("s")
    )
    return a.groupBy("qtype").agg(F.count("*").alias("n"), F.max(F.abs(F.col("s") - 1).cast("double")).alias("off"))


SQL_BLEND = "list_transform(list_zip(z, y), lambda x: x[1] * 0.6 + (x[2] + 0.25) / 2.0 * 0.4)"


@query(
    f"with {GROUPED}, c_ as (select row_id, qtype, gold, {SQL_BLEND} as b from g_), a_ as (select *, {softmax_sql('b')} as p from c_) select "
    f"row_id, qtype, list_position(p, list_max(p)) - 1 as top, round(list_max(p), 6) as p from a_"
)
def blend_readout(t):
    g = grouped(t).withColumn("p", prob.softmax(prob.blend(F.col("z"), F.col("y"), 0.6, 2.0, 0.25)))
    return g.select("row_id", "qtype", prob.first_top(F.col("p")).alias("top"), F.round(F.array_max("p"), 6).alias("p"))


MERGED = f"{GROUPED}, m_ as (select row_id, qtype, keys, gold, {softmax_sql('z')} as pa, {softmax_sql('y')} as pb from g_), a_ as (select *, list_transform(list_zip(pa, pb), lambda x: (x[1] + x[2]) / 2) as p from m_), {ROUNDED.format('a_')}"


def merged(t):
    g = grouped(t).withColumn("pa", prob.softmax(F.col("z"))).withColumn("pb", prob.softmax(F.col("y")))
    return g.withColumn("p", prob.mean_of(F.col("pa"), F.col("pb"))).withColumn("r", prob.rounded(F.col("p")))


@query(f"with {MERGED} select row_id, qtype, {JOINED} as probabilities, keys[list_position(r, list_max(r))] as choice, {CONFIDENCE} as confidence from r4_")
def committee_merge(t):
    m = merged(t)
    return m.select(
        "row_id", "qtype", joined(F.col("r")).alias("probabilities"), F.element_at("keys", prob.first_top(F.col("r")) + 1).alias("choice"),
        prob.confidence(F.col("r")).alias("confidence")
    )


@query(
    f"with {MERGED} select qtype, round(avg(list_sum(list_transform(list_zip(pa, pb), lambda x: abs(x[1] - x[2]))) / 2), 6) as tv, "
    f"round(avg(case when list_position(pa, list_max(pa)) = list_position(pb, list_max(pb)) then 1.0 else 0.0 end), 6) as agreement from r4_ "
    f"group by 1"
)
def tv_distance_and_agreement(t):
    m = merged(t)
    same = (prob.first_top(F.col("pa")) == prob.first_top(F.col("pb"))).cast("double")
    return m.groupBy("qtype").agg(F.round(F.avg(prob.distance_tv(F.col("pa"), F.col("pb"))), 6).alias("tv"), F.round(F.avg(same), 6).alias("agreement"))


@query(
    f"with {answers_sql()} select qtype, round(avg(case when list_position(z, list_max(z)) - 1 = gold then 1.0 else 0.0 end), 6) as acc, "
    f"count(*) as n from r4_ where gold >= 0 group by 1"
)
def top1_accuracy(t):
    a = grouped(t).where("gold >= 0")
    return a.groupBy("qtype").agg(F.round(F.avg((prob.first_top(F.col("z")) == F.col("gold")).cast("double")), 6).alias("acc"), F.count("*").alias("n"))


@query(
    f"with {answers_sql()} select round(avg(abs(list_sum(list_transform(p, lambda x, i: x * (i - 1))) - gold)), 6) as mae from r4_ where qtype = "
    f"'score' and gold >= 0"
)
def expectation_mae(t):
    return answers(t).where("qtype = 'score' and gold >= 0").agg(F.round(F.avg(F.abs(prob.expectation(F.col("p")) - F.col("gold"))), 6).alias("mae"))


@query(
    f"with {answers_sql()} select qtype, round(avg(list_sum(list_transform(p, lambda x, i: power(x - case when i - 1 = gold then 1.0 else 0.0 "
    f"end, 2)))), 6) as brier from r4_ where gold >= 0 group by 1"
)
def brier_multiclass(t):
    return answers(t).where("gold >= 0").groupBy("qtype").agg(F.round(F.avg(prob.brier_multi(F.col("p"), F.col("gold"))), 6).alias("brier"))


@query(f"""with {GROUPED}, l_ as (select *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) as norm from g_)
select qtype, round(avg(-list_sum(list_transform(list_zip(z, t), lambda x: coalesce(x[2], 0.0) * (x[1] - norm))) / len(z)), 6) as ce from l_ group by 1""")
def group_cross_entropy(t):
    g = grouped(t).withColumn("t", F.transform("t", lambda x: F.coalesce(x, F.lit(0.0))))
    return g.groupBy("qtype").agg(F.round(F.avg(prob.group_ce(F.col("z"), F.col("t"))), 6).alias("ce"))


CELLS = f"""{GROUPED}, u_ as (select regexp_replace(row_id, '-[0-9]+$', '') as family, qtype, case when list_position(z, list_max(z)) - 1 = gold then 1.0 else 0.0 end as ok from g_ where gold >= 0
union all select regexp_replace(row_id, '-[0-9]+$', ''), 'noul', case when (u * 0.9 + 0.05 >= 0.5) = (gold >= 0.5) then 1.0 else 0.0 end from s_ where qtype = 'noul' and gold is not null)"""


@query(
    f"with {CELLS} select family, qtype, grouping(family)::int as over_families, grouping(qtype)::int as over_types, count(*) as n, "
    f"round(avg(ok), 6) as acc from u_ group by grouping sets ((family, qtype), (family), ())"
)
def metrics_grouping_sets(t):
    g = grouped(t).where("gold >= 0").select(
        records.source_name(F.col("row_id")).alias("family"), "qtype", (prob.first_top(F.col("z")) == F.col("gold")).cast("double").alias("ok")
    )
    n = nouls(t).select(
        F.col("source_name").alias("family"), F.lit("noul").alias("qtype"), ((F.col("p") >= 0.5) == (F.col("t") >= 0.5)).cast("double").alias("ok")
    )
    u = g.unionByName(n)
    return u.groupingSets([("family", "qtype"), ("family",), ()], "family", "qtype").agg(
        F.grouping("family").cast("int").alias("over_families"), F.grouping("qtype").cast("int").alias("over_types"), F.count("*").alias("n"),
        F.round(F.avg("ok"), 6).alias("acc")
    )


@query(
    f"with {CELLS}, c as (select qtype, avg(ok) as acc, count(*) as n from u_ group by 1) select round(sum(acc * n) / sum(n), 6) as pooled, "
    f"sum(n)::bigint as n from c"
)
def pooled_accuracy(t):
    """Over rows, not passes, of all primitives."""
    g = grouped(t).where("gold >= 0").select("qtype", (prob.first_top(F.col("z")) == F.col("gold")).cast("double").alias("ok"))
    n = nouls(t).select(F.lit("noul").alias("qtype"), ((F.col("p") >= 0.5) == (F.col("t") >= 0.5)).cast("double").alias("ok"))
    c = g.unionByName(n).groupBy("qtype").agg(F.avg("ok").alias("acc"), F.count("*").alias("n"))
    return c.agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("pooled"), F.sum("n").alias("n"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(case when rn = floor(n * 0.5) + 1 then value end) as p50, max(case when rn = floor(n * 0.95) + 1 then value end) as p95 from r group by 1""")
def latency_percentiles(t):
    e = t("events")
    a = ranks.nearest(e, "value", 0.5, "event_type").withColumnRenamed("value", "p50")
    b = ranks.nearest(e, "value", 0.95, "event_type").withColumnRenamed("value", "p95")
    return a.join(b, "event_type")


@query(
    f"with {NOULS}, c as (select unnest([0.5, 1.0, 1.5, 2.0, 3.0]) as tau), b as (select tau, least(14, floor(1 / (1 + exp(-z / tau)) * "
    f"15))::int as bin, avg(1 / (1 + exp(-z / tau))) as conf, avg(t) as freq, count(*) as n from n_, c group by 1, 2) select tau::double as tau, "
    f"round(sum(n * abs(conf - freq)) / sum(n), 6) as ece from b group by 1"
)
def temperature_landscape(t):
    return search.ece_by_temperature(nouls(t).select("z", "t"), [0.5, 1.0, 1.5, 2.0, 3.0], 15).select("tau", F.round("ece", 6).alias("ece"))


HEAD = ([[0.5 if (i + j) % 3 == 0 else -0.25 for i in range(64)] for j in range(4)], [0.1, -0.1, 0.2, 0.0], [1.0, -1.0, 0.5, 0.25], 0.05)


def _head_sql() -> str:
    units = []
    for row, b in zip(HEAD[0], HEAD[1]):
        units.append(f"list_sum(list_transform(list_zip(embedding, {row}), lambda x: x[1]::double * x[2]::double)) + {b}")
    series = f"list_sum(list_transform({prob.erf_coefficients()}, lambda c, i: c::double * pow(x / sqrt(2.0), 2 * (i - 1))))"
    erf = f"case when abs(x / sqrt(2.0)) < {prob.ERF_FROM} then 2 / sqrt(pi()) * exp(-x * x / 2) * x / sqrt(2.0) * {series} else sign(x) end"
    return f"""with a as (select vec_id, unnest([{', '.join(units)}]) as x, unnest({HEAD[2]}) as w from embeddings)
select vec_id, round(sum(x * 0.5 * (1.0 + {erf}) * w) + {HEAD[3]}, 4) as score from a group by vec_id"""


@query(_head_sql())
def mlp_head(t):
    return t("embeddings").select("vec_id", F.round(prob.mlp(F.transform("embedding", lambda x: x.cast("double")), *HEAD), 4).alias("score"))


@query("""with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select label, pos::int as pos, round(avg(x), 5) as mean from e group by 1, 2""")
def parameter_average(t):
    return vectors.average(t("embeddings"), "label", "embedding").select("label", "pos", F.round("mean", 5).alias("mean"))


@query(f"""with {NOULS}, {bins_sql(10)}, m as (select 'noul_ece' as name, sum(n * abs(conf - freq)) / sum(n) as value from b_ union all select 'noul_acc', avg(case when (p >= 0.5) = (t >= 0.5) then 1.0 else 0.0 end) from n_),
g as (select * from (values ('noul_ece', '<=', 0.10), ('noul_acc', '>=', 0.45), ('image_acc', '>=', 0.90)) v(name, cmp, bar))
select g.name, cmp, bar::double as bar, round(value, 6) as value, coalesce(case when cmp = '>=' then value >= bar else value <= bar end, false) as passed from g left join m on g.name = m.name""")
def gate_verdict(t):
    n = nouls(t)
    a = metrics.ece(n, "p", "t", 10).select(F.lit("noul_ece").alias("name"), F.col("ece").alias("value"))
    b = n.agg(F.avg(((F.col("p") >= 0.5) == (F.col("t") >= 0.5)).cast("double")).alias("value")).select(F.lit("noul_acc").alias("name"), "value")
    gates = n.sparkSession.createDataFrame(
        [("noul_ece", "<=", 0.10), ("noul_acc", ">=", 0.45), ("image_acc", ">=", 0.90)], "name string, cmp string, bar double"
    )
    return metrics.verdicts(a.unionByName(b), gates).select("name", "cmp", "bar", F.round("value", 6).alias("value"), "passed")


@query("""with d as (select event_type, cast(ts as date) as day, avg(value) as acc from events group by 1, 2), b as (select *, max(acc) over (partition by event_type order by day rows unbounded preceding) as best from d)
select event_type, day, round(acc, 6) as acc, round(best, 6) as best, best - acc > 5.0 as abort from b""")
def abort_rule(t):
    d = t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("acc"))
    return metrics.running_drop(d, "event_type", "day", "acc", 5.0).select(
        "event_type", "day", F.round("acc", 6).alias("acc"), F.round("best", 6).alias("best"), "abort"
    )


@query("""with s as (select unnest(generate_series(0, 99)) as step) select step, round(case when step < 10 then (step + 1) / 10.0 else 0.05 + 0.95 * 0.5 * (1 + cos(pi() * (step - 10) / 90.0)) end, 6) as lr from s""")
def learning_rates(t):
    s = t("region").sparkSession.range(0, 100).select(F.col("id").alias("step"))
    return s.select("step", F.round(search.learning_rate(F.col("step"), 10, 100), 6).alias("lr"))


@query(
    f"with {GROUPED}, x as (select row_id, qtype, unnest(list_zip(keys, z)) as kz from g_), n as (select row_id, qtype, kz[1] as key, kz[2] as "
    f"z, row_number() over (partition by row_id, qtype order by kz[2] desc) as rn from x) select row_id, qtype, key, rn as place from n where rn "
    f"<= 3"
)
def top3_options(t):
    g = grouped(t).select("row_id", "qtype", F.explode(F.arrays_zip("keys", "z")).alias("x"))
    w = Window.partitionBy("row_id", "qtype").orderBy(F.desc("x.z"))
    return g.select("row_id", "qtype", F.col("x.keys").alias("key"), F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query(f"with {GROUPED} select row_id, len(list_filter(t, lambda x: x = list_max(t))) = 1 as unique_top from g_")
def unique_argmax(t):
    return grouped(t).select("row_id", (F.size(F.filter("t", lambda x: x == F.array_max("t"))) == 1).alias("unique_top"))
