"""Sinks, builders, strict stores, messages and shaping functions on small tables with nulls, ties and repeats."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates, messages, prob, text
from plumbline.operators import audit, expand, feedback, ingest, pipeline, ranks, validate
from plumbline.sources import builders, records, sinks


def test_rewrite_replaces_a_table_by_what_was_made_of_it(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    sinks.rewrite(spark.read.parquet(path).where("id < 4"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    broken = spark.read.parquet(path).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        sinks.rewrite(broken, path)
    assert spark.read.parquet(path).count() == 4


def test_shards_are_counted(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.write_shards(spark.range(100), path, "id", 4) == 100 and sinks.read_shards(spark, path).count() == 100
    spark.range(3).withColumn("shard", F.lit(1)).write.mode("append").partitionBy("shard").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        sinks.read_shards(spark, path)


def test_files_reports_and_verdicts(spark, tmp_path):
    df = spark.createDataFrame([("a", b"1"), ("a", b"1"), (None, b"2"), ("b", None), ("c", b"33")], "name string, content binary")
    assert sorted(tuple(r) for r in sinks.write_files_once(df, str(tmp_path / "f")).collect() or []) in ([], [("a", 1), ("c", 2)])
    sinks.write_files_once(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert sinks.write_report(spark.sql("select 1 as a, 'ä' as b"), str(tmp_path / "r.json")) == {"a": 1, "b": "ä"}
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(2), str(tmp_path / "r2.json"))
    assert sinks.markdown(spark.sql("select 'x|y' as a, 0.5D as b, null as c"), "T").splitlines()[-1] == "| x\\|y | 0.5000 | n/a |"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(20), "T", 10)
    gates = spark.createDataFrame(
        [("acc", 0.9, ">=", 0.8, True), ("ece", 0.2, "<=", 0.1, False)], "name string, value double, cmp string, bar double, passed boolean"
    )
    sinks.keep_verdict(gates, str(tmp_path / "v"), "one")
    kept = sinks.keep_verdict(gates.where("passed"), str(tmp_path / "v"), "two").collect()
    assert [(r.run, r.all_pass) for r in kept] == [("two", True), ("one", False)]


def test_loads_that_merge(spark, tmp_path):
    for i, body in enumerate(('{"a": "x", "b": [1, 2]}', '{"a": {"c": null}}')):
        (tmp_path / f"{i}.json").write_text(body)
    got = {r.key: r.value for r in records.read_maps(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")]).collect()}
    assert got == {"a": '{"c":null}', "b": "[1,2]"}
    with pytest.raises(FileNotFoundError):
        records.with_ordinals([])
    assert records.first_rows(spark.range(5), "id", 0).count() == 5 and records.first_rows(spark.range(5), "id", 2).count() == 2


def test_builders(spark):
    assert set(builders.BUILDERS) == {"reading", "claims", "entailment", "intents", "ratings", "emotions", "entailment_zh"}
    with pytest.raises(KeyError):
        builders.build("nothing", spark.range(1), 1)
    rows = [(0, " c1 ", "e", 0), (1, "c1", "other", 1), (2, None, "e", 0), (3, "c2", " ", 0), (4, "c3\n", "e3", 1)]
    df = spark.createDataFrame(rows, "ord long, claim string, evidence string, label int")
    got = builders.build("claims", df, 5).orderBy("row_id").collect()
    assert [(r.row_id, r.label, r.state) for r in got] == [("claims-0", 1, '{"claim":"c1","evidence":"e"}'), ("claims-1", 0, '{"claim":"c3","evidence":"e3"}')]
    assert builders.build("claims", df.where("false"), 5).count() == 0
    e = spark.createDataFrame([(0, "a", []), (1, "b", [2, 1]), (2, "c", None), (3, "d", [0])], "ord long, text string, labels array<int>")
    assert [(r.row_id, r.label) for r in builders.build("emotions", e, 1, names=["x", "y", "z"]).collect()] == [("emotions-0", 2)]


def test_strict_stores(spark):
    store = spark.createDataFrame(
        [("a", 1.0, None, None), ("b", None, None, None)],
        "id string, ts double, review struct<status: string, reviewer: string, note: string, reviewed_ts: double>, state string"
    )
    new = store.where("id = 'a'")
    with pytest.raises(ValueError):
        feedback.add(store, new)
    with pytest.raises(ValueError):
        feedback.add(store.where("false"), new.unionByName(new))
    assert feedback.add(store.where("id = 'b'"), new).count() == 2
    decision = spark.createDataFrame([("z", "confirmed", "r", None, 1.0)], "id string, status string, reviewer string, note string, reviewed_ts double")
    with pytest.raises(KeyError):
        feedback.review_strictly(store, decision)
    assert tuple(feedback.removed(store, 0.5).first()) == (1, 1) and tuple(feedback.removed(store.where("false"), 0.5).first()) == (0, 0)


def test_redaction_changes_one_value_only(spark):
    states = ['{"note":"x","n":5,"deep":{"k":[1,2]},"b":true,"z":null}', '{"n":5}', "plain note", None, '["note"]', '{"note": ']
    df = spark.createDataFrame([(s, (False, 3)) for s in states] + [(states[0], None)], "state string, privacy struct<redacted: boolean, days: int>")
    got = [(r.state, r.privacy and r.privacy.redacted) for r in feedback.redact(df, ["note"]).collect()]
    import json

    assert json.loads(got[0][0]) == {"note": "<redacted>", "n": 5, "deep": {"k": [1, 2]}, "b": True, "z": None} and got[0][1] is True
    assert json.loads(got[1][0]) == {"n": 5} and [g[0] for g in got[2:6]] == states[2:6] and [g[1] for g in got[2:6]] == [False] * 4 and got[6][1] is True


def test_matched_refuses_what_is_missing(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert expand.matched(left.where("k = 'a'"), right, "k").first().v == 1
    with pytest.raises(Exception, match="no k b"):
        expand.matched(left, right, "k").collect()


def test_audit_refuses_hits(spark):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([("i1", words), ("i2", words), ("i3", None), ("i4", "too short")], "item_id string, t string")
    train = spark.createDataFrame(
        [("r1", f"so {words} and"), ("r1", f"so {words} and"), ("r2", None), ("r3", "w0 w1 w2 w3 w4 w5 w6 x")], "row_id string, t string"
    )
    pairs = audit.overlap_pairs(items, "item_id", "t", train, "row_id", "t")
    assert sorted(tuple(r) for r in pairs.collect()) == [("i1", "r1", 5), ("i2", "r1", 5)]
    with pytest.raises(ValueError, match="held-out"):
        pipeline.refuse_hits(pairs)
    pipeline.refuse_hits(pairs.where("false"))
    assert audit.overlap_pairs(items.where("false"), "item_id", "t", train, "row_id", "t").count() == 0


def test_configurations():
    good = {
        "name": "run-1", "base": {"path": "p"}, "profile": "x", "data": {}, "train": {},
        "gates": {k: {"cmp": c[-1], "value": 0.5} for k, c in pipeline.GATES.items()}
    }
    assert pipeline.config_errors(good) == []
    assert pipeline.config_errors([]) and pipeline.config_errors({}) and pipeline.config_errors(good | {"name": "a b"}) and pipeline.config_errors(good | {"base": {}})
    assert pipeline.config_errors(good | {"gates": good["gates"] | {"ece": {"cmp": ">=", "value": 1}}})
    assert pipeline.config_errors(good | {"gates": good["gates"] | {"mnli": {"cmp": ">", "value": True}}})


def test_exact_gelu_and_erf(spark):
    xs = [-9.0, -4.6, -3.2, -1.0, -1e-9, 0.0, 0.3, 1.7, 4.4, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(prob.erf(F.col("x")).alias("e"), prob.gelu(F.col("x")).alias("g")).collect()
    for x, r in zip(xs, got):
        assert abs(r.e - math.erf(x)) < 1e-9 and abs(r.g - x * 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-8


def test_dates_and_formats(spark):
    r = spark.sql("select date'2024-03-01' as a, date'2024-03-15' as b, date'2024-01-31' as c")
    s = r.select(*[v.alias(k) for k, v in dates.styles(F.col("c")).items()], dates.styles_zh(F.col("c"))["wd"].alias("zh")).first()
    assert (s.iso, s.us, s.uk, s.abbr, s.ord, s.wd, s.zh) == (
        "2024-01-31", "January 31, 2024", "31 January 2024", "Jan 31, 2024", "the 31st of January 2024", "Wednesday, January 31, 2024",
        "2024年1月31日（星期三）"
    )
    m = r.select(*[dates.months_complete(dates.months_before(F.col(c), F.lit(n)), F.col(c)).alias(f"{c}{n}") for c in "ab" for n in (0, 1, 2, 14)]).first()
    assert all(m[f"{c}{n}"] == n for c in "ab" for n in (0, 1, 2, 14))
    assert r.select(dates.holiday_list_zh(F.array("a", "b", "c")).alias("x")).first().x == "2024年1月31日、2024年3月15日、2024年3月1日"
    f = spark.sql("select 1205 as c, 'a@b.c' as m, 'none' as n").select(
        text.money(F.col("c"), "$").alias("c"), text.mail_domain(F.col("m")).alias("m"), text.mail_domain(F.col("n")).alias("n")
    ).first()
    assert tuple(f) == ("$12.05", "b.c", None)


def test_messages(spark):
    r = spark.sql(
        "select '{\"b\": 1, \"a\": \"<x>\"}' as s, 'plain' as p, array('x', 'y') as o, cast(null as string) as c, map('x', 'the x') as d, array('l') as l"
    )
    c = messages.candidates(F.lit("choice"), F.col("c"), F.col("o"), F.col("d"), F.col("l"))
    got = r.select(messages.content(F.col("s")).alias("s"), messages.content(F.col("p")).alias("p"), c.alias("c"), messages.kind_of(c).alias("k"), messages.letter_index(c, F.lit("y")).alias("i"), messages.letter_index(c, F.lit("q")).alias("none"),
                   messages.candidates(F.lit("score"), F.col("c"), F.col("o"), F.col("d"), F.col("l")).alias("few")).first()
    assert got.s == '{"b":1,"a":"\\u003cx\\u003e"}' and got.p == "plain" and [tuple(x) for x in got.c] == [("A", "x", "the x"), ("B", "y", "y")]
    assert got.k == "choice" and got.i == 1 and got.none is None and got.few is None
    whole = r.select(
        messages.message(F.col("p"), F.lit("q1"), F.concat(F.lit("["), messages.field(F.lit("q1"), F.lit("So?"), c), F.lit("]"))).alias("m")
    ).first().m
    assert whole == '{"context":"plain","schema":[{"name":"q1","description":"So?","choices":[{"code":"A","value":"x","description":"the x"},{"code":"B","value":"y","description":"y"}]}]}\n\nRequested field: "q1"'
    long = r.select(
        messages.lettered_prompt(F.col("p"), F.lit("choice"), F.lit("Q"), F.col("c"), F.array_repeat(F.lit("z"), 17)).alias("m"),
        messages.lettered_prompt(F.col("p"), F.lit("choice"), F.lit("Q"), F.col("c"), F.col("o")).alias("n")
    ).first()
    assert long.m is None and long.n == "plain\n\n[choice] Q\nA. x\nB. y\nanswer:"


def test_ranks_within_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 7), (None, None), ("b", 2), ("a", 2)], "g string, v int")
    assert sorted((str(r.g), str(r.v), r.n) for r in ranks.dense(df, "v", "n", "g").collect()) == sorted(
        [("a", "1", 0), ("a", "2", 1), ("a", "3", 2), ("None", "None", 0), ("None", "7", 1), ("b", "2", 0)]
    )
    assert ingest.dense_numbers(df.where("false"), "v", "n", "g").count() == 0


def test_request_errors(spark):
    bodies = [
        None, "", "[]", "{}", '{"state": "s"}', '{"state": "s", "model": "m", "questions": {"": {}}}',
        '{"state": [], "model": "m", "questions": {"q": {"type": "noul", "instructions": {}}}}'
    ]
    got = [r.e for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(validate.request_error("b").alias("e")).collect()]
    assert got == ["body", "body", "body", "state", "model", "questions", None]


def test_grid_of_groups(spark):
    """Against a plain loop; empty and null arrays and rows without gold are left out."""
    import random

    from plumbline.operators import search

    rng = random.Random(4)
    rows = [("choice", [rng.gauss(0, 2) for _ in range(k)], [rng.gauss(0, 2) for _ in range(k)], float(rng.randrange(k))) for k in (1, 2, 3, 5) * 30]
    schema = "qtype string, z array<double>, y array<double>, gold double"
    df = spark.createDataFrame(rows + [("choice", [], [], 0.0), ("choice", None, None, 0.0), ("choice", [1.0], [1.0], -1.0), ("choice", [1.0], [1.0], None)], schema)
    best = search.blend_grid_of_groups(df, [0.0, 0.5, 1.0], [0.5, 2.0]).collect()

    def brier(w, tau):
        out = 0.0
        for _, z, y, gold in rows:
            e = [math.exp(a * w + b / tau * (1 - w)) for a, b in zip(z, y)]
            out += sum((x / sum(e) - (i == gold)) ** 2 for i, x in enumerate(e))
        return round(out / len(rows), 12)

    least = min(((brier(w, tau), i, w, tau) for i, (w, tau) in enumerate((w, tau) for w in (0.0, 0.5, 1.0) for tau in (0.5, 2.0))))
    assert [(r.qtype, r.w, r.tau, r.brier) for r in best] == [("choice", least[2], least[3], round(least[0], 6))]
    assert search.blend_grid_of_groups(df.where("false"), [0.0], [1.0]).count() == 0
