import pytest
from pyspark.sql import functions as F

from plumbline.functions import prob
from plumbline.operators import batches, expand, feedback, ingest, metrics, pipeline, search, validate, vectors
from plumbline.plans import catalogue
from plumbline.sources import records
from plumbline.streaming import feedback as stream


def test_expanded_texts_equal_the_stored_passes(spark, data):
    """Stored passes that were made from the row as it now stands carry exactly the text that we serialise."""
    t = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    rows = records.last_wins(t("row_examples"), ["row_id"], "ingested_at", "snapshot_no")
    ours = expand.expand(
        rows, t("option_desc"), t("attr_levels"), records.last_wins(t("soft_labels"), ["row_id"], "scored_at"), 255
    ).select("row_id", "kind", "key", "text")
    stored = records.last_wins(t("passes"), ["row_id", "kind", "key"], "expanded_at").select(
        "row_id", "kind", F.col("key").alias("k"), F.col("text").alias("stored")
    )
    j = ours.join(stored, ["row_id", "kind"]).where(F.col("key").eqNullSafe(F.col("k"))).join(rows.select("row_id", "state"), "row_id")
    alike = j.where(F.col("stored").startswith(F.concat("state", F.lit("\n\n["))))
    n, other = alike.count(), alike.where("text <> stored").select("text", "stored").limit(1).collect()
    assert n > 100 and not other


def test_expand_keeps_gold_and_caps(spark):
    rows = spark.createDataFrame(
        [
            ("a-1", "choice", "s", "i", None, 3, (["o%d" % i for i in range(9)], None)), ("a-2", "noul", "s", "i", '{"true": "x"}', 1, (None, None)),
            ("a-3", "score", "s", "i", None, 2, (None, "tone")), ("a-4", "choice", None, None, None, None, (None, None))
        ],
        "row_id string, primitive string, state string, instructions string, criteria string, label int, meta struct<options: array<string>, attribute: string>",
    )
    desc = spark.createDataFrame([("o3", "third")], "name string, description string")
    levels = spark.createDataFrame([("tone", ["a", "b", "c", "d", "e"])], "attribute string, levels array<string>")
    soft = spark.createDataFrame([("a-2", 0.72, 0.8)], "row_id string, p double, weight double")
    p = expand.expand(rows, desc, levels, soft, 4).collect()
    choice = [r for r in p if r.row_id == "a-1"]
    assert len(choice) in (4, 9) and sum(r.target for r in choice) == 1 and any(r.key == "o3" and "o3: third" in r.text for r in choice)
    score = sorted((r for r in p if r.row_id == "a-3"), key=lambda r: r.pos)
    assert [r.target for r in score] == [0, 0, 1, 0, 0] and "level 3 of 5 - c" in score[2].text
    noul = next(r for r in p if r.row_id == "a-2")
    assert noul.soft == 0.72 and noul.text.endswith("\ncriteria - true: x\nanswer:")
    assert not [r for r in p if r.row_id == "a-4"]
    g = {r.row_id: r for r in expand.regroup(spark.createDataFrame(p)).collect()}
    assert list(g["a-3"].target) == [0, 0, 1, 0, 0]


def test_ingest(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 3 % 7) for i in range(1000)] + [(1000, None, None)], "id long, g string, v long")
    n = ingest.dense_numbers(df, "id", "n").collect()
    assert sorted(r.n for r in n) == list(range(1001)) and all(r.n == r.id for r in n)
    assert ingest.first_n_per_group(df, "g", "id", 3).groupBy("g").count().where("count > 3").count() == 0
    assert sorted(r.id for r in ingest.first_n_per_group(df, "g", "id", 2).where("g = 'a'").collect()) == [0, 2]
    assert ingest.oversample(df, F.when(F.col("id") < 2, 3).otherwise(0)).count() == 6
    assert ingest.equal_chunks(df, "id", 100).select("chunk").distinct().count() == 11
    empty = df.where("false")
    assert ingest.dense_numbers(empty, "id", "n").count() == 0


def test_last_wins_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "k", 1)], "id string, key string, at int")
    got = {(r.id, r.key): r["at"] for r in records.last_wins(df, ["id", "key"], "at").collect()}
    assert got == {("a", None): 2, ("b", "k"): 1}
    path = str(tmp_path / "out")
    records.append_new(df.dropDuplicates(["id"]), path, ["id", "key"])
    records.append_new(df.dropDuplicates(["id"]), path, ["id", "key"])
    assert spark.read.parquet(path).count() == 2


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"row_id": "r-1", "p": 0.5}\n\n{"row_id": "r-2", "p"\n{"row_id": "r-3", "p": null}\n')
    assert records.read_jsonl(spark, path, "row_id string, p double", torn="DROPMALFORMED").where("row_id is not null").select("row_id").count() == 2
    out = str(tmp_path / "out")
    records.write_jsonl(spark.createDataFrame([("ä", None)], "a string, b string"), out)
    assert '"b":null' in "".join(r.value for r in spark.read.text(out).collect())


def record(**change):
    base = dict(
        id="f1", ts=1.0, kind="correction", served_as="m", question=("choice", "i", ["a", "b"], None), state='{"plan": "x", "region": "y"}',
        state_sha256="0" * 64, feedback=("b", None), privacy=(False, 30, False), review=("pending", None, None, None), license="l"
    )
    return tuple((base | change).values())


SCHEMA = "id string, ts double, kind string, served_as string, question struct<type: string, instructions: string, options: array<string>, levels: array<string>>, state string, state_sha256 string, feedback struct<answer: string, comment: string>, privacy struct<redacted: boolean, retention_days: int, opt_out: boolean>, review struct<status: string, reviewer: string, note: string, reviewed_ts: double>, license string"


def test_feedback_flow(spark):
    store = spark.createDataFrame(
        [record(), record(id="f2", kind="nonsense", state=None), record(id="f3", privacy=(False, 30, True)), record(id="f4", state="plain")], SCHEMA
    )
    errors = {r.id: r.e for r in store.select("id", feedback.errors().alias("e")).collect()}
    assert errors["f1"] == [] and errors["f2"] == ["kind"]
    d = spark.createDataFrame(
        [("f1", "confirmed", "me", "ok", 2.0), ("f3", "confirmed", "me", "ok", 2.0), ("zz", "confirmed", "me", "", 2.0)],
        "id string, status string, reviewer string, note string, reviewed_ts double"
    )
    reviewed = feedback.review(store, d)
    assert [r.id for r in feedback.unknown(store, d).collect()] == ["zz"]
    assert [(r.row_id, r.label) for r in feedback.export(reviewed).collect()] == [("feedback-f1", 1)]
    assert feedback.export(reviewed, respect_opt_out=False).count() == 2
    assert sorted(r.id for r in feedback.prune(reviewed, 10.0).collect()) == ["f1", "f3"]
    red = {r.id: r.state for r in feedback.redact(store, ["plan"]).collect()}
    assert "<redacted>" in red["f1"] and '"region":"y"' in red["f1"] and red["f2"] is None and red["f4"] == "plain"
    assert feedback.duplicates(store.union(store.where("id = 'f1'"))).count() == 1
    assert {(r.dimension, r.value): r.n for r in feedback.stats(store).collect()}[("all", "all")] == 4


def test_batches(spark):
    df = spark.createDataFrame(
        [(f"r{i}", "q", (i * 37) % 90 + 1) for i in range(500)] + [("big", "q", 5000), ("none", "q", None)],
        "row_id string, qtype string, tokens long"
    )
    got = batches.pack(df, "row_id", "qtype", "tokens", 1000, rows_per_group=200)
    per = got.groupBy("batch").agg(F.sum("cost").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in per) == 502 and all(r.s <= 1000 or r.n == 1 for r in per)
    padded = batches.pack(
        df.where("tokens < 1000"), "row_id", "qtype", "tokens", 1000, True
    ).groupBy("batch").agg((F.max("cost") * F.count("*")).alias("s")).collect()
    assert all(r.s <= 1000 for r in padded)


def test_search(spark):
    import math
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        z = rng.gauss(0, 1)
        rows.append((4 * z, float(rng.random() < 1 / (1 + math.exp(-2 * z))), z))  # true temperature 2
    df = spark.createDataFrame(rows, "z double, t double, y double")
    t = search.fit_temperature(df.select("z", "t")).first().temperature
    assert 1.5 <= t <= 2.5
    w, taus, biases = [0.0, 0.5, 1.0], [0.5, 1.0, 2.0], [-0.5, 0.0]
    p = prob.sigmoid(F.col("z") * F.col("w") + (F.col("y") + F.col("b")) / F.col("tau") * (1 - F.col("w")))
    best = search.blend_grid(df.withColumn("qtype", F.lit("noul")), F.pow(p - F.col("t"), F.lit(2.0)), w, taus, biases).first()
    by_hand = {}
    for a in w:
        for tau in taus:
            for b in biases:
                q = [1 / (1 + math.exp(-(z * a + (y + b) / tau * (1 - a)))) for z, _, y in rows]
                by_hand[a, tau, b] = sum((x - r[1]) ** 2 for x, r in zip(q, rows)) / len(rows)
    least = min(by_hand, key=by_hand.get)
    assert (best.w, best.tau, best.b) == least and abs(best.brier - by_hand[least]) < 1e-6
    assert search.fit_temperature(df.where("false").select("z", "t")).count() == 0


def test_validate(spark):
    rows = [
        ("s", "choice", "i", ["a"], None), ("s", "choice", "i", ["a", ""], None), ("s", "score", "i", None, ["1"] * 11),
        (None, "noul", "i", None, None), ("s", "what", "i", None, None), ("s", "noul", "", None, None), ("s", "noul", "i", None, None)
    ]
    df = spark.createDataFrame(rows, "state string, kind string, instructions string, options array<string>, levels array<string>")
    got = [r.e for r in df.select(validate.first_error(*map(F.col, df.columns)).alias("e")).collect()]
    assert got == ["criteria", "criteria.option", "criteria", "state", "type", "instructions", None]
    sizes = spark.createDataFrame([(640.0, 640.0), (1024.0, 768.0), (1920.0, 1080.0), (4000.0, 3000.0)], "w double, h double")
    assert [r.n for r in sizes.select(validate.image_tokens(F.col("w"), F.col("h")).alias("n")).collect()] == [400, 768, 2040, 11750]


def test_vectors(spark):
    a = spark.createDataFrame([("x", [1.0, 3.0]), ("x", [3.0, 5.0]), ("y", None)], "g string, v array<double>")
    assert {(r.g, r.pos): r["mean"] for r in vectors.average(a, "g", "v").collect()} == {("x", 0): 2.0, ("x", 1): 4.0}
    b = spark.createDataFrame([("x",), ("z",)], "g string")
    assert sorted(r.g for r in vectors.mismatched(a, b, "g").collect()) == ["y", "z"]


def test_verdicts(spark):
    m = spark.createDataFrame([("ece", 0.11), ("acc", 0.9)], "name string, value double")
    g = spark.createDataFrame([("ece", "<=", 0.10), ("acc", ">=", 0.9), ("other", ">=", 0.1)], "name string, cmp string, bar double")
    assert {r.name: r.passed for r in metrics.verdicts(m, g).collect()} == {"ece": False, "acc": True, "other": False}


def test_pipeline(spark, tmp_path):
    run = pipeline.Run(spark, str(tmp_path / "run"), {"a": 1})
    calls = []
    make = lambda: (calls.append(1), spark.range(5))[1]
    run.stage("s", make, 5)
    run.stage("s", make, 5)
    assert len(calls) == 1
    assert {r.stage: r.status for r in pipeline.latest_status(run.events()).collect()}["s"] == "skipped"
    with pytest.raises(ValueError):
        run.stage("t", lambda: spark.range(0), 1)
    with pytest.raises(ValueError):
        pipeline.Run(spark, str(tmp_path / "run"), {"a": 2})
    pipeline.Run(spark, str(tmp_path / "run"), {"a": 1})


def test_streaming(spark, tmp_path, data):
    source = spark.read.parquet(f"{data}/feedback_records.parquet").select("id", "kind", "received_at")
    folder = str(tmp_path / "in")
    source.union(source).write.parquet(folder)
    live = spark.readStream.schema(source.schema).parquet(folder)
    q = stream.append_new(live, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.select("id").distinct().count()
    q = stream.counts(live, delay="0 seconds").writeStream.format("memory").queryName("kinds").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kinds").count() > 0
