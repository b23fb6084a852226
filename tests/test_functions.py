import datetime
import json
import math
import random

from pyspark.sql import functions as F

from plumbline.functions import dates, hashing, prob, text
from plumbline.operators import metrics, ranks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def by_hand(scores, temperature):
    top = max(scores)
    e = [math.exp((x - top) / temperature) for x in scores]
    p = [x / sum(e) for x in e]
    k = p.index(max(p))
    r = [round(x, 4) for x in p]
    r[k] = round(r[k] + (1 - sum(r)), 4)
    return p, r


def test_rounded_sums_to_one(spark):
    rng = random.Random(5)
    rows = [([rng.uniform(-6, 6) for _ in range(rng.randint(2, 77))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "z array<double>").withColumn("r", prob.rounded(prob.softmax(F.col("z"), 0.7)))
    for row in df.collect():
        assert round(sum(row.r) * 10_000) == 10_000
        assert abs(sum(round(x * 10_000) for x in row.r) - 10_000) == 0
        want = by_hand(row.z, 0.7)[1]
        assert max(abs(a - b) for a, b in zip(row.r, want)) <= 2e-4


def test_nine_options(spark):
    p = prob.rounded(prob.softmax(arr([(i * 7 % 13) - 6 for i in range(9)])))
    assert round(sum(one(spark, p)), 10) == 1.0


def test_confidence(spark):
    for xs, want in (([0.5, 0.5], 0.0), ([1.0, 0.0], 1.0), ([0.25] * 4, 0.0), ([1.0], 1.0)):
        assert one(spark, prob.confidence(arr(xs))) == want


def test_ties_go_first(spark):
    assert one(spark, prob.first_top(arr([0.2, 0.5, 0.5]))) == 1


def test_score_answer(spark):
    r = prob.rounded(prob.softmax(arr([-6, 3, 1.35])))
    assert 0.9 <= one(spark, prob.expectation(r)) <= 1.2


def test_merge(spark):
    m = one(spark, prob.rounded(prob.mean_of(arr([0.1, 0.8, 0.1]), arr([0.5, 0.3, 0.2]))))
    assert m[1] == 0.55 and abs(sum(i * p for i, p in enumerate(m)) - 0.85) < 1e-9


def ece_of(spark, pairs, bins=15):
    return metrics.ece(spark.createDataFrame(pairs, "p double, t double"), "p", "t", bins).first().ece


def test_ece(spark):
    assert ece_of(spark, [(0.0, 0.0)] * 50 + [(1.0, 1.0)] * 50) == 0
    assert ece_of(spark, [(1.0, 0.0)] * 100) == 1
    assert abs(ece_of(spark, [(0.2, 1.0)] * 20 + [(0.2, 0.0)] * 80)) < 1e-9
    assert abs(ece_of(spark, [(0.2, 0.3), (0.2, 0.1)])) < 1e-9
    assert ece_of(spark, [(None, 1.0)]) is None or math.isnan(ece_of(spark, [(None, 1.0)]))


def test_composite(spark):
    row = spark.createDataFrame(
        [(1.0, 0.93056, 0.55856, 0.098432, 0.255743, 10.632219, 561.593 * 1000 * 0.14 / 1e6)],
        "easy double, standard double, hard double, ece double, p50 double, p95 double, usd_per_1k double"
    )
    r = metrics.composite(row).first()
    for got, want in ((r.intelligence, 68.3286), (r.calibration, 80.3137), (r.speed, 69.6351), (r.cost, 43.1335), (r.composite, 63.7175)):
        assert abs(got - want) < 2e-3


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 2, 9, 7]] + [(None,)], "v double")
    assert ranks.nearest(df, "v", 0.5).first().v == sorted([5, 1, 4, 4, 2, 9, 7])[7 // 2]
    assert ranks.nearest(df, "v", 0.95).first().v == 9


def test_business_days(spark):
    d = lambda s: F.lit(s).cast("date")
    none = F.array().cast("array<date>")
    assert one(spark, dates.business_day_add(d("2024-01-01"), F.lit(3), F.array(d("2024-01-01")))) == datetime.date(2024, 1, 4)
    assert one(spark, dates.business_day_add(d("2024-01-05"), F.lit(1), none)) == datetime.date(2024, 1, 8)
    assert one(spark, dates.business_day_add(d("2024-01-05"), F.lit(0), none)) == datetime.date(2024, 1, 5)
    assert one(spark, dates.month_add(d("2024-11-10"), F.lit(3))) == datetime.date(2025, 2, 10)
    assert one(spark, dates.months_complete(d("2024-01-31"), d("2024-02-29"))) == 0


def test_ordinals(spark):
    got = [r.x for r in spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 11, 21, 22, 23, 31)], "n int").select(text.ordinal(F.col("n")).alias("x")).collect()]
    assert got == ["1st", "2nd", "3rd", "4th", "11th", "21st", "22nd", "23rd", "31st"]


def test_hash_split(spark):
    import hashlib

    ids = [f"row-{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", hashing.is_val(F.col("id")).alias("v"))
    for r in df.collect():
        assert r.v == (int(hashlib.sha256(r.id.encode()).hexdigest()[:8], 16) % 10 == 0)


def test_json_text(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "ä"}',), ("plain",), (None,), ("",)], "t string").select(
        text.canonical_json("t").alias("c"), text.loose_json("t").alias("l")
    )
    got = df.collect()
    assert got[0].c == '{"a": "ä", "b": 1}' and got[1].c == '"plain"' and got[2].c is None
    assert json.loads(got[0].l)["b"] == 1 and got[1].l is None and got[3].l is None
    fenced = spark.createDataFrame(
        [('```json\n{"p": 1}\n```',), ('So: {"p": 2} indeed',), ("[1]",)], "t string"
    ).select(text.loose_json("t").alias("l")).collect()
    assert [r.l for r in fenced] == ['{"p": 1}', '{"p": 2}', None]


def test_shingles_of_short_texts(spark):
    df = spark.createDataFrame([("a b c",), ("a b c d e f g h i",), (None,), ("",)], "t string").select(text.shingles(text.tokens(F.col("t"))).alias("s"))
    assert [len(r.s) for r in df.collect()] == [0, 2, 0, 0]
