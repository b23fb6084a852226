"""Keys that survive n/8 edits, and bounds that drop only what can't be near-same."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import bags


def test_marks_never_exceed_the_edits():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randint(0, 300) for _ in range(rng.randint(8, 400))]
        b, e = list(a), rng.randint(0, len(a) // 8)
        for _ in range(e):
            at = rng.randrange(len(b))
            kind = rng.random()
            b[at : at + 1] = [rng.randint(0, 300)] if kind < 0.4 else [] if kind < 0.7 else [b[at], rng.randint(0, 300)]
        if not b or abs(len(a) - len(b)) > max(len(a), len(b)) // 8 or e > max(len(a), len(b)) // 8:
            continue
        toks = [np.array(x, np.int32).tobytes() for x in (a, b)]
        counts = np.random.default_rng(1).integers(0, 50, bags.BUCKETS)
        rec, key, marks = bags.leading(counts, np.zeros(2, np.int64), toks)
        assert set(key[rec == 0]) & set(key[rec == 1])
        x = np.zeros(2, bags.ENTRY)
        x["cls"], x["n"], x["marks"] = [1, 2], [len(a), len(b)], marks
        assert len(bags.close(x, np.array([0]), np.array([1]))) == 1


def test_blocks_change_no_pair(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.randint(0, 99) for _ in range(40)]
    rows = []
    for i in range(90):
        t = list(base)
        for at in rng.sample(range(40), rng.randint(1, 6)):
            t[at] = rng.randint(0, 99)
        rows.append((i, len(t), i % 3 == 0, i % 3 != 0 or i % 2 == 0, i % 2, np.array(t, np.int32).tobytes()))
    df = spark.createDataFrame(rows, "cls long, n int, ev boolean, tr boolean, space long, toks binary")
    usual = sorted(map(tuple, bags.possible_pairs(df).collect()))
    monkeypatch.setattr(bags, "BLOCK", 20)
    assert sorted(map(tuple, bags.possible_pairs(df).collect())) == usual and len(usual) > 100
    assert all((a - b) % 2 == 0 for a, b, _, _ in usual)
    assert bags.possible_pairs(df.where(F.col("cls") % 3 != 0).withColumn("ev", F.lit(False))).count() == 0
