"""Mixing sources to target weights by hash-seeded Poisson replication.

Every record has a uniform number from a hash of its key. A source whose target asks for the mean repetition rate r gets
the Poisson distribution, cut off at its cap, of mean r; a record's count is that distribution inverted at its number.
The rate is set where the weight that these very numbers bring reaches the target, from a histogram of weight
over the numbers (BINS rows per source of the target table), so shares are met beyond Poisson noise. Records are
exploded by their counts and ordered by another hash.

A record is a pass (row_id, kind, key); of repeated ones the one expanded last holds. A null, NaN or implausible
weight (below 0 or over most_weight) counts as 1; a record of weight 0 adds nothing and is left out. Sources without a target are
left out, targets without records get no weight, a null or negative cap is 0. The total is by default the largest at which
every source that has records holds its share exactly; where a larger total is asked for, sources held back by their cap stay
below their share and are told.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import source_of

#: A weight over MOST_WEIGHT is implausible: weights made from soft labels lie from 0.25 to 1, so ten times that is an error of the data. A parameter of the calls below.
BINS, MOST_WEIGHT, SEED = 4096, 10.0, 17
#: Rows of the target table at most; the plan is held by every worker.
MOST_TARGETS = 100_000


def records(passes: DataFrame, most_weight: float = MOST_WEIGHT) -> DataFrame:
    """row_id, kind, key, pos, source, weight, u: one row per record, latest expansion."""
    latest = passes.where("row_id is not null").groupBy("row_id", "kind", "key").agg(F.max(F.struct("expanded_at", "pos", "weight")).alias("x"))
    w = F.col("x.weight")
    weight = F.when(w.isNull() | F.isnan(w) | (w < 0) | (w > most_weight), F.lit(1.0)).otherwise(w)
    u = F.pmod(F.xxhash64(F.lit(SEED), "row_id", "kind", "key"), F.lit(1 << 52)) / float(1 << 52)
    return latest.select(
        "row_id", "kind", "key", F.col("x.pos").alias("pos"), source_of(F.col("row_id")).alias("source"), weight.alias("weight"), u.alias("u")
    ).where("weight > 0")


def poisson_steps(mean: float, cap: int) -> list[float]:
    """The distribution function at 0 .. cap-1: a number above the k-th step gets at least k+1 copies."""
    steps, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        steps.append(min(total, 1.0))
    return steps


def _weight_at(mean: float, cap: int, weights: list[float]) -> float:
    tails = [0.0] * (BINS + 1)
    for b in range(BINS - 1, -1, -1):
        tails[b] = tails[b + 1] + weights[b]
    got = 0.0
    for s in poisson_steps(mean, cap):
        x = s * BINS
        b = min(int(x), BINS)
        got += tails[b] - (x - b) * (weights[b] if b < BINS else 0.0)
    return got


def rates(base: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """Per target: available weight, wanted weight and the steps of its distribution. targets is a small fixed table."""
    if targets.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets can't be held by every worker")
    rows = {
        r.source: r for r in targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(
            F.max("target_share").alias("share"), F.max("max_repeat").alias("cap")
        ).collect()
    }
    hist = base.where(F.col("source").isin(list(rows))).groupBy(
        "source", F.floor(F.col("u") * BINS).cast("int").alias("bin")
    ).agg(F.sum("weight").alias("w")).collect() if rows else []
    weights = {s: [0.0] * BINS for s in rows}
    for r in hist:
        weights[r.source][r.bin] += r.w
    have = {s: math.fsum(w) for s, w in weights.items()}
    asked = {s: max(r.share or 0.0, 0.0) for s, r in rows.items()}
    if total is None:  # the largest at which no cap binds
        total = min((max(int(rows[s].cap or 0), 0) * have[s] / asked[s] for s in rows if have[s] and asked[s] and rows[s].cap), default=0.0)
    full = sum(have.values())  # a mixture as large as what there is: here caps bind
    share = sum(asked[s] for s in rows if have[s])
    reach = {s: min(asked[s] / share * full if share else 0.0, max(int(rows[s].cap or 0), 0) * have[s]) for s in rows}
    out = []
    for s, r in sorted(rows.items()):
        cap, wanted = max(int(r.cap or 0), 0), asked[s] * total
        if not have[s] or not wanted or not cap:
            steps = []
        elif wanted >= cap * have[s]:
            steps = [-1.0] * cap
        else:
            lo, hi = 1e-9, 40.0 * cap + 40
            for _ in range(80):
                mid = (lo + hi) / 2
                if _weight_at(mid, cap, weights[s]) < wanted:
                    lo = mid
                else:
                    hi = mid
            steps = poisson_steps(hi, cap)
        out.append(
            {
                "source": s, "target_share": r.share, "max_repeat": r.cap, "available_weight": have[s], "wanted_weight": wanted, "steps": steps,
                "full_share": reach[s] / sum(reach.values()) if sum(reach.values()) else 0.0,
                "full_held_back": bool(asked[s] > 0 and reach[s] < asked[s] / (share or 1.0) * full * (1 - 1e-12) or asked[s] > 0 and not have[s]),
                "held_back": bool(have[s] == 0 and wanted > 0 or wanted > cap * have[s] * (1 + 1e-12))
            }
        )
    return out


def mixture(passes: DataFrame, targets: DataFrame, total: float | None = None, most_weight: float = MOST_WEIGHT) -> DataFrame:
    """row_id, kind, key, pos, source, weight, copy_no, shuffle_rank in shuffled order; total: the weight wanted, by default the largest that lets every source hold its share."""
    spark = passes.sparkSession
    base = written(records(passes, most_weight), "p1-records")
    plan = [(r["source"], r["steps"]) for r in rates(base, targets, total)]
    steps = spark.createDataFrame(plan, "source string, steps array<double>")
    counted = base.join(F.broadcast(steps), "source").withColumn("n", F.expr("size(filter(steps, s -> u > s))")).where("n > 0")
    copies = counted.select("row_id", "kind", "key", "pos", "source", "weight", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy_no"))
    return copies.withColumn("shuffle_rank", F.xxhash64(F.lit(SEED + 1), "row_id", "kind", "key", "copy_no")).orderBy("shuffle_rank")


PLAN = "source string, target_share double, max_repeat int, available_weight double, wanted_weight double, full_share double, full_held_back boolean, steps array<double>, held_back boolean"


def shares(passes: DataFrame, targets: DataFrame, total: float | None = None, most_weight: float = MOST_WEIGHT) -> DataFrame:
    """Per target source: what was asked, what there is, what was reached (weight, records, share), and whether the cap held it back; full_share and
    full_held_back tell the same of a mixture as large as all that is available, in which scarce sources stop at their caps."""
    spark = passes.sparkSession
    base = written(records(passes, most_weight), "p1-records")
    plan = rates(base, targets, total)
    names = [f.split()[0] for f in PLAN.split(", ")]
    steps = spark.createDataFrame([tuple(r[k] for k in names) for r in plan], PLAN)
    copies = F.expr("size(filter(steps, s -> u > s))")
    got = base.join(F.broadcast(steps.select("source", "steps")), "source").groupBy("source").agg(
        F.sum(F.col("weight") * copies).alias("w"), F.sum(copies).alias("records")
    )
    got = got.select("source", F.coalesce("w", F.lit(0.0)).alias("actual_weight"), F.coalesce("records", F.lit(0)).alias("records"))
    rows = {r.source: r for r in got.collect()}  # a row for each target
    whole = math.fsum(r.actual_weight for r in rows.values())
    out = [
        (
            r["source"], r["target_share"], r["max_repeat"], r["available_weight"], r["wanted_weight"], w, n, w / whole if whole else 0.0,
            r["held_back"], r["full_share"], r["full_held_back"]
        )
        for r in plan
        for w, n in [(rows[r["source"]].actual_weight, rows[r["source"]].records) if r["source"] in rows else (0.0, 0)]
    ]
    return spark.createDataFrame(
        out,
        "source string, target_share double, max_repeat int, available_weight double, wanted_weight double, actual_weight double, records long, actual_share double, held_back boolean, full_share double, full_held_back boolean"
    )
