"""Counting, encoding, packing, mixing and sampling."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import encoding, mixture, packing, sampling, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no vocabulary files here")

ODD = [
    "", " ", "\n", "a", "don't we'll 'tis", "  two  spaces \n\n\tend ", "x" * 5000, " " * 3000 + "y", "字" * 4000, "abc,def.ghi!" * 800, "<|endoftext|> [MASK] <pad>", "é‍👍🏽 ﬁ ﬀ ㍿",
    "Ünïcödé — “quoted” text… " * 300, "123456789" * 700, "ภาษาไทยไม่มีช่องว่าง" * 200, "a\r\nb\r\n" * 900, "'s't're've'm'll'd" * 500, "中文，没有空格。还有" * 700,
]


def test_parts_add_up():
    encode = tokens.encoder()
    for t in ODD:
        for size in (10, 97, 1000):
            p = tokens.parts(t, size)
            assert "".join(p) == t and sum(len(x) for x in encode(p)) == len(encode([t])[0])


def test_chunks_agree_with_whole_texts():
    encode = tokens.encoder()
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["the ", "ab", "，", "字", "\n", "  ", "9", "'s", "é", ". "]) for _ in range(rng.randint(1, 4000))) for _ in range(60)]
    for t in texts:
        ends = encoding.chunk_ends(t) if t else []
        pieces, at = [], 0
        for e in ends:
            c = t[at:e]
            at = e
            cuts = [m.start() for m in tokens.BOUNDARY.finditer(c)]
            pieces.append((c[: cuts[0]], encoding._pack(encode([c[cuts[0] : cuts[-1]]])[0]), c[cuts[-1] :]) if cuts else (c, None, None))
        assert encoding.assemble(pieces, encode).tolist() == encode([t])[0]


def test_encode_corpus(spark):
    shared = "A passage that many texts share, word for word. " * 30
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100 + i, f"{i} {shared}{i}", None) for i in range(50)] + [(200, None, None), (201, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: list(r.ids) for r in encoding.encode_corpus(df).collect()}
    encode = tokens.encoder()
    assert len(got) == len(rows) and all(got[i] == (encode([t])[0] if t else []) for i, t, _ in rows)
    assert encoding.encode_corpus(df.where("false")).count() == 0


def test_counts_of_oversized_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "word " * 60_000), (91, "word " * 60_000), (92, "字" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encode = tokens.encoder()
    got = sorted((r.doc_id, r.n_tokens) for r in tokens.count_texts(df, ["doc_id"]).collect())
    assert got == sorted((i, len(encode([t])[0]) if t else 0) for i, t in rows)
    for name in ("piece_bpe_32k", "word_bpe_49k", "byte_bpe_multi_50k"):
        other = tokens.encoder(name)
        few = df.where("doc_id < 6")
        assert sorted(
            r.n_tokens for r in tokens.count_texts(few, ["doc_id"], tokenizer=name).collect()
        ) == sorted(len(x) if t else 0 for t, x in zip(ODD[:6], other(ODD[:6])))


def test_totals(spark):
    passes = spark.createDataFrame(
        [("zhnli-1", "noul", None, 0, "他说。\n\n[noul] 是吗\nanswer:", 1), ("a-2", "choice_opt", "k", 1, None, 2)],
        "row_id string, kind string, key string, pos int, text string, n_tokens int"
    )
    docs = spark.createDataFrame(
        [(1, "The cat of the house is in.", "s", None, None), (2, None, None, "en-GB", "d"), (3, "Хорошо сказано", "s", "und", "d")] + [
            (10 + i, t, "s", k, "d") for i,
            (t, k) in enumerate([("the cat is in the house", "en"), ("a house of the cat", "en_US"), ("kissa on talossa", "fi"), ("talo on kissan", "fi")])
        ],
        "doc_id long, text string, source string, lang string, domain string"
    )
    counts = tokens.token_counts(passes, docs)
    rows = counts.collect()
    assert {
        (r.doc_id, r.lang) for r in rows if r.doc_id and r.doc_id < 10
    } == {(1, "en"), (2, "en"), (3, "ru")} and next(r.lang for r in rows if r.row_id == "zhnli-1") == "zh"
    totals = tokens.token_totals(counts).collect()
    whole = sum(r.n_tokens for r in rows)
    for name in ("source", "lang", "domain", "all", "source_lang_domain"):
        assert sum(r.tokens for r in totals if r.slice == name) == whole


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for cap in (1, 7, 64, 500):
        n = np.clip(rng.geometric(4 / (cap + 3), 3000), 1, cap)
        box = packing.best_two_fit(n, cap)
        fill = np.bincount(box, weights=n)
        assert box.min() == 0 and fill.max() <= cap and len(fill) <= 1.02 * np.ceil(n.sum() / cap) + 1
    assert packing.best_two_fit(np.array([6, 5, 5, 4]), 10).max() == 1  # greedy alone would take 6 and 4, and 5 and 5 as well
    assert packing.best_two_fit(np.array([], np.int64), 10).tolist() == []


def test_containers(spark):
    items = spark.createDataFrame([(i, i * 13 % 700) for i in range(900)] + [(900, 5000), (901, None), (902, 512), (903, 1024)], "doc_id long, n_tokens long")
    windows = spark.createDataFrame([("a", 512), ("b", 1024), ("none", None), ("zero", 0)], "window_name string, capacity_tokens int")
    got = packing.fill_containers(items, windows).toPandas()
    size = {r.doc_id: r.n_tokens or 0 for r in items.collect()}
    for w, cap in (("a", 512), ("b", 1024)):
        g = got[got.window_name == w]
        assert g.groupby("container_id").n_tokens.sum().max() <= cap
        per = g.groupby("doc_id").agg(n=("n_tokens", "sum"), k=("part", "size"))
        assert len(per) == 904 and all(per.n[i] == size[i] for i in size)
        assert all(k == 1 or size[i] > cap for i, k in per.k.items()) and all(per.k[i] == -(-size[i] // cap) for i in size if size[i] > cap)
    assert set(got.window_name) == {"a", "b"}
    report = {r.window_name: r for r in packing.fill_report(packing.fill_containers(items, windows), windows).collect()}
    assert report["a"].containers <= 1.01 * report["a"].least_containers + 1
    assert packing.fill_containers(items.where("false"), windows).count() == 0


PASS = "row_id string, kind string, key string, pos int, weight double, expanded_at timestamp"


def passes(spark, n):
    import datetime

    t = datetime.datetime(2025, 1, 1)
    rows = [
        (f"{s}-{i}", "noul", None, 0, w, t) for s, k,
        w in (("big", n, 1.0), ("small", n // 20, None), ("rare", n // 100, 0.5), ("other", n, 1.0)) for i in range(k)
    ]
    rows += [
        ("big-0", "noul", None, 0, -4.0, t + datetime.timedelta(days=1)), ("small-1", "x", "k", 1, 0.0, t), (None, "x", "k", 1, 1.0, t),
        ("big-7", "x", "k", 1, 25.0, None)
    ]
    return spark.createDataFrame(rows, PASS)


TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("rare", 0.1, 3), ("gone", 0.1, 9), ("null", None, None)]


def test_mixture_shares(spark):
    p, t = passes(spark, 6000), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    got = {r.source: r for r in mixture.shares(p, t).collect()}
    for s, share in (("big", 0.5), ("small", 0.3), ("rare", 0.1)):
        assert abs(got[s].actual_share - share / 0.9) < 0.012
    assert got["gone"].actual_weight == 0 and got["gone"].held_back and "other" not in got
    m = mixture.mixture(p, t)
    copies = m.groupBy("row_id", "kind", "source").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    caps = dict((a, c) for a, _, c in TARGETS)
    assert all(r.n <= caps[r.source] for r in copies)
    assert abs(m.where("source = 'small'").agg(F.sum("weight")).first()[0] - got["small"].actual_weight) < 1e-6
    # as large as all there is, scarce sources stop at their caps and are told
    full = {
        s: min(share / 0.9 * sum(g.available_weight for g in got.values()), caps[s] * got[s].available_weight) for s,
        share in (("big", 0.5), ("small", 0.3), ("rare", 0.1))
    }
    assert all(abs(got[s].full_share - w / sum(full.values())) < 1e-9 for s, w in full.items()) and got["gone"].full_held_back
    assert {s for s in full if got[s].full_held_back} == {s for s in full if full[s] == caps[s] * got[s].available_weight} != set()
    first = [tuple(r) for r in m.collect()]
    assert first == [tuple(r) for r in mixture.mixture(p.repartition(7), t).collect()]


def test_mixture_of_a_given_total(spark):
    p, t = passes(spark, 4000), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    got = {r.source: r for r in mixture.shares(p, t, total=4000.0).collect()}
    assert got["small"].held_back and abs(got["small"].actual_weight - 4 * got["small"].available_weight) < 1e-6
    assert abs(got["big"].actual_weight - 2000) < 40
    empty = mixture.mixture(p.where("false"), t)
    assert empty.count() == 0 and mixture.mixture(p, t.where("false")).count() == 0


def test_sample_only_grows(spark):
    rows = [(f"{s}-{i}",) for s in ("a", "fiscore", "zhnli") for i in range(2000)]
    small = spark.createDataFrame(rows[::2] + [(None,)] * 3, "row_id string")
    large = spark.createDataFrame(rows + rows[:50], "row_id string").repartition(9)
    take = lambda df, **k: {r.row_id for r in sampling.stable_sample(df, **k).collect()}
    a, b = take(small), take(large)
    assert a <= b and a == b & {r for (r,) in rows[::2]} and sampling.stable_sample(large).count() == len(b)
    assert abs(sum(r.startswith("fiscore") for r in b) / 2000 - 0.5) < 0.05 and abs(sum(r.startswith("a-") for r in b) / 2000 - 0.1) < 0.03
    kept = sampling.thresholds(spark, {"a": 0.5, "fiscore": 0.1})
    c = take(large, kept=kept)
    assert b <= c and len([r for r in c if r.startswith("a-")]) > 800
    assert take(large.where("false")) == set()


def test_thresholds_are_kept(spark, tmp_path):
    """A rate that is lowered later loses nobody; a raised one adds."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"a-{i}",) for i in range(3000)], "row_id string")
    take = lambda rate: {
        r.row_id for r in sampling.stable_sample(rows, sampling.kept_thresholds(spark, path, {"a": rate}), {"a": rate}).collect()
    }
    first, lower, higher = take(0.3), take(0.1), take(0.5)
    assert first == lower and first < higher and take(0.2) == higher


def test_languages_of_held_out_documents(spark, data):
    """Fitted on three quarters of the documents, right on the others as far as their labels are."""
    d = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = tokens.fit_languages(d.where("doc_id % 4 > 0"))
    rows = d.where("doc_id % 4 = 0 and lang is not null and length(text) > 40").select(
        tokens.language(F.col("lang"), F.lit(None)).alias("lang"), "text"
    ).collect()
    right = sum(model.of(r.text) == r.lang for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.9 and len(model.names) >= 10
    assert model.of(None) == model.of("") == "und" and model.of("1234 ...") == "und"
    assert tokens.fit_languages(d.where("false")).of("Привет всем") == "ru"
