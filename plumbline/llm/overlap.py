"""Records that are the same or almost the same across two sides (evaluation and training), by a suffix array.

The words of all records are hashed and concatenated. A suffix stands in the order of its words; of every evaluation suffix
and of the training suffixes (each third start, or each start where values are short) AHEAD words are kept, and ranges
of that order, with bounds from a sample, are the partitions. A partition sorts its suffixes; suffixes of both sides that stand
together share a span as long as their common prefix. The spans of a pair are merged into the part of the evaluation
record that they cover (a mask of 64 segments), summed over all partitions.

How much must be covered is proved, not fitted: if at most e = n/8 words differ, the unchanged ones lie in at most e + v runs
(v - 1 being the borders of values in both records, wherever they lie), and runs too short for a start to be kept can only hold so many of them (`need`). A neighbourhood of over GROUP cross
pairs is split by the longer prefix of AHEAD words. Records in those that are still too large, or whose short spans got lost by the split, and
those with starts that very many records share (found on a sample, which only routes), may be covered less than was proved; they are also
compared by the words that no n/8 edits can take away (`bags`), and so are those whose values are too short for any start, so nothing is left out.
An exact comparison follows. Taken as given: neither record has more than one value more than the other.

Texts that are the same apart from differences of writing are one class from the start, so copies never
meet each other: `near_classes` gives pairs of classes and their members, and only the queries expand them.

Null, empty and wordless states match nothing. Repeated rows count once. An empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bags, wording
from .store import written

#: Words of a span at least, words kept of a suffix, the step of training starts, and cross pairs of a neighbourhood laid out.
FIRST, AHEAD, STEP, GROUP = 4, 8, 3, 128
#: Records of a partition of the suffix array.
RECORDS = 3000
#: A start is routed if at least HOT_SHARE of the sampled records and by estimate HOT_LEAST records have it; SAMPLE bounds the sample.
HOT_SHARE, HOT_LEAST, SAMPLE = 1 / 500, 20_000, 20_000
#: Sampled records for the bounds of the partitions (at least, and for each partition), and starts of each.
BOUND_RECORDS, PER_PARTITION, BOUND_STARTS = 4000, 2, 64
NORMAL = "id string, ev boolean, cls long, n int, lens binary, toks binary"
U = np.uint64


def normalise(batches):
    """id, ev, text -> hashed words per value; the class is that of the multiset of values."""
    memo: dict = {}
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for rid, ev, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            got = memo.get(text)
            if got is None:
                parts = [wording.hashes(w) for w in wording.words(text)]
                if parts:
                    short = [(p >> 31).astype(np.int32) for p in parts]
                    cls = xxhash.xxh3_64_intdigest(b"".join(sorted(xxhash.xxh3_64_digest(p.tobytes()) for p in parts))) >> 1
                    got = (cls, sum(map(len, parts)), np.array([len(p) for p in parts], np.int32).tobytes(), np.concatenate(short).tobytes())
                else:
                    got = ()
                if len(memo) > 2000:
                    memo.clear()
                memo[text] = got
            if got:
                for column, value in zip(out, (rid, ev, *got)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
            ["id", "ev", "cls", "n", "lens", "toks"]
        )


def parts_of(lens: bytes, toks: bytes) -> list[np.ndarray]:
    t, out, at = np.frombuffer(toks, np.int32), [], 0
    for n in np.frombuffer(lens, np.int32).tolist():
        out.append(t[at : at + n])
        at += n
    return out


class Flat:
    """The values of many records one after another, with room between them, and the starts of their suffixes."""

    def __init__(self, cls, ns, lens, toks, room: int = FIRST):
        pieces, rec, size, pad = [], [], [], np.zeros(room, np.int32)
        for i, (l, t) in enumerate(zip(lens, toks)):
            for p in parts_of(l, t):
                pieces += (p, pad)
                rec.append(i)
                size.append(len(p))
        self.flat = np.concatenate(pieces) if pieces else np.zeros(room, np.int32)
        size = np.array(size, np.int64)
        begin = np.concatenate(([0], np.cumsum(size + room)))[: len(size)]
        rec_of = np.array(rec, np.int64)
        self.base, self.first_value = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        self.base[rec_of[::-1]], self.first_value[rec_of[::-1]] = begin[::-1], np.arange(len(size))[::-1]  # of a record's first value
        fits = np.maximum(size - FIRST + 1, 0)
        self.value = np.repeat(np.arange(len(size)), fits)
        self.offset = np.arange(len(self.value)) - np.repeat(np.cumsum(fits) - fits, fits)
        self.at = np.repeat(begin, fits) + self.offset
        self.left = np.repeat(size, fits) - self.offset
        self.rec = np.repeat(np.array(rec, np.int64), fits)
        self.cls, self.ns = np.array(cls, np.int64), np.array(ns, np.int32)
        self.values = np.bincount(rec_of, minlength=len(cls)).astype(np.int64)
        word = (self.flat.view(np.uint32) >> np.uint32(16)).astype(U)  # 16 bits a word: the order is that of the words
        self.key, self.next = np.zeros(len(self.at), U), np.zeros(len(self.at), U)
        for k in range(FIRST):
            self.key = (self.key << U(16)) | word[self.at + k]
            self.next = (self.next << U(16)) | word[self.at + FIRST + k]


def need(n, v, dense):
    """The words that must be covered in a pair whose longer text has n words, with v - 1 borders of values in both: what is left when runs too short to have a start are full.

    dense: each start of the training text is kept, else each third. Works on numbers, arrays and columns."""
    e = n // 8 if not hasattr(n, "isNull") else F.floor(n / 8)
    return n - 4 * e - 3 * (v - 1) if dense else n - 6 * e - 5 * (v - 1) - 2


def least_need(n: np.ndarray, v: np.ndarray, dense: bool) -> np.ndarray:
    """The need in the worst pair that a text of n words can have: with one as long, or with the next length at which one more word may differ."""
    longer = 8 * (n // 8 + 1)
    reached = longer - n <= longer // 8
    return np.minimum(need(n, v, dense), np.where(reached, need(longer, v, dense), need(n, v, dense)))


ENTRY = np.dtype([("key", U), ("next", U), ("cls", np.int64), ("n", np.int32), ("pos", np.int32), ("v", np.int16), ("side", np.uint8), ("dense", np.uint8)])


def slices(batches, words: int = 400_000):
    """The batches in parts of about so many words (column n), so that long records take no more memory than short ones."""
    for batch in batches:
        at = np.cumsum(batch.column(1).to_numpy(zero_copy_only=False)) // words
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def _dense(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether each start of a training text is kept: sampled ones wouldn't be sure to cover FIRST words."""
    return least_need(n, 2 * v, False) < FIRST


def _suffixes(bounds: np.ndarray, hot: np.ndarray):
    """cls, n, lens, toks, ev, tr -> (part, entries): one blob a range of the suffix order and batch, without the starts routed apart."""

    def run(batches):
        for batch in slices(batches):
            cls, ns, lens, toks, ev, tr = (batch.column(i).to_pylist() for i in range(6))
            f = Flat(cls, ns, lens, toks)
            ev, tr = np.array(ev, bool), np.array(tr, bool)
            place, dense = _place(f), _dense(f.ns.astype(np.int64), f.values)
            blobs = []
            for side, has in ((1, ev), (0, tr)):
                keep = has[f.rec]
                if not side:
                    keep &= dense[f.rec] | (f.offset % STEP == 0)
                if len(hot):
                    keep &= ~np.isin(f.key, hot)
                pick = np.flatnonzero(keep)
                e, r = np.zeros(len(pick), ENTRY), f.rec[pick]
                e["key"], e["next"], e["cls"], e["n"], e["pos"], e["side"] = f.key[pick], f.next[pick], f.cls[r], f.ns[r], place[pick], side
                e["v"], e["dense"] = np.minimum(f.values[r], 32_767), dense[r]
                blobs.append(e)
            e = np.concatenate(blobs)
            to = np.searchsorted(bounds, e["key"], "right")
            order = np.argsort(to, kind="stable")
            e, to = e[order], to[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(to)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cuts], pa.int32()), pa.array([e[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["part", "entries"]
            )

    return run


def mask_of(pos: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The segments (64 of a text, or one a word) that a span touches, as bits."""
    wide = np.maximum(n, 64).astype(np.int64)
    lo = pos.astype(np.int64) * 64 // wide
    hi = (np.minimum(pos + length, n).astype(np.int64) - 1) * 64 // wide
    return (U(0xFFFFFFFFFFFFFFFF) >> (63 - (hi - lo)).astype(U)) << lo.astype(U)


def _merged(keys: list[np.ndarray], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different key, and its masks as one."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, masks
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(change)
    return order[first], np.bitwise_or.reduceat(masks[order], first)


def _routed(hot: np.ndarray):
    """cls, n, lens, toks, ev, tr -> the classes, by side, with starts that are routed apart."""

    def run(batches):
        for batch in slices(batches):
            cls, ns, lens, toks, ev, tr = (batch.column(i).to_pylist() for i in range(6))
            f = Flat(cls, ns, lens, toks)
            sides = [(cls[i], s) for i in np.unique(f.rec[np.isin(f.key, hot)]).tolist() for s, has in ((True, ev), (False, tr)) if has[i]]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sides], pa.int64()), pa.array([s for _, s in sides], pa.bool_())], ["hot_cls", "hot_ev"])

    return run


def _place(f: Flat) -> np.ndarray:
    """The place of each start among the words of its record."""
    if not len(f.at):
        return np.zeros(0, np.int32)
    origin, first_value = f.base[f.rec], f.first_value[f.rec]
    return (f.at - f.offset - origin - FIRST * (f.value - first_value) + f.offset).astype(np.int32)


def _all_of(first, ev, tr, live):
    """Every cross pair of groups in which training entries stand before evaluation entries."""
    e_at = np.repeat(first + tr, ev) + np.arange(ev.sum()) - np.repeat(np.cumsum(ev) - ev, ev)
    t_n, t_first = np.repeat(tr, ev), np.repeat(first, ev)
    t_at = np.repeat(t_first, t_n) + np.arange(t_n.sum()) - np.repeat(np.cumsum(t_n) - t_n, t_n)
    return live[np.repeat(e_at, t_n)], live[t_at]


def shared_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How long the common prefix of suffixes with the same FIRST words is, of AHEAD words kept."""
    x = a ^ b
    return FIRST + sum(((x >> U(16 * k)) == 0).astype(np.int32) for k in range(FIRST))


def _groups(keys: list[np.ndarray], side: np.ndarray, among: np.ndarray):
    """Entries by equal keys, training entries first: their order, and of each group the first place and the numbers of either side."""
    order = among[np.lexsort((side[among], *[k[among] for k in keys[::-1]]))]
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(change)
    size = np.diff(np.r_[first, len(order)])
    ev = np.add.reduceat(side[order].astype(np.int64), first) if len(first) else size
    return order, first, ev, size - ev


def cross_pairs(e: np.ndarray):
    """Places of pairs of entries with a common prefix, and of the entries whose neighbourhood is too large to be laid out by its first words."""
    cls, n, side, key, nxt = (np.ascontiguousarray(e[c]) for c in ("cls", "n", "side", "key", "next"))
    out_a, out_b, big, among = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None, np.arange(len(e))
    for keys in ([key], [key, nxt]):  # the longer prefix splits what is too large
        order, first, ev, tr = _groups(keys, side, among)
        pairs = ev * tr
        small = (pairs > 0) & (pairs <= GROUP)
        for lo in range(0, len(first), 4096):
            g = np.flatnonzero(small[lo : lo + 4096]) + lo
            if len(g):
                a, b = _all_of(first[g], ev[g], tr[g], order)
                close = (8 * np.abs(n[a] - n[b]) <= np.maximum(n[a], n[b])) & (cls[a] != cls[b])
                out_a.append(a[close])
                out_b.append(b[close])
        among = order[np.repeat(pairs > GROUP, ev + tr)]
        big = among if big is None else big
    return np.concatenate(out_a), np.concatenate(out_b), big


FOUND = "a long, b long, na int, nb int, va int, vb int, dense int, mask long, hot_cls long, hot_ev boolean"


def _partition(table: pa.Table) -> pa.Table:
    """The pairs of a range of the suffix order with what their spans cover of the first; then the classes in too large neighbourhoods."""
    e = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
    e = e[np.lexsort((e["next"], e["key"]))]
    a, b, big = cross_pairs(e)
    at, mask = _merged([e["cls"][a], e["cls"][b]], mask_of(e["pos"][a], shared_words(e["next"][a], e["next"][b]), e["n"][a])) if len(a) else (a, np.zeros(0, U))
    a, b = a[at], b[at]
    hot = np.unique(e[["cls", "side"]][big])
    m, h = len(a), len(hot)
    both = lambda x, y, t: pa.concat_arrays(
        [pa.array(x, t) if x is not None else pa.nulls(m, t), pa.array(y, t) if y is not None else pa.nulls(h, t)]
    )
    return pa.table(
        {
            "a": both(e["cls"][a], None, pa.int64()), "b": both(e["cls"][b], None, pa.int64()), "na": both(e["n"][a], None, pa.int32()), "nb": both(e["n"][b], None, pa.int32()),
            "va": both(e["v"][a].astype(np.int32), None, pa.int32()), "vb": both(e["v"][b].astype(np.int32), None, pa.int32()), "dense": both(
                e["dense"][b].astype(np.int32), None, pa.int32()
            ),
            "mask": both(
                mask.view(np.int64), None, pa.int64()
            ), "hot_cls": both(None, hot["cls"], pa.int64()), "hot_ev": both(None, hot["side"] == 1, pa.bool_()),
        }
    )


def _compare(batches):
    """The near-same ones; most candidates are told apart by their words alone, all at once."""
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("a", "b", "la", "ta", "lb", "tb")}
        keep = [
            i for i in bags.alike(cols["ta"], cols["tb"]).tolist() if wording.near_same(
                parts_of(cols["la"][i], cols["ta"][i]), parts_of(cols["lb"][i], cols["tb"][i])
            )
        ]
        yield pa.RecordBatch.from_arrays([pa.array([cols[c][i] for i in keep], pa.int64()) for c in ("a", "b")], ["a", "b"])


def _hot_starts(classes: DataFrame, count: int) -> np.ndarray:
    """Starts of FIRST words that so many records (one of each class) have that they are routed apart.

    Measured on about SAMPLE records; at most 1/HOT_SHARE times the mean number of words each. They route and drop nothing:
    all records with such a start go to the same exact way.
    """
    if count < HOT_LEAST:
        return np.zeros(0, U)
    sample = classes.sample(min(1.0, SAMPLE / max(count, 1)), seed=7) if count > SAMPLE else classes

    def starts(batches):
        for batch in slices(batches):
            f = Flat(*(batch.column(i).to_pylist() for i in range(4)))
            pairs = np.unique(np.stack([f.key.view(np.int64), f.rec], 1), axis=0)
            x, c = np.unique(pairs[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[c > 1], pa.int64()), pa.array(c[c > 1], pa.int64())], ["key", "n"])

    least = min(count, SAMPLE) * max(HOT_SHARE, HOT_LEAST / count)
    rows = sample.select("cls", "n", "lens", "toks").mapInArrow(starts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    return np.array([r.key for r in rows], np.int64).view(U)


def _bounds(classes: DataFrame, count: int, parts: int) -> np.ndarray:
    """Bounds of the ranges of the suffix order, from at most BOUND_STARTS starts of each of a bounded number of records."""
    wanted = max(BOUND_RECORDS, PER_PARTITION * parts)
    sample = classes.sample(min(1.0, wanted / max(count, 1)), seed=9) if count > wanted else classes

    def starts(batches):
        for batch in slices(batches):
            f = Flat(*(batch.column(i).to_pylist() for i in range(4)))
            many = np.bincount(f.rec, minlength=batch.num_rows)
            rank = np.arange(len(f.rec)) - np.repeat(np.cumsum(many) - many, many)
            keep = rank % np.maximum(1, -(-many[f.rec] // BOUND_STARTS)) == 0
            yield pa.RecordBatch.from_arrays([pa.array(f.key[keep].view(np.int64), pa.int64())], ["key"])

    got = sample.select("cls", "n", "lens", "toks").mapInArrow(starts, "key long").toArrow()
    keys = np.sort(got.column("key").to_numpy().view(U))
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys


def _spans(classes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with what is covered, and the classes, by side, in neighbourhoods too large or with routed starts."""
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RECORDS))
    hot = _hot_starts(classes, count)
    entries = classes.mapInArrow(_suffixes(_bounds(classes, count, parts), hot), "part int, entries binary")
    # the number of partitions is stated, so that they are not put together to larger ones
    found = written(entries.repartition(parts, "part").groupBy("part").applyInArrow(_partition, FOUND), "p6-spans")
    crowded = found.where("hot_cls is not null").select("hot_cls", "hot_ev")
    if len(hot):
        crowded = crowded.unionByName(classes.mapInArrow(_routed(hot), "hot_cls long, hot_ev boolean"))
    spans = found.where("a is not null").groupBy("a", "b").agg(F.bit_or("mask").alias("mask"), *[F.max(c).alias(c) for c in ("na", "nb", "va", "vb", "dense")])
    return spans, crowded.groupBy(F.col("hot_cls").alias("cls")).agg(F.bool_or("hot_ev").alias("in_ev"), F.bool_or(~F.col("hot_ev")).alias("in_tr"))


def _worst(n, v, dense: bool):
    """least_need as a column."""
    longer = 8 * (F.floor(n / 8) + 1)
    return F.least(need(n, v, dense), F.when(longer - n <= F.floor(longer / 8), need(longer, v, dense)).otherwise(need(n, v, dense)))


def candidates_of(classes: DataFrame, count: int) -> DataFrame:
    """a, b: every pair of an evaluation and a training class that may be near-same."""
    spans, crowded = _spans(classes, count)
    n, v = F.greatest("na", "nb"), F.col("va") + F.col("vb") - 1
    wanted = F.when(F.col("dense") == 1, need(n, v, True)).otherwise(need(n, v, False))
    by_spans = spans.where(F.bit_count("mask") * F.greatest("na", F.lit(64)) / 64 >= F.greatest(F.lit(FIRST), wanted)).select("a", "b")
    # the rest: too short values, and the records of neighbourhoods too large, evaluation ones with training ones
    n, v = F.col("n"), F.octet_length("lens") / 2
    thin = _worst(n, v, True) < FIRST + 5 + F.floor(n / 8)
    both = classes.join(crowded, "cls", "left")
    also = lambda c, side: F.col(c) & (thin | F.coalesce(side, F.lit(False)))
    rest = both.select("cls", "n", also("ev", F.col("in_ev")).alias("ev"), also("tr", F.col("in_tr")).alias("tr"), F.lit(0).cast("long").alias("space"), "toks")
    rest = written(rest.where("ev or tr"), "p6-rest")
    if rest.agg(F.bool_or("ev")).first()[0]:
        by_spans = by_spans.unionByName(bags.possible_pairs(rest).select("a", "b"))
    return by_spans.distinct()


def near_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (cls, id, ev) and pairs (a, b) of near-same classes, a with evaluation and b with training members; records: id, ev (boolean), text.

    Records of one class have the same text; a class with members of both sides is no pair with itself."""
    kept = records.select(
        F.col("id").cast("string"), F.col("ev").cast("boolean"), F.col("text").cast("string")
    ).where("text is not null and ev is not null and id is not null")
    normal = written(kept.mapInArrow(normalise, NORMAL), "p6-words")
    classes = normal.groupBy("cls").agg(
        F.first("n").alias("n"), F.first("lens").alias("lens"), F.first("toks").alias("toks"), F.max("ev").alias("ev"), (~F.min("ev")).alias("tr")
    )
    classes = written(classes, "p6-classes")
    candidates = written(candidates_of(classes, classes.count()), "p6-candidates")
    wanted = candidates.select(F.col("a").alias("cls")).union(candidates.select(F.col("b").alias("cls"))).distinct()
    words = written(classes.join(wanted, "cls", "left_semi").select("cls", F.col("lens").alias("l"), F.col("toks").alias("t")), "p6-compared")
    side = lambda x: words.select(F.col("cls").alias(x), F.col("l").alias(f"l{x}"), F.col("t").alias(f"t{x}"))
    near = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "ta", "lb", "tb").mapInArrow(_compare, "a long, b long")
    return normal.select("cls", "id", "ev").distinct(), near


def near_same_across(records: DataFrame) -> DataFrame:
    """Pairs (ev_id, tr_id) of the same or near-same text, expanded from near_classes."""
    members, near = near_classes(records)
    ev = members.where("ev").select(F.col("cls").alias("a"), F.col("id").alias("ev_id"))
    tr = members.where("not ev").select(F.col("cls").alias("b"), F.col("id").alias("tr_id"))
    same = ev.join(tr, ev["a"] == tr["b"]).select("ev_id", "tr_id")
    other = near.join(ev, "a").join(tr, "b").select("ev_id", "tr_id")
    return same.unionByName(other).distinct()


def states_of(rows: DataFrame, passes: DataFrame) -> DataFrame:
    """row_id, split, source, text: every distinct delivered state; of rows without one, their passes' text before the question."""
    rows = rows.select("row_id", "split", "source", "state")
    have = rows.where("state is not null").select("row_id", "split", "source", F.col("state").alias("text"))
    lack = written(rows.where("state is null").select("row_id", "split", "source").distinct(), "p6-without")
    mark = F.concat(F.lit("\n\n["), F.coalesce("qtype", F.lit("")), F.lit("] "))
    before = F.expr("left(text, length(text) - length(substring_index(text, mark, -1)) - length(mark))")
    asked = passes.select("row_id", "qtype", "text").join(lack, "row_id").withColumn("mark", mark)
    asked = asked.select("row_id", "split", "source", F.when(F.col("text").contains(F.col("mark")), before).otherwise(F.col("text")).alias("text"))
    return have.unionByName(asked.where("text is not null").distinct())


def split_overlaps(rows: DataFrame, passes: DataFrame) -> DataFrame:
    """Pairs of one row with split val or gate and one with split train whose states are the same or near-same: row_id_a < row_id_b."""
    side = F.when(F.col("split").isin("val", "gate"), True).when(F.col("split") == "train", False)
    pairs = near_same_across(states_of(rows, passes).select(F.col("row_id").alias("id"), side.alias("ev"), "text"))
    pairs = pairs.where("ev_id <> tr_id")
    return pairs.select(F.least("ev_id", "tr_id").alias("row_id_a"), F.greatest("ev_id", "tr_id").alias("row_id_b")).distinct()
