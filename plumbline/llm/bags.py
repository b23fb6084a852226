"""Pairs of wordings that may be near-same, by words that no n/8 edits can take away; nothing near-same is left out.

A wording is the bag of its words; the second time a word stands in it is another entry than the first. Of two
near-same wordings of at most n words at most n/8 entries of either stand without a partner in the other, whatever
the order of the values. So if the entries of each are put in one order that holds for all, the first n/8 + 1 of the one
and of the other share an entry. The order is that of frequency (counted in BUCKETS buckets, rarest first), so boilerplate
stands last and is seldom a key; any order would do, so counts only change the cost.

Under each key all pairs are compared, first by length, then by a bound: the counts of words in BINS bins, modulo 8, differ
by at least a cyclic distance that two wordings within e edits keep under 2 e. Both drop only what can't be near-same.
Keys with over BLOCK cross pairs are laid out in blocks, each with a part of either side, so size only changes the number of tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, BINS, BLOCK = 1 << 18, 128, 4_000_000
#: Entries and cross pairs of a task, about.
ENTRIES, PAIRS = 150_000, 20_000_000
U = np.uint64
#: Twisted ring codes of 0 to 7: the bits in which two differ are their distance modulo 8.
RING = np.array([0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000], np.uint8)
ENTRY = np.dtype([("key", U), ("cls", np.int64), ("n", np.int32), ("side", np.uint8), ("marks", U, BINS // 16)])


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b + U(0x9E3779B97F4A7C15))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def slices(batches, column: int, words: int = 400_000):
    """The batches in parts of about so many words (their number is in a column)."""
    for batch in batches:
        at = np.cumsum(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)) // words
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def entries_of(space: np.ndarray, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The record and the key of each word, and the hash of the word alone; the k-th time a word stands in a record it has its own key."""
    size = np.array([len(t) // 4 for t in toks], np.int64)
    rec = np.repeat(np.arange(len(toks)), size)
    word = np.frombuffer(b"".join(toks), np.int32).astype(np.int64).astype(U)
    order = np.lexsort((word, rec))
    word = word[order]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (rec[1:] != rec[:-1])]) if len(word) else np.zeros(0, np.int64)
    times = np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))
    return rec, mix(mix(word, times.astype(U)), space[rec].astype(U)), word


def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Places of the pairs of wordings that share all but n/8 of their words, in any order: others can't be near-same."""
    none = np.zeros(len(a), np.int64)
    (ra, ka, _), (rb, kb, _) = entries_of(none, a), entries_of(none, b)
    shared = np.bincount(ra[np.isin(mix(ka, ra.astype(U)), mix(kb, rb.astype(U)), assume_unique=True)], minlength=len(a))
    most = np.maximum(np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(a)))
    return np.flatnonzero((most - shared <= most // 8) & (most > 0))


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key & U(BUCKETS - 1)).astype(np.int64)


def marks_of(records: int, rec: np.ndarray, word: np.ndarray) -> np.ndarray:
    bin_of = (mix(word, np.full(len(word), U(0x5851F42D4C957F2D))) % U(BINS)).astype(np.int64)
    code = RING[np.bincount(rec * BINS + bin_of, minlength=records * BINS).reshape(records, BINS) & 7]
    return np.ascontiguousarray(code[:, 0::2] | (code[:, 1::2] << 4)).view(U)


def leading(counts: np.ndarray, space: np.ndarray, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record and key of the first n/8 + 1 entries of each record, and the marks of the records."""
    rec, key, word = entries_of(space, toks)
    marks = marks_of(len(toks), rec, word)
    order = np.lexsort((key, counts[bucket_of(key)], rec))
    size = np.bincount(rec, minlength=len(toks))
    rank = np.arange(len(rec)) - np.repeat(np.cumsum(size) - size, size)
    keep = rank <= np.repeat(size // 8, size)
    return rec[keep], key[order][keep], marks


def _sums(arrays: list[np.ndarray], names: list[str]):
    at = np.flatnonzero(sum(arrays))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(a[at], pa.int64()) for a in arrays)], ["bucket", *names])


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, 1):
        _, key, _ = entries_of(batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_pylist())
        total += np.bincount(bucket_of(key), minlength=BUCKETS)
    yield _sums([total], ["words"])


def _count_leading(counts: np.ndarray):
    def run(batches):
        sides = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        for batch in slices(batches, 1):
            rec, key, _ = leading(counts, batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_pylist())
            for total, c in zip(sides, (2, 3)):
                has = np.array(batch.column(c).to_pylist(), bool)
                total += np.bincount(bucket_of(key[has[rec]]), minlength=BUCKETS)
        yield _sums(sides, ["ev", "tr"])

    return run


def _by_bucket(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Sums per bucket at the driver: BUCKETS numbers each at most."""
    got = df.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = [np.zeros(BUCKETS, np.int64) for _ in names]
    for a, c in zip(out, names):
        a[got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    return out


def blocks(ev: np.ndarray, tr: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many parts either side of a bucket is laid out, so that a block has about most cross pairs."""
    many = np.maximum(1, np.ceil(ev * tr / most))
    p = np.clip(np.round(np.sqrt(many * ev / np.maximum(tr, 1))), 1, np.maximum(ev, 1))
    p = np.minimum(p, many).astype(np.int64)
    return p, np.clip(np.ceil(many / p), 1, np.maximum(tr, 1)).astype(np.int64)


def _entries(parts: int, counts: np.ndarray, both: np.ndarray, p: np.ndarray, q: np.ndarray):
    """cls, n, ev, tr, space, toks -> (part, entries), one blob a part and batch; keys of buckets that one side alone has are left out."""

    def run(batches):
        for batch in slices(batches, 1):
            cls, ns, ev, tr, space = (np.array(batch.column(i).to_pylist()) for i in range(5))
            rec, key, marks = leading(counts, space, batch.column(5).to_pylist())
            keep = both[bucket_of(key)]
            rec, key = rec[keep], key[keep]
            found, to = [], []
            for side, has in ((1, ev), (0, tr)):
                pick = np.flatnonzero(has.astype(bool)[rec])
                b = bucket_of(key[pick])
                own, other = (p[b], q[b]) if side else (q[b], p[b])
                mine = (mix(cls[rec[pick]].astype(U), np.full(len(pick), U(7))) % own.astype(U)).astype(np.int64)
                each = np.arange(other.sum()) - np.repeat(np.cumsum(other) - other, other)
                pick, b, mine = np.repeat(pick, other), np.repeat(b, other), np.repeat(mine, other)
                block = (mine * q[b] + each if side else each * q[b] + mine).astype(U)
                e = np.zeros(len(pick), ENTRY)
                r = rec[pick]
                e["key"], e["cls"], e["n"], e["side"], e["marks"] = mix(key[pick], block), cls[r], ns[r], side, marks[r]
                found.append(e)
                to.append((mix(b.astype(U), block) % U(parts)).astype(np.int64))
            e, to = np.concatenate(found), np.concatenate(to)
            order = np.argsort(to, kind="stable")
            e, to = e[order], to[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(to)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cuts], pa.int32()), pa.array([e[x:y].tobytes() for x, y in zip(cuts, ends)], pa.binary())], ["part", "entries"]
            )

    return run


def close(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of entries (places a, b) the lengths and the counts of words leave as possibly near-same."""
    na, nb = e["n"][a].astype(np.int32), e["n"][b].astype(np.int32)
    most = np.maximum(na, nb) // 8
    at = np.flatnonzero((np.abs(na - nb) <= most) & (e["cls"][a] != e["cls"][b]))
    room = (2 * most - np.abs(na - nb))[at]
    apart = np.zeros(len(at), np.int32)
    for k in range(BINS // 16):
        apart += np.bitwise_count(e["marks"][a[at], k] ^ e["marks"][b[at], k])
        stay = apart <= room
        at, room, apart = at[stay], room[stay], apart[stay]
    return at


def _compare(table: pa.Table) -> pa.Table:
    e = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()])
    e = e[np.lexsort((e["side"], e["key"]))]
    first = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]]) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(e)])
    ev = np.add.reduceat(e["side"].astype(np.int64), first) if len(e) else size
    tr = size - ev
    # a row for each evaluation entry: its place, the first training entry of its key, and their number
    at = np.repeat(first + tr, ev) + np.arange(ev.sum()) - np.repeat(np.cumsum(ev) - ev, ev)
    begin, many = np.repeat(first, ev), np.repeat(tr, ev)
    at, begin, many = at[many > 0], begin[many > 0], many[many > 0]
    found, held = [np.zeros((0, 4), np.int64)], 0
    ends = np.cumsum(many)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
        m = many[lo:hi]
        a = np.repeat(at[lo:hi], m)
        b = np.repeat(begin[lo:hi], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        keep = close(e, a, b)
        a, b = e[a[keep]], e[b[keep]]
        found.append(np.stack([a["cls"], b["cls"], a["n"].astype(np.int64), b["n"].astype(np.int64)], 1))
        held += len(a)
        if held > 2_000_000:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
        lo = hi
    pairs = np.unique(np.concatenate(found), axis=0)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.table([pa.array(pairs[:, i], t) for i, t in enumerate(types)], ["a", "b", "na", "nb"])


def possible_pairs(records: DataFrame) -> DataFrame:
    """a, b, na, nb: every pair of a record a with ev and a record b with tr, of one space and other cls, that may be near-same.

    records: cls long (one row each), n int, ev boolean, tr boolean, space long, toks binary (int32 hashes of the n words).
    They are read three times, so they should be a written table.
    """
    spark = records.sparkSession
    records = records.select("cls", "n", "ev", "tr", "space", "toks").where("n > 0")
    (counts,) = _by_bucket(records.mapInArrow(_count, "bucket int, words long"), ["words"])
    ev, tr = _by_bucket(records.mapInArrow(_count_leading(counts), "bucket int, ev long, tr long"), ["ev", "tr"])
    both = (ev > 0) & (tr > 0)
    ev, tr = np.where(both, ev, 0), np.where(both, tr, 0)
    p, q = blocks(ev, tr, BLOCK)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(float(ev @ q + tr @ p) / ENTRIES), math.ceil(float(ev @ tr) / PAIRS))
    laid = records.mapInArrow(_entries(parts, counts, both, p, q), "part int, entries binary")
    return laid.groupBy("part").applyInArrow(_compare, "a long, b long, na int, nb int").distinct()
