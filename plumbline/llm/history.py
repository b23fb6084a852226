"""Deduplicating new batches against all history by content-defined chunks.

The words of a state are cut where a rolling hash (its window is the word just read) says so, into chunks of MEAN words on the
mean, whatever the borders of values. A changed, dropped or added word destroys two chunks at most, and where values stand in another order each
border destroys the one that lies across it, and so do the ends; so of the c chunks of a state at least c - d stand in every near-same one:
d = 2 e, with e = n/7 edits at most, and v + 1 more if it has v > 1 values. A persistent table tells which states hold a chunk (a chunk met the second time in a state
counts as another one).

The two chunks that an edit destroys are neighbours. So of chunks that are no neighbours of each other each edit destroys one at most, and another order of
values none if the first chunk of each value and the last of all are left out. A new batch looks up e + BEYOND such chunks of each state, the rarest in
the table: all but e of them are left in every near-same state. States with at most e such chunks look up the d + BEYOND rarest of all
their chunks instead, and of those the ones with at most d chunks are also kept and looked up word by word (e + BEYOND words), so short and repetitive
states lose nothing either. Where the lengths of both states are known, e is that of the longer one.

Pairs are decided by coverage: the shared bytes must be at least all but those of the d largest chunks, on both sides, which each near-same pair
keeps; an exact comparison follows. Then the chunks of the accepted records are
appended. `repeats` does the same for a whole table: it appends all batches and looks all up, and the batch
numbers decide which comes first. Taken as given: where the order of values differs, no value of the one is divided in the other.

A null or redacted state takes that of another record with the same hash, in either order of arrival;
without one, it matches by its hash alone. Null hashes, questions and batches: a record without hash and state matches
nothing, a null question equals a null question, a record without batch_no takes no part. Repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bags, wording
from .overlap import parts_of
from .store import append_to, drop, fresh, shuffles_dropped, written

RECORD = "id string, batch_no int, ok boolean, qkey long, hash string, wkey long, n int, lens binary, toks binary, sizes binary"
#: Words of a chunk on the mean, and chunks that are looked up beyond those that edits can destroy.
MEAN, BEYOND = 2, 2
#: Shares of the table from which a bucket of chunks is salted, and rows of one salt.
HOT, SALTED = 1000, 100_000
U = np.uint64


def question_key(question: dict | None) -> int:
    """Of type, instructions, levels and options, the options in any order."""
    q = question or {}
    flat = lambda x: " ".join(w for v in wording.words(x) for w in v)
    parts = [
        flat(q.get("type")), flat(q.get("instructions")), "\x1f".join(map(flat, q.get("levels") or [])),
        "\x1f".join(sorted(map(flat, q.get("options") or [])))
    ]
    return xxhash.xxh3_64_intdigest("\x1e".join(parts)) >> 1


def hash_key(value: str | None) -> str | None:
    """A hash without differences of writing: its last 64 hexadecimal digits in lower case."""
    if value is None:
        return None
    digits = "".join(c for c in value.lower() if c in "0123456789abcdef")
    return digits[-64:] if len(digits) >= 64 else value.strip().lower() or None


def is_redacted(state: str | None) -> bool:
    return state is None or "<redacted>" in state.lower() or "\\u003credacted\\u003e" in state.lower() or "&lt;redacted&gt;" in state.lower()


def _records(batches):
    memo: dict = {}
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        cols = {c: batch.column(c).to_pylist() for c in ("id", "batch_no", "ok", "question", "state", "state_sha256")}
        for rid, b, ok, q, state, sha in zip(*cols.values()):
            qs = repr(q)
            if qs not in memo:
                if len(memo) > 5000:
                    memo.clear()
                memo[qs] = question_key(q)
            said = [] if is_redacted(state) else wording.words(state)
            parts = [wording.hashes(w) for w in said]
            h = hash_key(sha)
            if not parts and h is None:
                continue
            wkey = xxhash.xxh3_64_intdigest(b"".join(sorted(xxhash.xxh3_64_digest(p.tobytes()) for p in parts))) >> 1 if parts else None
            row = (rid, b, bool(ok), memo[qs], h, wkey, sum(map(len, parts)), None, None, None)
            if parts:
                lens, toks = np.array([len(p) for p in parts], np.int32), np.concatenate([(p >> 31).astype(np.int32) for p in parts])
                row = (*row[:7], lens.tobytes(), toks.tobytes(), bytes(min(255, len(x) if x.isascii() else len(x.encode())) for w in said for x in w))
            for column, value in zip(out, row):
                column.append(value)
        types = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)], ["id", "batch_no", "ok", "qkey", "hash", "wkey", "n", "lens", "toks", "sizes"]
        )


def read_records(feedback: DataFrame) -> DataFrame:
    """Records with their question and wording as keys; those accepted (review.status confirmed) are ok."""
    rows = feedback.select(
        "id", F.col("batch_no").cast("int").alias("batch_no"), F.coalesce(F.lower(F.trim("review.status")) == "confirmed", F.lit(False)).alias("ok"),
        "question", "state", "state_sha256"
    )
    return rows.where("id is not null and batch_no is not null").mapInArrow(_records, RECORD)


POWER = U(0xD1342543DE82EF95)
#: Its inverse modulo 2^64: chunk hashes are differences of one running sum.
INVERSE = U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def most_edits(n):
    """The most words that may differ between a state of n words and a near-same one."""
    return n // 7


def destroyed(edits, values):
    """The most chunks of a state that so many edits and another order of its values can destroy."""
    return 2 * edits + np.where(values > 1, values + 1, 0)


def values_of(lens: list[bytes]) -> np.ndarray:
    return np.array([len(x) // 4 for x in lens], np.int64)


def chunks_of(space: np.ndarray, lens: list[bytes], toks: list[bytes], sizes: list[bytes]):
    """record, key, bytes and whether it is a single word, of every chunk of the states; keys differ by space and by how often a chunk was met in its state."""
    return _placed(space, lens, toks, sizes)[:4]


def _placed(space: np.ndarray, lens: list[bytes], toks: list[bytes], sizes: list[bytes]):
    """The same with the place of each chunk among all, and whether it is met the first time and no other order of values destroys it."""
    word = np.frombuffer(b"".join(toks), np.int32).astype(np.int64).astype(U)
    size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
    many = np.array([len(t) // 4 for t in toks], np.int64)
    rec = np.repeat(np.arange(len(toks)), many)
    last = np.zeros(len(word), bool)
    last[np.cumsum(many[many > 0]) - 1] = True
    with np.errstate(over="ignore"):
        roll = bags.mix(word, np.zeros(len(word), U))
        ends = (roll >> U(20)) % U(MEAN) == 0
        end = np.flatnonzero(ends | last) + 1
        begin = np.r_[0, end[:-1]] if len(end) else end
        power = np.cumprod(np.r_[U(1), np.full(len(word), INVERSE)])
        back = np.cumprod(np.r_[U(1), np.full(len(word), POWER)])
        sums = np.r_[U(0), np.cumsum((roll | U(1)) * power[: len(word)])]
        value = (sums[end] - sums[begin]) * back[begin]
    weight = np.r_[0, np.cumsum(size)]
    owner = rec[begin] if len(begin) else rec
    few = np.bincount(owner, minlength=len(toks)) <= destroyed(most_edits(many), values_of(lens))
    alone = np.flatnonzero(few[rec]) if len(rec) else rec
    found_rec, found, found_size = np.r_[owner, rec[alone]], np.r_[value, word[alone]], np.r_[weight[end] - weight[begin], size[alone]]
    single = np.r_[np.zeros(len(owner), bool), np.ones(len(alone), bool)]
    order = np.lexsort((found, single, found_rec))
    found_rec, found, found_size, single = found_rec[order], found[order], found_size[order], single[order]
    change = np.flatnonzero(
        np.r_[True, (found[1:] != found[:-1]) | (found_rec[1:] != found_rec[:-1]) | (single[1:] != single[:-1])]
    ) if len(found) else np.zeros(0, np.int64)
    times = np.arange(len(found)) - np.repeat(change, np.diff(np.r_[change, len(found)]))
    key = bags.mix(bags.mix(found, (times * 2 + single).astype(U)), space[found_rec].astype(U))
    values = np.frombuffer(b"".join(lens), np.int32).astype(np.int64)
    first = np.zeros(len(word) + 1, np.int64)  # words that begin a value, before each word
    first[(np.cumsum(values) - values)[values > 0] + 1] = 1
    first = np.cumsum(first)
    fixed = (values_of(lens)[owner] < 2) | ((first[end] == first[begin]) & ends[end - 1])
    return found_rec, key, found_size, single, order, (times == 0) & ~single & np.r_[fixed, np.zeros(len(alone), bool)][order]


def _apart(prior: np.ndarray) -> np.ndarray:
    """Of the entries with a place of their own in prior (FAR: none), one after the other, those that stand beside none taken before."""
    taken, left = np.zeros(len(prior), bool), prior.copy()
    while (left < FAR).any():
        now = (left < FAR) & (left < np.minimum(np.r_[left[1:], FAR], np.r_[FAR, left[:-1]]))
        taken |= now
        left[now | np.r_[now[1:], False] | np.r_[False, now[:-1]]] = FAR
    return taken


def _of(batch, *columns: str):
    return [batch.column(c).to_pylist() if pa.types.is_binary(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _table_rows(batches):
    """n, qkey, skey, lens, toks, sizes -> a row for each chunk."""
    for batch in bags.slices(batches, 0):
        n, q, k, lens, toks, sizes = _of(batch, "n", "qkey", "skey", "lens", "toks", "sizes")
        rec, key, size, _ = chunks_of(q, lens, toks, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64), pa.int64()), pa.array(k[rec], pa.int64()), pa.array(n[rec], pa.int32()), pa.array(size, pa.int32())],
            ["chunk", "a", "na", "bytes"]
        )


PROBES = pa.schema(
    [("chunk", pa.int64()), ("salt", pa.int32()), ("qkey", pa.int64()), ("b", pa.int64())]
    + [(c, pa.int32()) for c in ("nb", "rank", "taken", "lost")] + [("single", pa.bool_())]
)
PROBE = "chunk long, salt int, qkey long, b long, nb int, rank int, taken int, lost int, single boolean"
#: Behind every place of a chunk.
FAR = np.iinfo(np.int64).max


def _all_but_largest(group: np.ndarray, size: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """For each entry the bytes of its group (entries in order of groups) without those of the largest lost ones."""
    order = np.lexsort((-size, group))
    rank = np.arange(len(group)) - np.searchsorted(group[order], group[order], "left")
    _, place = np.unique(group, return_inverse=True)
    return np.bincount(place[order], np.where(rank < lost[order], 0, size[order]))[place].astype(np.int64) if len(group) else size


NODE = ("n", "qkey", "skey", "lens", "toks", "sizes")


def _lookups(counts: np.ndarray, salts: np.ndarray):
    """n, qkey, skey, lens, toks, sizes -> the chunks of each state to look up, once for each salt of the table: their rank (rarest first), how many are
    looked up and how many can be lost (-1: as many as edits are possible)."""

    def run(batches):
        for batch in bags.slices(batches, 0):
            n, q, b, lens, toks, sizes = _of(batch, *NODE)
            rec, key, _, single, place, fixed = _placed(q, lens, toks, sizes)
            bucket, edits = bags.bucket_of(key), most_edits(n.astype(np.int64))
            order = np.lexsort((key, counts[bucket]))
            prior = np.full(len(key) + len(n) + 1, FAR)  # with a gap between states; single words stand last and are none
            seat = np.where(single, len(prior) - 1, place + rec)
            prior[seat[order]] = np.where(fixed[order], np.arange(len(order)), FAR)
            apart = _apart(prior)[seat]
            sure = (np.bincount(rec[apart], minlength=len(n)) > edits)[rec]
            group = np.where(sure, rec * 2, rec * 2 + single)
            order = order[(apart | ~sure)[order]]
            order = order[np.argsort(group[order], kind="stable")]
            start = np.searchsorted(group[order], group[order], "left")
            rank = np.arange(len(order)) - start
            size_of = np.searchsorted(group[order], group[order], "right") - start
            r = rec[order]
            lost = np.where(sure[order] | single[order], edits[r], destroyed(edits[r], values_of(lens)[r]))
            taken = np.minimum(size_of, lost + BEYOND)
            keep = (rank < lost + BEYOND) & (counts[bucket[order]] > 0)
            order, rank, taken, lost = order[keep], rank[keep], taken[keep], np.where(sure[order], -1, lost)[keep]
            many = salts[bucket[order]]
            salt = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            order, rank, taken, lost = (np.repeat(x, many) for x in (order, rank, taken, lost))
            r = rec[order]
            columns = (key[order].view(np.int64), salt, q[r], b[r], n[r], rank, taken, lost, single[order])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, PROBES)], schema=PROBES)

    return run


def _compare(batches):
    """Decide by coverage: the shared bytes must be all but those of the chunks that n/8 edits can destroy, on both sides; then exactly."""
    for batch in batches:
        q, a, b, la, ta, za, lb, tb, zb = _of(batch, "qkey", "a", "b", "la", "ta", "za", "lb", "tb", "zb")
        near = bags.alike(ta, tb)
        none, sides = np.zeros(len(near), np.int64), []
        edits = np.array([max(len(ta[i]), len(tb[i])) // 32 for i in near.tolist()], np.int64)
        lost = destroyed(edits, np.maximum(values_of([la[i] for i in near.tolist()]), values_of([lb[i] for i in near.tolist()])))
        for lens, toks, sizes in ((la, ta, za), (lb, tb, zb)):
            rec, key, size, single = chunks_of(none, *([x[i] for i in near.tolist()] for x in (lens, toks, sizes)))
            sides.append((rec[~single], bags.mix(key[~single], rec[~single].astype(U)), size[~single]))
        for (rec, key, size), (_, other, _) in (sides, sides[::-1]):
            if len(near):
                shared = np.bincount(rec, np.where(np.isin(key, other, assume_unique=True), size, 0), minlength=len(none))
                least = np.zeros(len(none))
                least[rec] = _all_but_largest(rec, size, lost[rec])
                lost = np.where(shared >= least, lost, -1)
        keep = [i for i, ok in zip(near.tolist(), lost.tolist()) if ok >= 0 and wording.near_same(parts_of(la[i], ta[i]), parts_of(lb[i], tb[i]))]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (q, a, b)], ["qkey", "a", "b"])


TEXT = ("n", "lens", "toks", "sizes")


def _nodes(wanted: DataFrame, new: DataFrame, old: DataFrame | None) -> DataFrame:
    """The wanted states (qkey, wkey) of each question, with their wording: one shuffle of the new records, and of those old ones whose state is wanted."""
    texts = new.where("wkey is not null").select("wkey", *TEXT)
    if old is not None:
        texts = texts.unionByName(old.join(wanted.select("wkey").distinct(), "wkey", "left_semi").select("wkey", *TEXT))
    found = wanted.unionByName(texts, allowMissingColumns=True).groupBy("wkey").agg(
        F.collect_set("qkey").alias("qkeys"), *[F.first(c, True).alias(c) for c in TEXT]  # of questions, not of records
    )
    return found.select("n", F.explode("qkeys").alias("qkey"), F.col("wkey").alias("skey"), "lens", "toks", "sizes")


def _lent(takers: DataFrame, lenders: DataFrame) -> DataFrame:
    """qkey, wkey of the records without a state of their own, with that of another record with the same hash."""
    of = lenders.where("hash is not null and wkey is not null").groupBy("hash").agg(F.min("wkey").alias("wkey"))
    return takers.where("wkey is null and hash is not null").select("qkey", "hash").join(of, "hash").select("qkey", "wkey")


def _keep(path: str, records: DataFrame, old: DataFrame | None) -> None:
    """Append the chunks of those states that an accepted record has, be it by its hash alone."""
    wanted = records.where("ok and wkey is not null").select("qkey", "wkey").unionByName(_lent(records.where("ok"), records))
    if old is not None:
        wanted = wanted.unionByName(_lent(old.where("ok"), records)).unionByName(_lent(records.where("ok"), old))
    rows = _nodes(wanted, records, old).mapInArrow(_table_rows, "chunk long, a long, na int, bytes int")
    append_to(rows, f"{path}/chunks")


def _lookup(path: str, new: DataFrame, before_new: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(earlier_id, later_id) of records against the kept history: only the chunks of the new ones are looked up. A part without pairs
    met twice, also the other way round, and the rest. before_new: the kept records, if the new ones aren't among them."""
    spark = new.sparkSession
    old, kept = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/chunks")
    both = new if before_new is None else before_new.unionByName(new)
    known = both.where("hash is not null and wkey is not null").groupBy("hash").agg(F.min("wkey").alias("known"))
    keyed = lambda r: r.join(known, "hash", "left").select(
        "id", "batch_no", "ok", "qkey", F.coalesce("known", "wkey", F.xxhash64("hash")).alias("skey")
    ).distinct()
    # an id that stands once on a side and once at most on the other is in each pair once
    sides = keyed(old.where("ok")).withColumn("side", F.lit(1)).unionByName(keyed(new).withColumn("side", F.lit(2)))
    often = sides.groupBy("id").agg(*[F.expr(f"count_if(side = {k}) > 1 as {x}") for k, x in ((1, "x"), (2, "y"))]).where("x or y")
    sides = written(sides.join(often.select("id", F.lit(True).alias("often")), "id", "left"), "p2-sides")
    often = F.coalesce("often", F.lit(False))
    before = sides.where("side = 1").select("qkey", F.col("skey").alias("a"), F.col("id").alias("earlier_id"), F.col("batch_no").alias("ba"), often.alias("oa"))
    after = sides.where("side = 2").select("qkey", F.col("skey").alias("b"), F.col("id").alias("later_id"), F.col("batch_no").alias("bb"), often.alias("ob"))
    same = before.join(after.withColumnRenamed("b", "a"), ["qkey", "a"]).where("ba < bb").select("earlier_id", "later_id", F.expr("oa or ob").alias("often"))
    # how often the chunks of the table are met, in buckets: BUCKETS numbers at most
    with shuffles_dropped(spark):
        got = kept.groupBy(F.col("chunk").bitwiseAND(bags.BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("rows")).toArrow()
    counts = np.zeros(bags.BUCKETS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("rows").to_numpy()
    hot = (counts > SALTED) & (counts * HOT >= counts.sum())  # at most HOT buckets
    salts = np.where(hot, -(-counts // SALTED), 1)
    wanted = new.where("wkey is not null").select("qkey", "wkey").unionByName(_lent(new, both))
    nodes = written(_nodes(wanted, new, before_new), "p2-nodes")
    probes = nodes.mapInArrow(_lookups(counts, salts), PROBE)
    at = np.flatnonzero(hot).tolist()
    salt = F.lit(0)
    if at:
        of = F.create_map(*[F.lit(x) for b in at for x in (b, int(salts[b]))])
        salt = F.pmod(F.xxhash64("a"), F.coalesce(of[F.col("chunk").bitwiseAND(bags.BUCKETS - 1).cast("int")], F.lit(1))).cast("int")
    hits = probes.join(kept.select("chunk", "a", "na", salt.alias("salt")), ["chunk", "salt"]).where("a <> b and 8 * abs(na - nb) <= greatest(na, nb)")
    # with both lengths fewer edits are possible, so fewer chunks are needed
    hits = hits.withColumn("lost", F.expr("if(lost < 0, int(greatest(na, nb) div 8), lost)")).where(F.col("rank") < F.col("lost") + BEYOND)
    need = F.greatest(F.lit(1), F.least("taken", F.col("lost") + BEYOND) - F.col("lost"))
    met = hits.groupBy("qkey", "a", "b", (need * 2 + F.col("single").cast("int")).alias("need")).agg(F.count("*").alias("met"))
    pairs = met.where("met >= need div 2").select("qkey", "a", "b").distinct()
    # only pairs of which the accepted one may come first
    first, last = before.groupBy("qkey", "a").agg(F.min("ba").alias("first")), after.groupBy("qkey", "b").agg(F.max("bb").alias("last"))
    pairs = written(pairs.join(first, ["qkey", "a"]).join(last, ["qkey", "b"]).where("first < last").select("qkey", "a", "b"), "p2-pairs")
    texts = old.withColumn("a", F.col("wkey")).join(pairs.select("a").distinct(), "a", "left_semi").groupBy("a").agg(
        *[F.first(c).alias(f"{x}a") for c, x in (("lens", "l"), ("toks", "t"), ("sizes", "z"))]
    )
    late = nodes.select("qkey", F.col("skey").alias("b"), F.col("lens").alias("lb"), F.col("toks").alias("tb"), F.col("sizes").alias("zb"))
    near = pairs.join(texts, "a").join(late, ["qkey", "b"]).select(
        "qkey", "a", "b", "la", "ta", "za", "lb", "tb", "zb"
    ).mapInArrow(_compare, "qkey long, a long, b long")
    other = near.join(before, ["qkey", "a"]).join(after, ["qkey", "b"]).where("ba < bb").select("earlier_id", "later_id", F.expr("oa or ob").alias("often"))
    found = same.unionByName(other).where("earlier_id <> later_id")
    return found.where("not often").drop("often"), found.where("often").drop("often")


def _both(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    return parts[0].unionByName(parts[1].distinct())


def append(path: str, batch: DataFrame) -> None:
    """Add the records of a batch to the kept history, and the chunks of those accepted."""
    spark, records = batch.sparkSession, written(read_records(batch), "p2-batch")
    try:
        old = spark.read.parquet(f"{path}/records")
    except Exception as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    _keep(path, records, old)
    append_to(records, f"{path}/records")


def against(path: str, batch: DataFrame) -> DataFrame:
    """(earlier_id, later_id) of a new batch against the kept history, whose texts are read only where chunks were met."""
    new = written(read_records(batch), "p2-batch")
    old = batch.sparkSession.read.parquet(f"{path}/records")
    return _both(_lookup(path, new, old))


def _all_batches(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All batches are appended to a history of their own and looked up in it."""
    spark = feedback.sparkSession
    path = fresh(spark, "p2-history")
    append_to(read_records(feedback), f"{path}/records")
    records = spark.read.schema(RECORD).parquet(f"{path}/records")
    _keep(path, records, None)
    found = _lookup(path, records, None)
    drop(spark, f"{path}/chunks")  # the pairs of states are written
    return found


def repeats(feedback: DataFrame) -> DataFrame:
    """(earlier_id, later_id): the later record repeats, exactly or nearly, a record of an earlier batch that was accepted."""
    return _both(_all_batches(feedback))


def repeated_feedback(feedback: DataFrame) -> DataFrame:
    """The pairs with the smaller id first: id_a, id_b."""
    ids = lambda d: d.select(F.least("earlier_id", "later_id").alias("id_a"), F.greatest("earlier_id", "later_id").alias("id_b"))
    once, often = _all_batches(feedback)
    return ids(once).unionByName(ids(often).distinct())
