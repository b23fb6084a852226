"""Evaluation texts leaking into training text: a distributed positional inverted index.

The index is stored and serves any number of item sets: each different training text is cut once into terms (the two
words from a place on, in scripts without spaces three characters), and the postings (term, text, place) lie in runs sorted by term, written
where the texts were read: nothing is shuffled, and no frequent term is ever gathered. A look into the index is a binary search in each run. A run
is cut into short rows, so what is held at once depends on no table's size.

The test items are few and fixed; their size is checked. One look into the index counts the postings of all their terms. Of every window that
must be found (RUN words, RUN_UNSPACED characters) the three rarest terms are anchors, and of every item as many of its
rarest terms that up to four are left when one word in SHARE is changed; with an item so short that no term would be left every text is compared.
A second look fetches the postings of the anchors; they are intersected after subtracting the place in the item: three anchors of
windows on one offset, or those left of an item within a band of offsets, make a text a candidate. Candidates are read again and compared exactly:
a run of words outside stock sentences, or the whole wording with at most one word in SHARE changed.

Nulls and empty texts carry nothing; an item with fewer words than a run outside stock counts only as a
whole. Repeated rows and passes count once; no items or no training rows give no result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentences, wording
from .store import setting, written

RUN, RUN_UNSPACED, SHARE, STOCK = 16, 30, 8, 10
#: Test items are held by every worker; more bytes of text than this are refused.
MOST_BYTES = 256 << 20
#: Postings of a run, and of one row of it (20 bytes each); bytes of what a worker, a writer or a reader of the index holds at once, about: rows
#: are taken by the batch, whatever their size, and a file of the index has as many runs as its task had text.
POSTINGS, PIECE, AT_ONCE = 200_000, 8192, 8 << 20


def _unspaced(word: str) -> bool:
    return len(word) == 1 and word > "⺀"


def units(text: str | None) -> tuple[list[tuple[list[str], bool]], list[list[str]]]:
    """The words of each value, by characters where a value is mostly of a script without spaces; then the stretches of characters within the others."""
    out, inside = [], []
    for w in wording.words(text):
        mostly = 2 * sum(map(_unspaced, w)) >= len(w)
        out.append(([c for x in w for c in x] if mostly else w, mostly))
        if not mostly:
            inside += _stretches_of(w)
    return out, inside


def _stretches_of(words: list[str]) -> list[list[str]]:
    """The runs of at least three characters of scripts without spaces."""
    found, run = [], []
    for x in [*words, ""]:
        if _unspaced(x):
            run.append(x)
        else:
            if len(run) >= 3:
                found.append(run)
            run = []
    return found


def _terms(h: np.ndarray, unspaced: bool) -> np.ndarray:
    return wording.window_hashes(h, 3 if unspaced else 2)


class Item:
    """One test item: hashed words, the stretches outside stock, and its windows. within: stretches of characters inside values of words."""

    def __init__(self, parts: list[tuple[np.ndarray, bool, np.ndarray]], within: list[np.ndarray]):
        self.whole = np.concatenate([h for h, _, _ in parts])
        self.runs: set[int] = set()
        self.free, self.all = [], []  # (place in the item, hashes, by characters) of each stretch without stock, and of each value
        at = 0
        for h, unspaced, stock in parts:
            edges = np.flatnonzero(np.diff(np.r_[1, stock.astype(np.int8), 1]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                self.free.append((at + a, h[a:b], unspaced))
            self.all.append((at, h, unspaced))
            at += len(h)
        for h in within:  # behind the item's end, where no whole wording is looked for
            self.free.append((at, h, True))
            at += len(h)
        for _, h, unspaced in self.free:
            self.runs.update(wording.window_hashes(h, RUN_UNSPACED if unspaced else RUN).tolist())

    def terms(self) -> list[tuple[int, int]]:
        """(place, term) of all values."""
        return [(at + i, x) for at, h, u in self.all for i, x in enumerate(_terms(h, u).tolist())]

    def spoiled(self) -> int:
        """The terms that changing one word in SHARE, and a border of values for each value, can take away."""
        wide = 3 if any(u for _, _, u in self.all) else 2
        return len(self.whole) // SHARE * wide + (wide - 1) * len(self.all)

    def short(self) -> bool:
        """Whether no term would be sure to be left, so that every text is compared with it."""
        return sum(max(0, len(h) - (2 if u else 1)) for _, h, u in self.all) <= self.spoiled()


def read_items(items: DataFrame) -> dict[str, Item]:
    """The items by id, on the driver: they are a fixed set whose size is checked first."""
    if (items.agg(F.sum(F.octet_length("state_str")).alias("n")).first().n or 0) > MOST_BYTES:
        raise ValueError("the test items are too large to be held by every worker; give them in several calls")
    rows = items.where("item_id is not null and state_str is not null").select("item_id", "state_str").distinct().collect()
    found: dict[str, list] = {}
    within: dict[str, list] = defaultdict(list)
    seen: dict[tuple, set] = defaultdict(set)
    for r in rows:
        values = []
        for v in wording.values(r.state_str):
            cut = [wording.TOKEN.findall(wording.plain(v[a:b])) for a, b in sentences.split(v)]
            cut = [c for c in cut if c]
            if cut:
                n = sum(map(len, cut))
                unspaced = 2 * sum(_unspaced(x) for c in cut for x in c) >= n
                values.append(([[ch for x in c for ch in x] if unspaced else c for c in cut], unspaced))
                for c in cut:
                    seen[tuple("".join(c))].add(r.item_id)
        if values:
            found.setdefault(r.item_id, []).extend(values)
            within[r.item_id] += [c for cut, unspaced in values if not unspaced for c in cut]
    out = {}
    for item, values in found.items():
        parts = []
        for cut, unspaced in values:
            h = wording.hashes([x for c in cut for x in c])
            stock = np.concatenate([np.full(len(c), len(seen[tuple("".join(c))]) >= STOCK) for c in cut])
            parts.append((h, unspaced, stock))
        if any(len(h) for h, _, s in parts if not s.all()):
            inside = [wording.hashes(x) for c in within[item] if len(seen[tuple("".join(c))]) < STOCK for x in _stretches_of(c)]
            out[item] = Item(parts, inside)
    return out


def _stretches(it: Item):
    """(size of a window, [(place, term)]) of each stretch without stock."""
    for at, h, u in it.free:
        yield RUN_UNSPACED - 2 if u else RUN - 1, [(at + i, x) for i, x in enumerate(_terms(h, u).tolist())]


def all_terms(items: dict[str, Item]) -> np.ndarray:
    """Every term of the items."""
    found = {t for it in items.values() for _, t in it.terms()} | {t for it in items.values() for _, x in _stretches(it) for _, t in x}
    return np.array(sorted(found), np.int64)


def anchors(items: dict[str, Item], df: dict[int, int]) -> list[tuple[int, str, int, int, int, bool]]:
    """(term, item, place in the item, width of an offset band, how many are needed, of the whole item): the rarest by training postings."""
    rank = lambda p: (df.get(p[1], 0), p[1], p[0])
    out = []
    for name, it in items.items():
        runs: set[tuple[int, int]] = set()
        for size, t in _stretches(it):
            for i in range(len(t) - size + 1):
                runs.update(sorted(t[i : i + size], key=rank)[:3])
        out += [(t, name, p, 1, 3, False) for p, t in runs if t in df]
        terms, spoiled = [] if it.short() else it.terms(), it.spoiled()
        need = max(1, min(4, len(terms) - spoiled))
        band = max(4, len(it.whole) // SHARE + 1)
        out += [(t, name, p, band, need, True) for p, t in sorted(terms, key=rank)[: spoiled + need] if t in df]
    return out


INDEX = "terms binary, texts binary, places binary"


def _run(terms: list, texts: list, places: list) -> pa.RecordBatch:
    t = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    th = np.repeat(np.array(texts, np.int64), [len(x) for x in terms])
    at = np.concatenate(places) if places else np.zeros(0, np.int32)
    order = np.argsort(t, kind="stable")
    cuts = range(0, len(t), PIECE)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i : i + PIECE].tobytes() for i in cuts], pa.binary()) for x in (t[order], th[order], at[order])], ["terms", "texts", "places"]
    )


def _postings(batches):
    """th, text -> runs of postings sorted by term; a text met again lately adds none."""
    seen: set[int] = set()
    terms, texts, places, held = [], [], [], 0
    for batch in batches:
        for t, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist()):
            if t in seen:
                continue
            if len(seen) > 500_000:
                seen.clear()
            seen.add(t)
            at, of_text, of_place = 0, [], []
            values, inside = units(text)
            for w, unspaced in [*values, *((x, True) for x in inside)]:
                of_text.append(_terms(wording.hashes(w), unspaced))
                of_place.append(np.arange(at, at + len(of_text[-1]), dtype=np.int32))
                at += len(w)
            if of_text:
                terms.append(np.concatenate(of_text))
                places.append(np.concatenate(of_place))
                texts.append(t)
                held += len(terms[-1])
            if held > POSTINGS:
                yield _run(terms, texts, places)
                terms, texts, places, held = [], [], [], 0
    yield _run(terms, texts, places)


def build_index(surfaces: DataFrame) -> DataFrame:
    """The stored index of surfaces with columns th (a hash of the text) and text."""
    with setting(surfaces.sparkSession, spark_sql_execution_arrow_maxBytesPerBatch=str(AT_ONCE)):
        return written(surfaces.select("th", "text").mapInArrow(_postings, INDEX), "p5-index", **{"parquet.block.size": str(2 * AT_ONCE)})


def _found(wanted: np.ndarray, counts: bool):
    """The postings of the wanted (sorted) terms, or how many there are of each."""

    def look(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, texts, places in zip(*(batch.column(c) for c in ("terms", "texts", "places"))):
                t = np.frombuffer(terms.as_buffer(), np.int64)
                if not len(t):
                    continue
                first, behind = np.searchsorted(wanted, t[0], "left"), np.searchsorted(wanted, t[-1], "right")
                some = wanted[first:behind]
                low, high = np.searchsorted(t, some, "left"), np.searchsorted(t, some, "right")
                n = high - low
                total[first:behind] += n
                if counts or not n.sum():
                    continue
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t[at], pa.int64()), pa.array(np.frombuffer(texts.as_buffer(), np.int64)[at], pa.int64()),
                        pa.array(np.frombuffer(places.as_buffer(), np.int32)[at], pa.int32())
                    ], ["term", "th", "pos"]
                )
        if counts:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some], pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    return look


def _carries(item: Item, h: np.ndarray, windows: set[int]) -> bool:
    if item.runs & windows:
        return True
    return wording.within(item.whole, h, 0, SHARE) <= len(item.whole) // SHARE


def carried(text: str, names: list[str], items: dict[str, Item]) -> list[str]:
    """Those of the items whose wording a text carries."""
    found, inside = units(text)
    if not found:
        return []
    h = [(wording.hashes(w), u) for w, u in found]
    windows = {x for p, u in [*h, *((wording.hashes(w), True) for w in inside)] for x in wording.window_hashes(p, RUN_UNSPACED if u else RUN).tolist()}
    whole = np.concatenate([p for p, _ in h])
    return [n for n in names if _carries(items[n], whole, windows)]


def search(index: DataFrame, items: dict[str, Item]) -> DataFrame:
    """(item_id, th): texts of the index that may carry wording of an item."""
    spark = index.sparkSession
    counted = index.mapInArrow(_found(all_terms(items), True), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with setting(spark, spark_sql_execution_arrow_maxBytesPerBatch=str(AT_ONCE)):
        df = {r.term: r.n for r in counted.collect()}  # at most as many rows as the items have terms
    marks = anchors(items, df)
    names, types = ("term", "item_id", "ipos", "band", "need", "in_item"), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    table = spark.createDataFrame(pa.table({n: pa.array([m[i] for m in marks], t) for i, (n, t) in enumerate(zip(names, types))}))
    postings = index.mapInArrow(_found(np.array(sorted({m[0] for m in marks}), np.int64), False), "term long, th long, pos int")
    # the table has at most as many rows as the items, whose size is checked, have terms
    meets = postings.join(F.broadcast(table), "term").withColumn("off", F.col("pos") - F.col("ipos"))
    low = F.floor(F.col("off") / F.col("band"))
    meets = meets.select(
        "item_id", "th", "ipos", "need", "in_item", F.explode(F.when(F.col("in_item"), F.array(low, low + 1)).otherwise(F.array(low))).alias("at")
    )
    return meets.groupBy("item_id", "th", "in_item", "at").agg(
        F.count_distinct("ipos").alias("n"), F.max("need").alias("need")
    ).where("n >= need").select("item_id", "th").distinct()


def leaked(items: DataFrame, surfaces: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(item_id, row_id) of every surface (row_id, text) that carries wording of an item; of: the row_ids that count."""
    spark = surfaces.sparkSession
    held = read_items(items)
    if not held:
        return spark.createDataFrame([], "item_id string, row_id string")
    source = surfaces.where("row_id is not null and text is not null").select("row_id", F.xxhash64("text").alias("th"), "text")
    return leaked_by(build_index(source), source, held, of)


def leaked_by(index: DataFrame, source: DataFrame, held: dict[str, Item], of: DataFrame | None = None) -> DataFrame:
    """The same with an index that is stored already; source: row_id, th, text."""
    with setting(index.sparkSession, spark_sql_execution_arrow_maxBytesPerBatch=str(AT_ONCE)):
        candidates = written(search(index, held), "p5-candidates")
    rows = source.select("row_id", "th").join(candidates.select("th").distinct(), "th", "left_semi").distinct()
    if of is not None:
        rows = rows.join(of.select("row_id").distinct(), "row_id", "left_semi")
    rows = written(rows, "p5-rows")
    wanted = candidates.join(rows.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.collect_list("item_id").alias("items"))  # of items only
    shared = source.sparkSession.sparkContext.broadcast(held)
    near = source.select("th", "text").join(wanted, "th").mapInArrow(_compare(shared, None), "item_id string, th long")
    short = sorted(n for n, it in held.items() if it.short())
    if short:
        near = near.unionByName(source.select("th", "text").mapInArrow(_compare(shared, short), "item_id string, th long"))
        rows = source.select("row_id", "th") if of is None else source.select("row_id", "th").join(of.select("row_id").distinct(), "row_id", "left_semi")
    return near.distinct().join(rows, "th").select("item_id", "row_id").distinct()


def _compare(shared, names: list[str] | None):
    """th, text (and items, where no names are given) -> item_id, th of the wordings that are carried; a text met again lately is skipped."""

    def run(batches):
        seen, items = set(), shared.value
        for batch in batches:
            a, b = [], []
            for k, (th, text) in enumerate(zip(batch.column("th").to_pylist(), batch.column("text").to_pylist())):
                if th in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(th)
                got = carried(text, names or batch.column("items")[k].as_py(), items)
                a += got
                b += [th] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64())], ["item_id", "th"])

    return run


def training_surfaces(rows: DataFrame, passes: DataFrame) -> DataFrame:
    """row_id, text: state and instructions of training rows; of passes the part before the question and the question."""
    train = rows.where("split = 'train'").select("row_id", F.explode(F.array("state", "instructions")).alias("text"))
    mark = F.concat(F.lit("\n\n["), F.coalesce("qtype", F.lit("")), F.lit("] "))
    cut = passes.select("row_id", "text", mark.alias("mark")).withColumn("tail", F.expr("substring_index(text, mark, -1)"))
    halves = F.when(
        F.col("text").contains(F.col("mark")), F.array(F.expr("left(text, length(text) - length(tail) - length(mark))"), F.col("tail"))
    ).otherwise(F.array("text"))
    return train.unionByName(cut.select("row_id", F.explode(halves).alias("text")))


def item_leaks(items: DataFrame, rows: DataFrame, passes: DataFrame) -> DataFrame:
    """(item_id, row_id): row_id is a training row that carries wording of the item."""
    return leaked(items, training_surfaces(rows, passes), rows.where("split = 'train' and row_id is not null"))
