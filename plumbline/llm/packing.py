"""Filling containers of fixed capacity with items by best-two-fit.

Items are spread by a hash into groups of about GROUP_TOKENS tokens, and each group is packed alone: a container
takes the largest item that fits until none does; then its smallest item gives way to the two unpacked items that
fill the widened gap best, if they fill it better. A group leaves at most one container that no item of the group could
fill, against GROUP_TOKENS / capacity full ones.

An item over the capacity is divided into full parts and a rest, and the rest is an item like others; no other
item is divided. Items of size 0 (null and empty texts) go to the first container of their group. Capacities
that are null or not positive get no containers.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import written

GROUP_TOKENS = 4_000_000
#: Windows are a small fixed table.
MOST_WINDOWS = 1000
SCHEMA = "window_name string, container_id long, doc_id long, part int, n_tokens int"


class _Sizes:
    """Unpacked items by size, with the largest size at or below a bound in a few steps."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, n in enumerate(sizes.tolist()):
            self.items[n].append(i)
        self.have = sorted(n for n in range(1, capacity + 1) if self.items[n])

    def below(self, most: int) -> int:
        """The largest size there is, at most most; 0 if none."""
        k = bisect.bisect_right(self.have, most)
        return self.have[k - 1] if k else 0

    def take(self, n: int) -> int:
        i = self.items[n].pop()
        if not self.items[n]:
            del self.have[bisect.bisect_left(self.have, n)]
        return i

    def put(self, n: int, i: int) -> None:
        if not self.items[n]:
            bisect.insort(self.have, n)
        self.items[n].append(i)

    def best_two(self, gap: int, least: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum over least and at most gap."""
        have, best, found = self.have, least, None
        lo, hi = 0, len(have) - 1
        while lo <= hi:
            s = have[lo] + have[hi]
            if s > gap or lo == hi and len(self.items[have[lo]]) < 2:
                hi -= 1
                continue
            if s > best:
                best, found = s, (have[lo], have[hi])
                if s == gap:
                    return found
            lo += 1
        return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes from 1 to capacity."""
    left, where, box = _Sizes(sizes, capacity), np.full(len(sizes), -1, np.int64), 0
    while left.have:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while gap and (n := left.below(gap)):
            inside.append((n, left.take(n)))
            gap -= n
        while gap and inside and left.have:
            small = min(inside)
            two = left.best_two(gap + small[0], small[0])
            if not two:
                break
            inside.remove(small)
            inside += [(n, left.take(n)) for n in two]
            left.put(*small)
            gap += small[0] - sum(two)
        for _, i in inside:
            where[i] = box
        box += 1
    return where


def _pack(table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return table
    name, cap, group = table.column("window_name")[0].as_py(), table.column("capacity")[0].as_py(), table.column("group")[0].as_py()
    doc, part, n = table.column("doc_id").to_numpy(), table.column("part").to_numpy(), table.column("n_tokens").to_numpy()
    order = np.lexsort((part, doc))
    doc, part, n = doc[order], part[order], n[order]
    box = np.zeros(len(n), np.int64)
    some = n > 0
    box[some] = best_two_fit(n[some], cap)
    return pa.table(
        {
            "window_name": pa.array([name] * len(n), pa.string()), "container_id": pa.array((np.int64(group) << 32) + box, pa.int64()),
            "doc_id": pa.array(doc, pa.int64()), "part": pa.array(part, pa.int32()), "n_tokens": pa.array(n, pa.int32())
        }
    )


def fill_containers(items: DataFrame, windows: DataFrame) -> DataFrame:
    """window_name, container_id, doc_id, part, n_tokens; items: doc_id, n_tokens; windows: window_name, capacity_tokens (a small fixed table)."""
    items = written(items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n")), "p8-items")
    total = items.agg(F.sum("n").alias("n")).first().n or 0
    groups = max(1, -(-total // GROUP_TOKENS))
    caps = windows.where("capacity_tokens > 0 and window_name is not null").select(
        "window_name", F.col("capacity_tokens").cast("int").alias("capacity")
    ).distinct()
    some = caps.limit(MOST_WINDOWS + 1).collect()
    if len(some) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    pairs = F.array(
        *[F.struct(F.lit(r.window_name).alias("window_name"), F.lit(r.capacity).alias("capacity")) for r in some]
    ) if some else F.array().cast("array<struct<window_name: string, capacity: int>>")
    each = items.select("doc_id", "n", F.explode(pairs).alias("w")).select("doc_id", "n", "w.*")
    sizes = F.when(
        F.col("n") > F.col("capacity"),
        F.concat(
            F.array_repeat(F.col("capacity").cast("long"), F.floor(F.col("n") / F.col("capacity")).cast("int")),
            F.when(F.col("n") % F.col("capacity") > 0, F.array(F.col("n") % F.col("capacity"))).otherwise(F.array().cast("array<bigint>")),
        ),
    ).otherwise(F.array("n"))
    parts = each.select("window_name", "capacity", "doc_id", F.posexplode(sizes).alias("part", "n_tokens"))
    spread = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups))).withColumn("n_tokens", F.col("n_tokens").cast("int"))
    return spread.groupBy("window_name", "group").applyInArrow(_pack, SCHEMA)


def document_sizes(documents: DataFrame, tokenizer: str = tokens.DEFAULT, folder: str | None = None) -> DataFrame:
    return tokens.count_texts(documents.select("doc_id", "text"), ["doc_id"], "text", tokenizer, folder).select("doc_id", "n_tokens")


def fill_report(containers: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, tokens, the least number of containers that could hold them, and the share filled."""
    boxes = containers.groupBy("window_name", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    per = boxes.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"))
    return per.join(windows, "window_name").select(
        "window_name", "capacity_tokens", "containers", "items", "tokens",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled")
    )
