"""Packing passes into batches under a token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hashing


def pack(df: DataFrame, key: str, group: str, cost: str, budget: int, padded: bool = False, rows_per_group: int = 50_000) -> DataFrame:
    """key, group, batch, slot: in order of cost, a batch is closed before its sum (or, padded, its longest times its number) would pass the budget.

    Groups are split by a hash of the key into parts of about rows_per_group rows, so a large group is never one task; batches restart in each
    part (batch is the part times 2^32 and a number), so each leaves at most one batch that isn't full. The result depends on the rows alone, not on
    partitions. An item over the budget is a batch of its own. Null costs count as 0.
    """
    base = df.select(F.col(key), F.col(group), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("cost"))
    parts = max(1, -(-base.count() // rows_per_group))
    spread = base.withColumn("__part", (hashing.hex_number(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 8) % parts).cast("int"))
    types = dict(base.dtypes)

    def fill(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column(key).to_numpy(zero_copy_only=False).astype(str), table.column("cost").to_numpy()))
        table = table.take(pa.array(order))
        batch, slot, at, total, longest, count = [], [], 0, 0, 0, 0
        for c in table.column("cost").to_pylist():
            top = max(longest, c)
            over = top * (count + 1) > budget if padded else total + c > budget
            if count and over:
                at, total, longest, count = at + 1, 0, 0, 0
            total, longest = total + c, max(longest, c)
            batch.append(at)
            slot.append(count)
            count += 1
        part = table.column("__part")[0].as_py() if table.num_rows else 0
        return pa.table(
            {
                key: table.column(key), group: table.column(group), "cost": table.column("cost"),
                "batch": pa.array([(part << 32) + b for b in batch], pa.int64()), "slot": pa.array(slot, pa.int32())
            }
        )

    return spread.groupBy(group, "__part").applyInArrow(fill, f"`{key}` {types[key]}, `{group}` {types[group]}, cost long, batch long, slot int")
