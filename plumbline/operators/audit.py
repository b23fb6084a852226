"""Shingle overlap between held-out items and training texts, as an equi-join on shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text

#: Parts of the training side of a shingle that several items share.
SALTS = 32


def shingle_rows(df: DataFrame, id_col: str, text_col: str, n: int = 8) -> DataFrame:
    """(id, shingle hash, shingle), distinct within a text. The words are a column of their own, else every shingle would find them anew."""
    w = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), text.tokens(F.col(text_col)).alias("words"))
    s = w.select(id_col, F.explode(text.shingles(F.col("words"), n)).alias("shingle"))
    return s.select(id_col, F.xxhash64("shingle").alias("h"), "shingle")


def overlap_pairs(items: DataFrame, item_id: str, item_text: str, train: DataFrame, train_id: str, train_text: str, n: int = 8) -> DataFrame:
    """(item, training row, shared shingles); a row that stands in the table again counts once, null texts have none.

    The different hashes of the items are met first: where they are few enough for the optimizer to send them to every worker, no shingle that no item
    has is shuffled. Boilerplate that many items share is salted: the training side takes one of the salts, the items' side all. The join compares the
    shingle itself behind its hash."""
    a = shingle_rows(items, item_id, item_text, n).distinct()
    b = shingle_rows(train, train_id, train_text, n).join(a.select("h").distinct(), "h", "left_semi")
    often = a.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")  # of the items, a small fixed table
    a = a.join(often.withColumn("stock", F.lit(True)), "h", "left").withColumn(
        "salt", F.explode(F.when(F.col("stock"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    b = b.join(often.withColumn("stock", F.lit(True)), "h", "left").withColumn(
        "salt", F.when(F.col("stock"), F.pmod(F.xxhash64(train_id), F.lit(SALTS)).cast("int")).otherwise(0)
    ).drop("stock")
    j = b.join(a.drop("stock").withColumnRenamed("shingle", "other"), ["h", "salt"]).where("shingle = other")
    return j.select(item_id, train_id, "h", "shingle").distinct().groupBy(item_id, train_id).agg(F.count("*").alias("shared"))
