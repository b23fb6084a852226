"""Encoding a whole corpus with a public tokenizer, each content-defined chunk once.

A rolling hash over WINDOW characters cuts every text into chunks of about MEAN characters, so that shared
passages give equal chunks wherever they stand. Each different chunk is encoded once: what lies between its first and
last proven token boundary (see tokens.BOUNDARY) is final, its head and tail wait. Each text puts its
chunks together again, and every join (tail, chunks without a boundary, next head) is encoded anew, which
agrees exactly with encoding the text as a whole.

Empty and null texts have no ids (an empty list). Chunks that hold at least one part in HOT of all places are salted in the
join; there are at most HOT of them, so their list may be broadcast. Repeated ids give one row each per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import written

WINDOW, MEAN, LONGEST, HOT, SALTS = 16, 256, 32_768, 1000, 32


def batch_ends(texts: list[str]) -> list[list[int]]:
    """Where the rolling hash cuts each text; the last cut is its length. One pass over all texts; a window never reaches into another text."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    u = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hits = np.zeros(0, np.int64)
    if len(u) >= WINDOW:
        h = np.zeros(len(u) - WINDOW + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(WINDOW):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= u[i : i + len(h)]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        hits = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + WINDOW
    owner = np.searchsorted(start, hits - 1, "right") - 1
    inside = hits - start[owner] >= WINDOW if len(hits) else np.zeros(0, bool)
    owner, ends = owner[inside], (hits - start[owner])[inside] if len(hits) else hits
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, n in enumerate(size.tolist()):
        found, last = [], 0
        for e in [*ends[cuts[k] : cuts[k + 1]].tolist(), n]:
            while e - last > LONGEST:
                last += LONGEST
                found.append(last)
            if e > last:
                found.append(e)
                last = e
        out.append(found or [n])
    return out


def chunk_ends(text: str) -> list[int]:
    return batch_ends([text])[0]


def _cut(batches):
    for batch in batches:
        rows, ids, seq, key, chunk = [], [], [], [], []
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        ends = [e for lo in range(0, len(texts), 256) for e in batch_ends(texts[lo : lo + 256])]
        for r, d, text, cuts in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts, ends):
            at = 0
            for k, e in enumerate(cuts):
                rows.append(r)
                ids.append(d)
                seq.append(k)
                chunk.append(text[at:e])
                key.append(xxhash.xxh3_128_digest(chunk[-1].encode("utf-8", "surrogatepass")))
                at = e
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(key, pa.binary()), pa.array(chunk, pa.string())],
            ["row", "doc_id", "seq", "key", "chunk"]
        )


def _pack(ids: list[int]) -> bytes:
    """Two bytes an id where that is enough, after a byte that tells."""
    a = np.array(ids, np.int32)
    return b"2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 65536 else b"4" + a.astype("<i4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[:1] == b"2" else "<i4", offset=1).astype(np.int32)


def edges(chunk: str) -> tuple[int, int] | None:
    """The first and the last proven token boundary; the last is looked for from the end in steps."""
    first = tokens.BOUNDARY.search(chunk)
    if not first:
        return None
    back = 32
    while True:
        last = None
        for last in tokens.BOUNDARY.finditer(chunk, max(0, len(chunk) - back)):
            pass
        if last or back >= len(chunk):
            return first.start(), last.start()
        back *= 4


def encode_chunks(name: str, folder: str | None):
    def run(batches):
        encode = tokens.encoder(name, folder)
        for batch in batches:
            head, inner, tail = [], [], []
            for c in batch.column("chunk").to_pylist():
                at = edges(c) if tokens.is_cuttable(name) else None
                if at:
                    head.append(c[: at[0]])
                    inner.append(_pack(encode([c[at[0] : at[1]]])[0]))
                    tail.append(c[at[1] :])
                else:
                    head.append(c)
                    inner.append(None)
                    tail.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(head, pa.string()), pa.array(inner, pa.binary()), pa.array(tail, pa.string())],
                ["key", "head", "inner", "tail"]
            )

    return run


def assemble(pieces: list[tuple[str, bytes | None, str | None]], encode) -> np.ndarray:
    """The ids of a text from its chunks in order: joins are encoded anew."""
    out, waiting = [], ""
    for head, inner, tail in pieces:
        waiting += head
        if inner is not None:
            if waiting:
                out.append(np.array(encode([waiting])[0], np.int32))
            out.append(_unpack(inner))
            waiting = tail or ""
    if waiting:
        out.append(np.array(encode([waiting])[0], np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def encode_corpus(documents: DataFrame, tokenizer: str = tokens.DEFAULT, folder: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(
        source.where("text is not null and text <> ''").withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _cut, "row long, doc_id long, seq int, key binary, chunk string"
        ),
        "p7-chunks"
    )
    total = chunks.count()
    hot = chunks.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, -(-total // HOT))).select("key", F.lit(True).alias("hot"))
    coded = chunks.groupBy("key").agg(F.first("chunk").alias("chunk")).mapInArrow(
        encode_chunks(tokenizer, folder), "key binary, head string, inner binary, tail string"
    )
    salted = lambda df, salt: df.join(F.broadcast(hot), "key", "left").withColumn("salt", salt).drop("hot")
    places = salted(chunks.select("row", "doc_id", "seq", "key"), F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    coded = salted(coded, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    whole = places.join(coded, ["key", "salt"]).groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "head", "inner", "tail"))).alias("pieces")
    )

    def join(batches):
        encode = tokens.encoder(tokenizer, folder)
        for batch in batches:
            ids = [assemble([(p["head"], p["inner"], p["tail"]) for p in pieces], encode) for pieces in batch.column("pieces").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"]
            )

    none = source.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return whole.mapInArrow(join, "doc_id long, ids array<int>").unionByName(none)
