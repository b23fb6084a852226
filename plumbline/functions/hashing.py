"""Deterministic hashes and splits; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by the unit separator; null parts are left out."""
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def hex_number(digest: Column, digits: int) -> Column:
    """The first digits (at most 15) of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def unit(*parts: Column) -> Column:
    """A number from 0 to 1: the first 64 bits of the content hash over 2^64."""
    return F.conv(F.substring(content_hash(*parts), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def is_val(row_id: Column, frac: int = 10) -> Column:
    """Whether a row is held out: a content hash of its id, so neither order nor partitioning matters."""
    return hex_number(F.sha2(row_id, 256), 8) % frac == 0
