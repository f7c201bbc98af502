"""Hashes that identify tokens, phrases and requests (EMB-01, QRY-33, QRY-34)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295  # fixed values of FNV-1a


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text, as a non-negative long."""
    return F.aggregate(_codes(text), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(MASK32).cast("long")))


def poly31(text: Column) -> Column:
    """The 31-polynomial hash of a text in 32 bits, as a non-negative long."""
    return F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(MASK32).cast("long")))


def cache_key(length: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts, joined by bars; null parts are empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.left(F.sha2(joined, 256), F.lit(length))
