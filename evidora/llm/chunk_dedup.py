"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where its low bits are
zero, after at least `least` and at most `most` bytes, and never so that fewer than
`least` bytes would be left behind it.  The hash at a byte
depends on the bytes just before it only, so after an insertion the cuts fall
into step again.  Chunks are known by a 128-bit digest; the first occurrence (by
doc_id, then place) stays and every later one goes.

Defined results: a null or empty text has no chunks, one of fewer than `least` bytes
is one chunk; very long texts are cut whole, each by itself; rows without doc_id come
after all others; of equal chunks under one doc_id in different texts the one whose row key is
least counts as first; repeated rows, of the same id and text, are one document and
all get what it gets; a cut may part a character, so what stays is given as bytes; an empty table gives an
empty one; other columns are kept, and a column named as an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import blocks, constants, text_bytes
from .tables import fresh, map_batches, row_key, settle, spread

LEAST, MASK_BITS, MOST = 64, 5, 256
_GEAR = constants(256, 61) ^ np.uint64(0x5555)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 64 codes, each shifted by its age."""
    h = _GEAR[data]
    width = 1
    while width < 64:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def chunk_ends(cuts: np.ndarray, size: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text of `size` bytes, from the places where the hash allows a cut."""
    ends, at, k = [], 0, 0
    allowed = cuts.tolist()
    while at < size:
        while k < len(allowed) and allowed[k] < at + least:
            k += 1
        end = min(allowed[k] if k < len(allowed) else size, at + most, size)
        end = size if size - end < least else end
        ends.append(end)
        at = end
    return ends


def text_chunks(data: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of one text."""
    if not len(data):
        return []
    mask = np.uint64(((1 << bits) - 1) << 40)
    return chunk_ends(np.flatnonzero((gear(data) & mask) == 0) + 1, len(data), least, most)


def chunks(rows: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """(id, row, digest, check, place) of every chunk of (id, row, text); a place has the first byte in its upper half and the size in the lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in blocks(offsets):
                owner, digest, places = [], [], []
                for i in range(a, b):
                    text = data[offsets[i] : offsets[i + 1]]
                    raw = memoryview(text.tobytes())
                    ends = np.array(text_chunks(text, least, most, bits), np.int64)
                    begins = np.append(0, ends[:-1]) if len(ends) else ends
                    owner.append(np.full(len(ends), i))
                    digest += [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
                    places.append(begins << 32 | (ends - begins))
                take = pa.array(np.concatenate(owner))
                pairs = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.concatenate(places))], names=["id", "row", "digest", "check", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "row", "text"), run, f"id {kind}, row binary, digest long, check long, place long")


def dedup_chunks(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST, bits: int = MASK_BITS) -> DataFrame:
    """Add n_chunks, removed_spans (array of (first, end) in bytes) and kept_bytes to each row."""
    outs = ["n_chunks", "removed_spans", "kept_bytes"]
    df = df.drop(*outs)
    own = fresh(df, ["row", "gone"])
    base = df.withColumn(own["row"], row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    rows = base.select(F.col(f"`{doc_id}`").alias("id"), F.col(own["row"]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = chunks(rows, least, most, bits)
    # half a digest that occurs once is a chunk that occurs once; only the others are looked at whole
    # (kept as tables, so that joins have plain exchanges on both sides and hot chunks can be split)
    often = settle(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    some = settle(found.join(often, "digest"))
    home = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "place")).alias("home")
    repeated = settle(some.groupBy("digest", "check").agg(F.count("*").alias("n"), home).where("n > 1").select("digest", "check", "home"))
    again = some.join(repeated, ["digest", "check"]).where((F.col("home.row") != F.col("row")) | (F.col("home.place") != F.col("place")))
    first = F.shiftright("place", 32)
    again = again.select("row", first.alias("first"), (first + F.col("place").bitwiseAND(F.lit((1 << 32) - 1))).alias("end")).distinct()
    by_row = again.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias(own["gone"]))
    single = spread(base, own["row"]).join(by_row.withColumnRenamed("row", own["row"]), own["row"], "left")
    names = df.columns
    joined = single.select(*[F.col(f"`{c}`") for c in names], own["gone"])
    position = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            gone = batch.column(len(names)).to_pylist()
            counts, spans, left = [], [], []
            for i, ranges in enumerate(gone):
                raw = data[offsets[i] : offsets[i + 1]]
                ends = text_chunks(raw, least, most, bits)
                merged: list[list[int]] = []
                for x in ranges or ():
                    if merged and x["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["first"], x["end"]])
                edges = [0, *(e for m in merged for e in m), len(raw)]
                whole = raw.tobytes()
                counts.append(len(ends))
                spans.append([{"first": a, "end": b} for a, b in merged])
                left.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.binary())], names=[*names, *outs])

    pairs = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    return map_batches(joined, cut, T.StructType([*df.schema.fields, T.StructField(outs[0], T.LongType()), T.StructField(outs[1], pairs), T.StructField(outs[2], T.BinaryType())]))
