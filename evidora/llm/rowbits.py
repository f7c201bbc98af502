"""Arrays that all tasks make together, and a bit table of row keys, so that tasks can leave rows out without a shuffle of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches

SLICE = 1 << 16
#: Bits of a table of rows: 12 a row, but no more than these (16 MB).
MOST_BITS = 1 << 27


def merged_slices(slices: DataFrame, n: int, kind: str, merge: np.ufunc) -> np.ndarray:
    """An array of n numbers from the slices (slice, counts) of all tasks, merged in two rounds, so that the driver gets each slice once."""
    size = SLICE * np.dtype(kind).itemsize

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(raw, dtype=kind if len(raw) == size else "<u4").astype(kind)
                found[k] = merge(found[k], own) if k in found else own
        for k, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    first = map_batches(slices.withColumn("part", F.pmod(F.hash("counts"), F.lit(32))).repartition("slice", "part").select("slice", "counts"), add, schema)
    out = np.zeros(n, np.dtype(kind))
    for r in map_batches(first.repartition("slice"), add, schema).collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(bytes(r["counts"]), dtype=kind)
    return out


def _bit_places(rows: pa.Array, bits: int) -> np.ndarray:
    """Four places in the bit table for each 16-byte key."""
    a, b = np.frombuffer(b"".join(rows.to_pylist()), dtype="<u8").reshape(-1, 2).T
    return np.stack([(a + np.uint64(k) * (b | np.uint64(1))) & np.uint64(bits - 1) for k in range(4)]).astype(np.int64)


def row_bits(rows: DataFrame) -> bytes:
    """A bit table of the row keys (row); of the size that their number asks for, up to MOST_BITS.

    A key that it doesn't have is let through by chance: about one in three hundred, and more where more keys than a twelfth of MOST_BITS are in it.
    """
    bits = max(8 * SLICE, min(MOST_BITS, 1 << int(12 * rows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                at = _bit_places(batch.column(0), bits).ravel()
                np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(table), SLICE):
            if table[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([table[k : k + SLICE].tobytes()], pa.binary())], names=["slice", "counts"])

    return merged_slices(map_batches(rows.select("row"), run, "slice int, counts binary"), bits // 8, "u1", np.bitwise_or).tobytes()


def rows_in(rows: pa.Array, table: bytes) -> pa.Array:
    """Which of the 16-byte keys the table has, or lets through by chance."""
    if not len(rows):
        return pa.array([], pa.bool_())
    bits = np.frombuffer(table, np.uint8)
    at = _bit_places(rows, 8 * len(bits))
    return pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0))
