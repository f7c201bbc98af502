"""Byte-level BPE encoding and decoding.

The vocabulary is a rank file: a token's id is its merge rank.  Bytes are
mapped to Latin-1 characters, so that an Aho-Corasick automaton over the tokens
finds, for every position of a piece, the longest token that starts there.  The
encoder walks from left to right with that longest token, and falls back to the
next shorter one (or drops the last token) when the token does not go together
with the one before it.  Two adjacent tokens go together if encoding just their
joint bytes gives the two of them again; that answer is memoised, as is the
encoding of short pieces.  A bit per position keeps dead ends from being tried
twice, so the time is linear in the length of the piece.

Defined results: a null or empty text has no tokens and decodes to no bytes;
text that looks like a special token is ordinary text; texts of any length are
encoded whole; repeated rows give repeated results; other columns are kept and
may have any name (a column named as an output is replaced).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import map_batches

PIECES_KEPT = 250_000  # size at which a worker's memo starts afresh
PIECE_BYTES_KEPT = 64
PAIRS_KEPT = 500_000
OUT_BYTES = 8 << 20


class ByteBPE:
    """An encoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.size = {i: len(token) for token, i in self.ranks.items()}
        self.together: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}  # ids as packed 32-bit integers: nothing for the garbage collector to walk

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            made.add_word(token.decode("latin-1"), i)
        made.make_automaton()
        return made

    @cached_property
    def shorter(self) -> dict[int, int]:
        """For each token the longest one that is a proper prefix of it, or -1."""
        return {i: next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1) for t, i in self.ranks.items()}

    def merged(self, text: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for the few bytes of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        if len(self.together) >= PAIRS_KEPT:
            self.together.clear()
        known = self.together[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def walk(self, piece: bytes) -> list[int]:
        """The encoding of a piece by backtracking from longest matches."""
        n, size, shorter, together = len(piece), self.size, self.shorter, self.together
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # later ends are longer
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + size[token]
            if alive[end]:
                good = last < 0 or together.get((last, token))
                if good or good is None and self.fit(last, token):
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: give up this position and shorten the token before it
                alive[at] = 0
                out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        ids = array("i", [whole] if whole is not None else self.walk(raw)).tobytes()
        if len(raw) <= PIECE_BYTES_KEPT:
            if len(self.memo) >= PIECES_KEPT:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        memo, piece_ids = self.memo.get, self.encode_piece
        pieces = self.split.findall(text) if len(text) < 1 << 20 else (m.group() for m in self.split.finditer(text))
        return np.frombuffer(b"".join([memo(p) or piece_ids(p) for p in pieces]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[int, ByteBPE] = {}


def _encoder(rank_file: bytes, pattern: str) -> ByteBPE:
    """One encoder for each vocabulary and Python worker."""
    key = hash((rank_file, pattern))
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(rank_file, pattern)
    return _made[key]


def _slices(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about OUT_BYTES of output, from the sizes of a column's values."""
    from .bytetext import blocks, text_bytes

    for batch in batches:
        column = batch.column(at)
        if pa.types.is_list(column.type):
            sizes = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) * width
        else:
            sizes = text_bytes(column)[1] * width
        for a, b in blocks(sizes, OUT_BYTES):
            yield batch.slice(a, b - a)


def encode_documents(df: DataFrame, rank_file: bytes, pattern: str, *, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of a text column as an array of integers.

    With `decoded`, also add the bytes that these ids decode to, in the same pass, so one worker has the vocabulary and not two.
    """
    outs = [ids, *([decoded] if decoded else [])]
    kept = [c for c in df.columns if c not in outs]
    shared = df.sparkSession.sparkContext.broadcast(rank_file)  # a vocabulary: its size does not grow with the data
    position = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared.value, pattern)
        for batch in _slices(batches, position, 2):
            found = [bpe.encode(t or "") for t in batch.column(position).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            back = [pa.array([bpe.decode(x) for x in found], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *back], names=[*kept, *outs])

    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), run, schema)


def decode_documents(df: DataFrame, rank_file: bytes, pattern: str, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of token ids stands for; a null array has none."""
    kept = [c for c in df.columns if c != out]
    shared = df.sparkSession.sparkContext.broadcast(rank_file)
    position = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared.value, pattern)
        for batch in _slices(batches, position, 4):
            lists = batch.column(position)
            at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]
            values = np.asarray(lists.values)
            decoded = [bpe.decode(values[a:b]) if good else b"" for a, b, good in zip(at.tolist(), at[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*kept, out])

    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(out, T.BinaryType())])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), run, schema)
