"""Exact Jaccard join of texts by their word n-grams, with rare-first prefix filtering.

Sets.  A text's set is its distinct word n-grams.  Texts with equal sets are one *class*, known by the set's 128-bit digest;
only classes are joined.

Order.  N-grams are ranked rare first, by how often their counter counted and then by hash.  Counters are `COUNTERS` sums over all
texts (n-grams share them by hash), so the ranking has a fixed size whatever the corpus; any ranking gives the same
result, a good one gives fewer candidates.

Candidates.  Two sets at the threshold share one of their rarest n-grams: one of the first |x| - ceil(t |x|) + 1 of each.  These prefixes are
the postings, joined on the n-gram.  A pair of postings passes only if
* the lengths allow it: t |y| <= |x| for the shorter x;
* the positions allow it: what lies behind both of them, and the n-gram itself, are enough for the overlap that the lengths ask for;
* the suffixes allow it: so is the n-gram with the sum, over `SLOTS` ranges of hashes, of the smaller number of
  n-grams behind the two positions in that range.
At the first n-gram that two prefixes share these bounds hold, so no linked pair is lost.

Order of work.  In a list of up to `SMALL` postings all pairs are candidates; in a longer one first only neighbours (by size, then by a hash of the list's own) are,
and only in the `LISTS` rarest long lists of a class.  Candidates are verified, and chain classes to components.  Then the rest of the long lists follows: postings
outside a list's largest component with all others, in blocks; where a list is one component by now, nothing is left.  There a finer suffix filter holds
too: the whole sets' counts in `FINE` ranges of hashes.  Pairs that pass are not told, as their number grows with the square of a group: a list only tells which components
they chain, an edge a component at most.  Lists of over `LIST_ROWS` postings are cut into parts that share some of them.

Verification.  Every candidate pair is decided on full sets, in units of classes that candidates chain.  Pairs whose classes
a unit has joined already need no decision.  Units of more than `UNIT_ITEMS` n-grams are cut into blocks, and a pair goes to the unit
of its two blocks.  Of the rest no pairs come, but groups of chained components: all pairs of classes in different ones are decided there, by an inverted index of the unit's sets.
The texts aren't shuffled for this: a bit table of bounded size tells the tasks which rows are wanted, and these send their sets; a row that the table lets
through by chance finds no unit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import NOT_SPACE, blocks, shingles, text_bytes, words
from .components import connected_components
from .near_dedup import _by_unit, _digest, _exact_links, _numbered, _rest, _runs, _sorted_units
from .rowbits import SLICE, merged_slices, row_bits, rows_in
from .tables import forget, map_batches, row_key, store

COUNTERS = 1 << 20
SLOTS = 8
FINE = 128
SMALL = 16
LISTS = 6
LIST_ROWS = 2048
SHARED = 32
UNIT_ITEMS = 1 << 18


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a set of n that its prefix has: n - ceil(percent * n / 100) + 1, none of an empty set."""
    return np.where(n > 0, n - (-(-percent * n // 100)) + 1, 0)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        hashes, _, _, counts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_SPACE)
        yield a, shingles(hashes, counts, size)


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_sets(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, slice, counts): a row for each text, and at the end of each task its counters in slices (then only the last two are set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(COUNTERS, np.uint32), pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for a, sets in _sets(batch.column(2), size):
                n = len(sets)
                total += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
                nodes = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
                told = [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array([len(s) for s in sets], pa.int64()), nodes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(told, names=names)
        for k in range(0, COUNTERS, SLICE):
            part = total[k : k + SLICE]
            if part.any():
                nothing = [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([k // SLICE], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], names=names)

    names = ["doc_id", "row", "n_shingles", "node", "slice", "counts"]
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row binary, n_shingles long, node binary, slice int, counts binary")


def gram_counts(slices: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up; the driver gets COUNTERS numbers of 8 bytes."""
    return merged_slices(slices, COUNTERS, "<u8", np.add)


def _ranked(sets: list[np.ndarray], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all sets, rare first within each set; their number in each set)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    # sets come sorted by hash, so a stable sort by counter leaves ties in the order of their hashes
    return flat[np.argsort((owner << np.uint64(32)) | ranks[_counter(flat)], kind="stable")], sizes


def _slot(grams: np.ndarray, n: int = SLOTS) -> np.ndarray:
    return (grams >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _bytes(table: np.ndarray) -> pa.Array:
    """Rows of bytes as binaries."""
    n, width = table.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(table).tobytes())]).cast(pa.binary())


def prefixes(df: DataFrame, doc_id: str, text: str, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(node, size, prefix, slots, fine) of each text that has a set: its rarest n-grams in order, and how many of the set are in each range of hashes (fine: a byte each, larger numbers as the largest).

    A task tells a class once, as long as it remembers.
    """
    ranks = np.unique(counts, return_inverse=True)[1].astype("<u4")  # equal counts share a rank
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = pickle.loads(shared.value).astype(np.uint64)
        for batch in batches:
            for _, sets in _sets(batch.column(0), size):
                sets = [s for s in sets if len(s)]
                nodes = [_digest(s) for s in sets]
                once = list({node: i for i, node in enumerate(nodes)}.values())
                sets, nodes = [sets[i] for i in once], [nodes[i] for i in once]
                grams, sizes = _ranked(sets, rank)
                begins, head = np.cumsum(sizes) - sizes, prefix_length(sizes, percent)
                fine = np.bincount(np.repeat(np.arange(len(sets)), sizes) * FINE + _slot(grams, FINE), minlength=len(sets) * FINE).reshape(-1, FINE)
                slots = fine.reshape(len(sets), SLOTS, FINE // SLOTS).sum(axis=2)
                taken = np.arange(len(grams)) - np.repeat(begins, sizes) < np.repeat(head, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(head)).astype(np.int32)), pa.array(grams[taken].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SLOTS), pa.array(slots.astype(np.int32).ravel())),
                        _bytes(np.minimum(fine, 255).astype(np.uint8)),
                    ],
                    names=["node", "size", "prefix", "slots", "fine"],
                )

    return map_batches(df.select(F.col(f"`{text}`").alias("text")), run, "node binary, size long, prefix array<long>, slots array<int>, fine binary")


def postings(heads: DataFrame) -> DataFrame:
    """(gram, node, size, pos, behind): behind tells, for each range of hashes, how many n-grams follow the position; two bytes each, larger numbers as the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            grams = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            seen = np.zeros((len(grams), SLOTS), np.int64)
            seen[np.arange(len(grams)), _slot(grams.view(np.uint64))] = 1
            seen = np.cumsum(seen, axis=0)
            before = np.concatenate([np.zeros((1, SLOTS), np.int64), seen])[np.cumsum(lengths) - lengths]
            slots = batch.column("slots").flatten().to_numpy(zero_copy_only=False).reshape(-1, SLOTS)
            behind = np.minimum(slots[owner] - (seen - before[owner]), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams), batch.column("node").take(pa.array(owner)), batch.column("size").take(pa.array(owner)), pa.array(pos.astype(np.int32)), _bytes(behind.view(np.uint8).reshape(-1, 2 * SLOTS))],
                names=["gram", "node", "size", "pos", "behind"],
            )

    return map_batches(heads.select("node", "size", "prefix", "slots"), run, "gram long, node binary, size long, pos int, behind binary")


def passing(i: np.ndarray, j: np.ndarray, size: np.ndarray, pos: np.ndarray, behind: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of postings of one n-gram pass the length, positional and suffix filters."""
    a, b = size[i], size[j]
    need = percent * (a + b)
    ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * np.minimum(a - pos[i], b - pos[j]) >= need)
    left = np.flatnonzero(ok)
    x, y = behind[i[left]], behind[j[left]]
    enough = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)  # such counts are only known from below
    ok[left] = full | ((100 + percent) * (1 + enough) >= need[left])
    return ok


def fine_passing(i: np.ndarray, j: np.ndarray, size: np.ndarray, fine: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can overlap enough by their sets' counts in the fine ranges of hashes."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        x, y = fine[a], fine[b]
        full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
        out[at : at + (1 << 15)] = full | ((100 + percent) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= percent * (size[a] + size[b]))
    return out


def _postings_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, pos = (batch.column(k).to_numpy().astype(np.int64) for k in ("size", "pos"))
    return size, pos, np.frombuffer(b"".join(batch.column("behind").to_pylist()), dtype="<u2").reshape(-1, SLOTS)


def _candidates(units: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, of each unit's postings that pass the filters; units: (u0, u1, u2, size, pos, behind, node), sorted.

    All pairs of a unit of up to SMALL postings, and neighbours in longer ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in _by_unit(batches, 3):
            n, node = batch.num_rows, batch.column("node").to_pylist()
            size, pos, behind = _postings_of(batch)
            runs = np.array(_runs(batch, 3))
            long = runs[:, 1] - runs[:, 0]
            ends = np.repeat(runs[:, 1], long)
            reach = np.where(np.repeat(long, long) <= SMALL, ends, np.minimum(ends, np.arange(n) + 2))
            open_, step = np.arange(n), 0
            while len(open_):
                step += 1
                open_ = open_[open_ + step < reach[open_]]
                # by size, so once a partner is too large for one, so are those after it
                fits = 100 * size[open_] >= percent * size[open_ + step]
                pair = open_[passing(open_, open_ + step, size, pos, behind, percent)]
                found = {(min(x, y), max(x, y)) for x, y in ((node[k], node[k + step]) for k in pair.tolist()) if x != y}
                fresh = [p for p in found if p[0] + p[1] not in told]
                if len(told) > 1 << 16:
                    told.clear()
                told.update(x + y for x, y in fresh)
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.binary()), pa.array([p[1] for p in fresh], pa.binary())], names=["a", "b"])
                open_ = open_[fits]

    return map_batches(units.select("u0", "u1", "u2", "size", "pos", "behind", "node"), run, "a binary, b binary").distinct()


def _chains(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that chain the labels of each unit between whose postings a pair passes the filters; units: (u0, u1, u2, label, size, pos, behind, fine), sorted.

    A label has at most one edge a unit: to the label that most of its chain's postings have, so that units with the same groups tell the same edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in _by_unit(batches, 3):
            label = batch.column("label").to_pylist()
            size, pos, behind = _postings_of(batch)
            fine = np.frombuffer(b"".join(batch.column("fine").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
            for first, last in _runs(batch, 3):
                own = _numbered(label[first:last])
                part, chain = slice(first, last), chained_labels(own, size[first:last], pos[first:last], behind[first:last], fine[first:last], percent)
                names, times, hubs = label[part], np.bincount(own, minlength=last - first), {}
                for k in np.unique(own).tolist():
                    hub = hubs.setdefault(chain[k], k)
                    if (times[k], names[hub]) > (times[hub], names[k]):
                        hubs[chain[k]] = k
                edges = [(names[k], names[hubs[chain[k]]]) for k in np.unique(own).tolist() if hubs[chain[k]] != k]
                fresh = [e for e in edges if e[0] + e[1] not in told]
                if len(told) > 1 << 16:
                    told.clear()
                told.update(a + b for a, b in fresh)
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in fresh], pa.binary()), pa.array([b for _, b in fresh], pa.binary())], names=["a", "b"])

    return map_batches(units.select("u0", "u1", "u2", "label", "size", "pos", "behind", "fine"), run, "a binary, b binary")


def chained_labels(label: np.ndarray, size: np.ndarray, pos: np.ndarray, behind: np.ndarray, fine: np.ndarray, percent: int) -> np.ndarray:
    """Labels of one n-gram's postings, by size, after those have been joined between which a pair passes all filters."""
    label = label.copy()
    open_, step = np.arange(len(label)), 0
    while len(open_):
        step += 1
        open_ = open_[open_ + step < len(label)]
        open_ = open_[100 * size[open_] >= percent * size[open_ + step]]
        pair = open_[label[open_] != label[open_ + step]]
        if len(pair):
            pair = pair[passing(pair, pair + step, size, pos, behind, percent)]
            pair = pair[fine_passing(pair, pair + step, size, fine, percent)]
        for k in pair.tolist():
            if label[k] != label[k + step]:
                label[label == label[k + step]] = label[k]
    return label


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verified(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that chain the linked classes of each unit, as stars; units: (u0, u1, u2, b, node, items), sorted: sets have no b and come first, then pairs (node, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_unit(batches, 3):
            node, other, items = (batch.column(k).to_pylist() for k in ("node", "b", "items"))
            a, b = [], []
            for first, last in _runs(batch, 3):
                sets = {node[k]: np.frombuffer(items[k], dtype=np.uint64) for k in range(first, last) if other[k] is None}
                root: dict[bytes, bytes] = {}

                def find(x: bytes, root: dict[bytes, bytes] = root) -> bytes:
                    while x in root:
                        x = root[x]
                    return x

                for k in range(first, last):
                    if other[k] is None:
                        continue
                    x, y = find(node[k]), find(other[k])
                    if x == y:
                        continue
                    one, two = sets[node[k]], sets[other[k]]
                    both = overlap(one, two)
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        root[max(x, y)] = min(x, y)
                a += root
                b += map(find, root)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return map_batches(units.select("u0", "u1", "u2", "b", "node", "items"), run, "a binary, b binary")


def _sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items): the sets of the texts (row, text) whose rows are wanted (row), and of those that the bit table lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(row_bits(wanted))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(1).filter(rows_in(batch.column(0), shared.value)), size):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return map_batches(texts.select("row", "text"), to_sets, "node binary, items binary").groupBy("node").agg(F.first("items").alias("items"))


def verified_links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that chain all classes which the candidate pairs link truly; texts: (row, text), classes: (node, row, size)."""
    chained = store(classes.join(connected_components(pairs), "node").select("node", "row", "size", F.col("root").alias("group")))
    sizes = chained.groupBy("group").agg(F.ceil(F.sum("size") / UNIT_ITEMS).cast("int").alias("parts"))
    placed = chained.join(sizes, "group").select("node", F.xxhash64("group").alias("u0"), F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int").alias("own"))
    placed = store(placed)
    one, two = placed.select(F.col("node").alias("a"), "u0", F.col("own").alias("p")), placed.select(F.col("node").alias("b"), F.col("own").alias("q"))
    unit = [F.col("u0"), F.least("p", "q").alias("u1"), F.greatest("p", "q").alias("u2")]
    asked = store(pairs.join(one, "a").join(two, "b").select(*unit, F.col("a").alias("node"), "b"))
    wanted = asked.select("u0", "u1", "u2", "node").union(asked.select("u0", "u1", "u2", "b")).distinct()
    sets = wanted.join(_sets_of(texts, chained, size), "node").select("u0", "u1", "u2", F.lit(None).cast("binary").alias("b"), "node", "items")
    units = sets.unionByName(asked.withColumn("items", F.lit(None).cast("binary")))
    links = store(_verified(_sorted_units(units, "b", "node"), percent))
    forget(chained, placed, asked)
    return links


def links_between(chains: DataFrame, joined: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that chain all classes of different components (node, root) which are linked truly and whose components the edges of `chains` chain.

    No pair is told: a group's classes outside its largest component meet all others in units of two blocks, which hold sets only.
    """
    label = F.coalesce("root", "node").alias("label")
    groups = connected_components(chains).select(F.col("node").alias("label"), F.xxhash64("root").alias("u0"))
    members = store(classes.join(joined, "node", "left").select("node", "row", "size", label).join(groups, "label"))
    sizes = members.groupBy("u0", "label").agg(F.sum("size").alias("n")).groupBy("u0").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("big"))
    # small blocks spread a group over more tasks; in groups of many blocks larger ones save copies of the sets
    block = F.greatest(F.lit(max(1, UNIT_ITEMS // 4)), F.least(F.lit(UNIT_ITEMS), F.col("total") / 16))
    inside = F.ceil(F.col("big.n") / block).cast("int")
    outside = F.when(F.col("total") > block, F.ceil((F.col("total") - F.col("big.n")) / block)).otherwise(0).cast("int")  # none: the group is one unit
    placed = members.join(sizes.select("u0", inside.alias("p"), outside.alias("q"), F.col("big.label").alias("largest")), "u0")
    within, last, h = F.col("label") == F.col("largest"), F.col("p") + F.col("q") - 1, F.xxhash64("node")
    own = F.when(F.col("q") == 0, 0).when(within, F.pmod(h, F.col("p").cast("long"))).otherwise(F.col("p") + F.pmod(h, F.col("q").cast("long"))).cast("int")
    others = F.when(F.col("q") == 0, F.array(F.lit(0))).when(within, F.sequence("p", last)).otherwise(F.sequence(F.lit(0), last))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(others))
    placed = placed.select("u0", F.least("own", "other").alias("u1"), F.greatest("own", "other").alias("u2"), F.lit(True).alias("cut"), "label", "node")
    links = store(_exact_links(_sorted_units(placed.join(_sets_of(texts, members, size), "node"), "node"), percent).select("a", "b").distinct())
    forget(members)
    return links


def linked_classes(df: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, joined): rows (doc_id, row, n_shingles, node), node being null for an empty set, edges (a, b) that chain all linked classes, and these components (node, root)."""
    told = store(count_sets(df, doc_id, text, size))
    rows = told.where("slice is null").select("doc_id", "row", "n_shingles", "node")
    counts = gram_counts(told.where("slice is not null").select("slice", "counts"))
    classes = store(rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("size")))
    heads = prefixes(df, doc_id, text, size, percent, counts).groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "slots", "fine")])
    heads = store(heads)
    shared = store(heads.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    live = store(postings(heads).join(shared, "gram"))
    forget(shared)
    long = live.where(F.col("n") > SMALL)
    rarest = long.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("pos"))).where(F.col("nth") <= LISTS).drop("nth")
    first = live.where(F.col("n") <= SMALL).unionByName(rarest)
    parts = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int"))
    everywhere = (parts > 1) & (F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")) < SHARED)
    first = first.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0), parts - 1)).otherwise(own)))
    first = first.select(F.col("gram").alias("u0"), F.col("part").alias("u1"), F.lit(0).alias("u2"), "size", "pos", "behind", "node", F.xxhash64("node", "gram").alias("mixed"))
    pairs = store(_candidates(_sorted_units(first, "size", "mixed"), percent))
    texts = df.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    links = verified_links(pairs, texts, classes, size, percent)
    joined = connected_components(links)
    if not long.isEmpty():
        left = _rest(long.select(F.col("gram").alias("group"), "node", "size", "pos", "behind"), joined, LIST_ROWS).join(heads.select("node", "fine"), "node")
        chains = store(_chains(_sorted_units(left, "size", "node"), percent))
        if not chains.isEmpty():
            more = links_between(chains, joined, texts, classes, size, percent)
            links = links.union(more)
            # from stars, so in few steps
            joined = connected_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        forget(chains)
    forget(live, pairs, classes, heads)
    return rows, links, joined


def jaccard_components(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_links), a row for each row of the table.

    Two texts are linked where 100 * intersection >= percent * union of their sets of `size` words; component_id is the smallest doc_id that
    links reach; `class_links` tells how many edges the row's set has among those that chain the component (stars, within units).

    Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a null text, or one without words, has no n-grams and is linked with
    nothing; fewer words than `size` are one n-gram of the whole sequence; repeated rows are copies, each with its own row; ties in the ranking fall to
    the n-gram's hash; a null doc_id never is a component's id unless all of it are null; an empty table gives an empty one.  Other columns are not read.
    """
    rows, links, of = linked_classes(df, doc_id, text, size, percent)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("class_links"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    classes = store(classes.join(of, "node", "left").join(degree, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("class_links", F.lit(0)).alias("class_links")))
    ids = store(classes.groupBy("root").agg(F.min("least_id").alias("component_id")))
    ids = store(classes.join(ids, "root").select("node", "component_id", "class_links"))
    out = rows.join(ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_links", F.lit(0)).alias("class_links"))
