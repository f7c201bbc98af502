"""MinHash near-duplicate detection with an LSH forest.

A text's set is its distinct word shingles.  Texts with the same set form one
class, known by the set's 128-bit digest, and only classes are compared.

The forest.  Each of `TREES` trees has a signature for every class: a row of
min-hashes.  A *region* of a tree are the classes whose signatures have a common prefix of at least
`least` values, found by grouping on the prefix: two classes at the threshold have no common region in any tree with a
probability below `MISS`.  Within a region classes stand in the order of their signatures, which decides what is compared first, not what is compared.

Candidates.  A region of up to `REGION_ROWS` classes is read as it is; in a larger one
the depth grows, a value at a time, until its parts are small enough or the
signatures end (those are then read in blocks).  In such a part, neighbours in the
sorted order are compared first, then all pairs that these links have not joined already,
by their sketches.  The rest, which are pairs of a large region in different parts, is exact
too: where all its classes are joined by now nothing is left; else the classes outside
its largest component are compared with all others, in blocks.

Confirmation.  Groups of classes that candidate links chain are decided on full sets.
A group of more than `GROUP_ROWS` sets is read in blocks that share `PIVOTS` of its sets, which joins
near copies of one text; sets outside the group's largest component are then compared
with all others, in blocks.  So every pair of a group is decided, and a task returns a spanning
forest of the links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, blocks, constants, shingles, text_bytes, words
from .components import connected_components
from .tables import fresh, map_batches, row_key, settle, spread

MISS = 1e-4
TREES = 20
DEEPER = 4
REGION_ROWS = 2048
GROUP_ROWS = 1024
PIVOTS = 64


def forest_shape(percent: int) -> tuple[int, int, int]:
    """(trees, least, deepest): `least` is the most values at which a pair at the threshold is missed with a probability below MISS."""
    s = percent / 100
    least = max(d for d in range(1, 17) if d == 1 or (1 - s**d) ** TREES <= MISS)
    return TREES, least, least + DEEPER


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n 32-bit min-hashes of each set (of none: zeros)."""
    out = np.zeros((len(sets), n), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    flat = np.concatenate([sets[i] for i in some])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    factors = constants(n, 31)
    work = np.empty_like(low)
    for k in range(n):
        np.multiply(high, np.uint32(factors[k] >> np.uint64(32)) | np.uint32(1), out=work)
        work += low * np.uint32(factors[k] & np.uint64(0xFFFFFFFF))
        work ^= work >> np.uint32(15)
        work *= np.uint32(0x2C1B3C6D)
        out[some, k] = np.minimum.reduceat(work, starts)
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets):
        hashes, _, _, counts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_SPACE)
        yield a, shingles(hashes, counts, size)


def _digest(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, trees, sketch): node is the set's digest, null for an empty set.

    A tree's signature has 16 bits of each of its min-hashes, in big-endian order, so that it sorts as bytes; the sketch has other 8 bits of the leading ones.
    """
    trees, least, deepest = forest_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in _sets(batch.column(2), size):
                n = len(sets)
                values = minhashes(sets, trees * deepest).reshape(n, trees, deepest)
                signs = (values >> np.uint32(16)).astype(">u2")
                sketch = values[:, :, :least].astype(np.uint8).reshape(n, trees * least)
                flat = pa.array([signs[i, k].tobytes() for i in range(n) for k in range(trees)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(1).slice(a, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), flat),
                        pa.array([sketch[i].tobytes() if len(sets[i]) else None for i in range(n)], pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "node", "trees", "sketch"],
                )

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, row binary, n_shingles long, node binary, trees array<binary>, sketch binary")


def _by_unit(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Whole runs of equal keys (the first columns), of rows sorted by them; many small runs come at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        last = tuple(table.column(k)[-1].as_py() for k in range(n_keys))
        same = np.ones(table.num_rows, dtype=bool)
        for k in range(n_keys):
            same &= table.column(k).to_numpy() == last[k]
        first = int(np.argmax(same))
        if first:
            yield from table.slice(0, first).combine_chunks().to_batches()
        held = table.slice(first).to_batches()
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else ()


def _runs(batch: pa.RecordBatch, n_keys: int) -> list[tuple[int, int]]:
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for k in range(n_keys):
        x = batch.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(change)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]))


def _sorted_units(rows: DataFrame, *order: str) -> DataFrame:
    """Rows (u0, u1, u2, ...) with whole units in one partition, one after another."""
    return spread(rows, "u0", "u1", "u2").sortWithinPartitions("u0", "u1", "u2", *order)


def _rest(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Units for what is left of the groups (group, node, ...): classes outside a group's largest component, with all others of the group.

    `labels` has the components so far as (node, root).  A group that is one component is left out.
    """
    marked = settle(rows.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    counts = marked.groupBy("group", "label").agg(F.count("*").alias("n"))
    big = counts.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max(F.struct("n", "label")).alias("big")).where("kinds > 1")
    big = settle(big.select("group", F.ceil(F.col("big.n") / most).cast("int").alias("p"), F.ceil((F.col("total") - F.col("big.n")) / most).cast("int").alias("q"), F.col("big.label").alias("largest")))
    cut = marked.join(big, "group")
    inside, h = F.col("label") == F.col("largest"), F.xxhash64("node")
    own = F.when(inside, F.pmod(h, F.col("p").cast("long"))).otherwise(F.col("p") + F.pmod(h, F.col("q").cast("long"))).cast("int")
    last = F.col("p") + F.col("q") - 1
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.when(inside, F.sequence("p", last)).otherwise(F.sequence(F.lit(0), last))))
    kept = [c for c in marked.columns if c != "group"]
    return cut.select(F.col("group").alias("u0"), F.least("own", "other").alias("u1"), F.greatest("own", "other").alias("u2"), *kept)


def _numbered(labels: list[bytes]) -> np.ndarray:
    """Each label as the first place where it occurs."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(x, i) for i, x in enumerate(labels)], np.int64)


def _stars(nodes: list[bytes], labels: np.ndarray, before: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
    """An edge from each node to the first of its label; with labels from before, one for each of those."""
    heads: dict[int, bytes] = {}
    a, b = [], []
    for i, (node, label) in enumerate(zip(nodes, labels.tolist())):
        head = heads.setdefault(label, node)
        if head != node and (before is None or before[i] == i):
            a.append(node)
            b.append(head)
    return a, b


def _join(labels: np.ndarray, i: int, near: np.ndarray) -> None:
    """Give i, those near it, and all that are joined with them one label."""
    old = np.unique(np.append(labels[near], labels[i]))
    if len(old) > 1:
        labels[np.isin(labels, old)] = old[0]


def sketch_labels(sketch: np.ndarray, needed: int, labels: np.ndarray) -> np.ndarray:
    """Labels of the components under near sketches of rows in signature order, starting from given ones.

    Neighbours in the order come first; then a row is compared with those that have another label.
    """
    labels = labels.copy()
    for i in np.flatnonzero((sketch[1:] == sketch[:-1]).sum(axis=1) >= needed).tolist():
        _join(labels, i, np.array([i + 1]))
    for i in range(len(sketch) - 1):
        rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if len(rest):
            _join(labels, i, rest[(sketch[rest] == sketch[i]).sum(axis=1) >= needed])
    return labels


def _near_links(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that chain the classes of each unit whose sketches are near; units: (u0, u1, u2, label, sketch, node), sorted."""
    trees, least, _ = forest_shape(percent)
    s, m = percent / 100, trees * least
    needed = int(m * (s - 5 * sqrt(s * (1 - s) / m)))  # five standard deviations below the threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_unit(batches, 3):
            nodes, label = batch.column("node").to_pylist(), batch.column("label").to_pylist()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, m)
            a, b = [], []
            for first, last in _runs(batch, 3):
                if last - first < 2:
                    continue
                own = sketch[first:last]
                if last - first == 2:
                    if int((own[0] == own[1]).sum()) >= needed and nodes[first] != nodes[first + 1]:
                        a.append(nodes[first])
                        b.append(nodes[first + 1])
                    continue
                before = _numbered(label[first:last])
                x, y = _stars(nodes[first:last], sketch_labels(own, needed, before), before)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return map_batches(units.select("u0", "u1", "u2", "label", "sketch", "node"), run, "a binary, b binary")


def _prefix(depth: int) -> Column:
    """The region of a tree at a depth."""
    return F.xxhash64("tree", F.substring("sign", 1, 2 * depth), F.lit(depth))


def candidate_groups(classes: DataFrame, percent: int) -> DataFrame:
    """(node, root): classes chained by candidate links, for those that have any."""
    _, least, deepest = forest_shape(percent)
    rows = classes.select("node", "sketch", F.posexplode("trees").alias("tree", "sign")).withColumn("group", _prefix(least))
    sizes = settle(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = sizes.where(F.col("n") > REGION_ROWS).select("group")
    zero = F.lit(0)
    unit = [F.lit(0).alias("u1"), F.lit(0).alias("u2"), "sign", F.col("node").alias("label"), "sketch", "node"]
    units = rows.join(sizes.where(F.col("n") <= REGION_ROWS).select("group"), "group").select(F.col("group").alias("u0"), *unit)
    if crowded.isEmpty():
        return connected_components(_near_links(_sorted_units(units, "sign", "node"), percent).distinct())
    large = settle(rows.join(crowded, "group").select("node", "sketch", "tree", "sign", "group"))
    now = large
    for depth in range(least + 1, deepest + 1):
        now = now.withColumn("u0", _prefix(depth))
        parts = settle(now.groupBy("u0").agg(F.count("*").alias("n")))
        now = now.join(parts, "u0")
        fits = F.col("n") <= REGION_ROWS
        units = units.union(now.where(fits).select("u0", *unit))
        now = settle(now.where(~fits).drop("u0" if depth < deepest else "n", "n" if depth < deepest else "tree"))
    blocks_of = now.join(parts, "u0").withColumn("u1", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / REGION_ROWS)).cast("int"))
    units = units.union(blocks_of.select("u0", "u1", zero.alias("u2"), "sign", F.col("node").alias("label"), "sketch", "node"))
    links = settle(_near_links(_sorted_units(units, "sign", "node"), percent).distinct())
    joined = connected_components(links)
    more = settle(_near_links(_sorted_units(_rest(large.select("group", "node", "sketch", "sign"), joined, REGION_ROWS), "sign", "node"), percent).distinct())
    return joined if more.isEmpty() else connected_components(links.union(more))


def exact_labels(sets: list[np.ndarray], percent: int, before: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components under 100 * |A & B| >= percent * |A | B|; the smallest index of each.

    Every pair is decided.  A row of intersection sizes comes from an inverted
    index.  Rows are made for pivots first; then a pair can only be missing
    between two members of different components, neither of them a pivot, so
    rows are made for the members of all components but the largest.  With labels
    from `before`, what has one label is joined already and there are no pivots.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, item, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[item] > 1  # what only one set has can't be in an intersection
    item, owner = item[shared], owner[shared]
    order = np.argsort(item, kind="stable")
    lists, ends = owner[order], np.append(0, np.cumsum(np.bincount(item, minlength=len(times))))
    mine = np.split(item, np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else []
    labels = np.arange(n) if before is None else before.copy()

    def row(i: int) -> None:
        parts = [lists[ends[k] : ends[k + 1]] for k in mine[i].tolist()]
        if not parts:
            return
        both = np.bincount(np.concatenate(parts), minlength=n)
        near = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
        if len(near):  # without what only i has, i may not be near itself
            _join(labels, i, near)

    pivot = np.zeros(n, dtype=bool)
    covered = np.full(n, before is not None)
    for i in range(n):
        if not covered[i]:
            pivot[i] = True
            row(i)
            covered |= labels == labels[i]
    rest = np.flatnonzero(~pivot)
    if len(rest):
        count = np.bincount(labels[rest], minlength=n)
        largest = int(np.argmax(count))
        for i in rest.tolist():
            if labels[i] != labels[largest]:
                row(i)
    return labels


def _exact_links(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, cut) of a spanning forest of the true links in each unit; units: (u0, u1, u2, cut, label, node, items), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_unit(batches, 3):
            nodes, cut, label = (batch.column(k).to_pylist() for k in ("node", "cut", "label"))
            items = batch.column("items").to_pylist()
            a, b, c = [], [], []
            for first, last in _runs(batch, 3):
                before = _numbered(label[first:last])
                alone = bool((before == np.arange(last - first)).all())
                labels = exact_labels([np.frombuffer(x, dtype=np.uint64) for x in items[first:last]], percent, None if alone else before)
                x, y = _stars(nodes[first:last], labels, before)
                a += x
                b += y
                c += [cut[first]] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.bool_())], names=["a", "b", "cut"])

    return map_batches(units.select("u0", "u1", "u2", "cut", "label", "node", "items"), run, "a binary, b binary, cut boolean")


def confirmed_groups(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) under the true links in each group, for classes that have any; groups: (group, text)."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in _sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["group", "node", "items"])

    kind = groups.schema["group"].dataType.simpleString()
    sets = map_batches(groups.select("group", "text"), to_sets, f"group {kind}, node binary, items binary")
    sets = settle(sets.withColumn("group", F.xxhash64("group")))
    sizes = settle(sets.groupBy("group").agg(F.count("*").alias("n")))
    sized = sets.join(sizes, "group").withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS).cast("int"))
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < PIVOTS)
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    part = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    units = sized.withColumn("part", part).select(F.col("group").alias("u0"), F.col("part").alias("u1"), F.lit(0).alias("u2"), (F.col("parts") > 1).alias("cut"), F.col("node").alias("label"), "node", "items")
    links = settle(_exact_links(_sorted_units(units, "node", "items"), percent))
    whole = links.where("not cut").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = sizes.where(F.col("n") > GROUP_ROWS).select("group")
    if large.isEmpty():
        return whole.distinct()
    cut = links.where("cut").select("a", "b")
    joined = connected_components(cut)
    left = _rest(sets.join(large, "group"), joined, GROUP_ROWS).withColumn("cut", F.lit(True))
    more = settle(_exact_links(_sorted_units(left, "node", "items"), percent).select("a", "b"))
    return whole.union(joined if more.isEmpty() else connected_components(cut.union(more))).distinct()


def _decided(df: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, root, component_id) of each row; node and root are null for an empty set."""
    marked = settle(signatures(df, doc_id, text, size, percent))
    some = marked.where("node is not null")
    classes = some.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("trees").alias("trees"), F.first("sketch").alias("sketch"), F.min("row").alias("row"))
    classes = settle(classes)
    marked = marked.select("doc_id", "row", "n_shingles", "node")
    chained = candidate_groups(classes, percent)
    members = classes.select("node", "row").join(chained, "node").select("row", F.col("root").alias("group"))
    texts = df.select(row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text"))
    linked = confirmed_groups(texts.join(members, "row").select("group", "text"), size, percent)
    classes = classes.select("node", "least_id").join(linked, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    # tables on both sides of the joins, so that a large component can be split
    classes = settle(classes)
    ids = settle(classes.groupBy("root").agg(F.min("least_id").alias("component_id")))
    ids = settle(classes.join(ids, "root").select("node", "root", "component_id"))
    return marked.join(ids, "node", "left")


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of the table.

    Texts are linked where 100 * intersection >= percent * union of their word
    shingle sets; component_id is the smallest doc_id of those reachable.

    Defined results: a null text, or one without words, has no shingles and is
    linked with nothing; fewer words than `size` make one shingle of the whole
    sequence; repeated rows are copies, each with its own row in the result; a
    null doc_id never is a component's id unless all of it are null (then kept is
    true); an empty table gives an empty one.
    """
    out = _decided(df, doc_id, text, size, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The table with one row of each component, that of the smallest doc_id; of repeated rows one stays.

    Rows whose text has no words stay, as they are linked with nothing.
    """
    own = fresh(df, ["row", "copies"])
    found = settle(_decided(df, doc_id, text, size, percent).select("doc_id", "row", "node", "root"))
    copies = found.groupBy("root", "row").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "copies")).alias("first")
    kept = copies.where("root is not null").groupBy("root").agg(first).select("first.row", "first.copies")
    kept = kept.union(copies.where("root is null").select("row", F.lit(1).cast("long")))  # all rows of such texts stay
    keyed = df.withColumn(own["row"], row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    out = spread(keyed, own["row"]).join(kept.toDF(own["row"], own["copies"]), own["row"])
    single, repeated = out.where(f"{own['copies']} = 1"), out.where(f"{own['copies']} > 1").dropDuplicates([own["row"]])
    return single.select(df.columns).union(repeated.select(df.columns))
