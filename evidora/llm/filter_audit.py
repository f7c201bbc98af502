"""How filters interact: what each order of them keeps, removes and duplicates, from one pass over the documents.

A document has a mask: the set of filters that it fails.  Grouped by part and mask the table shrinks to
at most 2^k counts a part, by sums that combine before they shuffle.  From there all is arithmetic on arrays of
2^k numbers a part:

* the subset-zeta transform gives, for every set of filters, how many documents fail none of them: what survives these
  filters, in whatever order they run.  It takes k rounds; round b adds to every mask with bit b the mask without it;
* a step of an order is the difference between two neighbouring sets: without and with its filter;
* the same arrays of marked documents (labels) tell how many of those a step loses.

No document is looked at twice, and no order costs more than its rows of the result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

#: More filters than these need orders of their own: 8! are 40,320 already.
ALL_ORDERS = 7
MOST_FILTERS = 16


def text_key(text: Column) -> Column:
    """A key of a whole text, equal for equal texts only; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def later_copies(rows: DataFrame, *, doc_id: str = "doc_id", key: str = "key", into: str = "later") -> DataFrame:
    """The rows with a column that tells whether another row with the same key has a smaller doc_id.

    A row without doc_id is no later copy of anything, and nothing is one of it; rows of the least doc_id of a key, also
    repeated ones, are none.  A key that many rows share is combined before the shuffle, and then rows meet their key's least
    row by key *and* doc_id, so a large group of copies is no large group in the join.  A column of that name is replaced.
    """
    own = fresh(rows, ["id", "key", "first"])
    first = rows.groupBy(F.col(f"`{key}`").alias(own["key"])).agg(F.min(f"`{doc_id}`").alias(own["id"])).withColumn(own["first"], F.lit(True))
    met = rows.join(first, (F.col(f"`{key}`") == F.col(own["key"])) & (F.col(f"`{doc_id}`") == F.col(own["id"])), "left")
    return met.withColumn(into, F.col(own["first"]).isNull() & F.col(f"`{doc_id}`").isNotNull()).drop(*own.values())


def mask_counts(df: DataFrame, fails: dict[str, Column], *, part: Column, marks: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, and a count for each mark): bit k of a mask is set if the k-th filter fails; a condition that is null doesn't fail."""
    own = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails.values())]
    mask = sum(own[1:], own[0])
    marked = {f"mark{k}": F.coalesce(c, F.lit(False)).cast("long") for k, c in enumerate((marks or {}).values())}
    rows = df.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), *[c.alias(n) for n, c in marked.items()])
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in marked])


def subset_survivors(counts: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """(part, and for each name two arrays of 2^k): `<name>_only`, the counts by mask, and `<name>_left`, what fails none of a set of filters, by set."""
    full = (1 << k) - 1
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("cells")
    out = counts.groupBy("part").agg(cells)
    every = F.sequence(F.lit(0), F.lit(full))

    def by_mask(n: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("cells", m)[n], F.lit(0).cast("long")))

    def with_bit(n: str, bit: int) -> Column:
        have = F.col(f"{n}_left")
        return F.transform(have, lambda x, m: x + F.when(F.getbit(m, F.lit(bit)) == 1, F.get(have, m - (1 << bit))).otherwise(F.lit(0).cast("long")))

    out = out.select("part", *[by_mask(n).alias(f"{n}_only") for n in names])
    out = out.select("*", *[F.col(f"{n}_only").alias(f"{n}_left") for n in names])
    for bit in range(k):  # after round b a mask has the sum of all masks that differ from it by lacking some of the bits up to b
        for n in names:
            out = out.withColumn(f"{n}_left", with_bit(n, bit))
    for n in names:  # those that fail only filters outside a set survive it: the sum at the set's complement, which stands at the other end
        out = out.withColumn(f"{n}_left", F.reverse(f"{n}_left"))
    return out


def audit(df: DataFrame, fails: dict[str, Column], *, part: Column, marks: dict[str, Column] | None = None, orders: Sequence[Sequence[str]] | None = None, between: str = "") -> DataFrame:
    """What every order of the filters does, for each part: a row for each (part, filter_order, step).

    `fails` names the filters and says when a row fails each; `orders` are those looked at (all permutations by default);
    `marks` are kinds of rows whose losses are counted apart.  Columns: part, filter_order (the names joined by `between`), step (from 1), filter,
    kept (after the step), removed (by it), redundant (rows that fail the filter but were removed before), unique_fails (rows that fail this filter
    only), `<mark>_lost` for each mark, and shapley: the filter's removed rows, summed over all orders.

    Defined results: a null part is the empty one; a null condition is no failure and a null mark no mark; repeated rows count each; an empty
    table has no parts and so no rows; columns of the table are never looked at but by the expressions given.
    """
    names, k, marks = list(fails), len(fails), marks or {}
    if not 1 <= k <= MOST_FILTERS or orders is None and k > ALL_ORDERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters, and orders of your own beyond {ALL_ORDERS}")
    places = [[names.index(x) for x in o] for o in (permutations(names) if orders is None else orders)]
    if any(len(set(o)) != len(o) for o in places):
        raise ValueError("an order names a filter twice")
    weights = [0] * (k << k)  # how often a filter comes right after a set of others
    for o in places:
        before = 0
        for f in o:
            weights[(f << k) + before] += 1
            before |= 1 << f
    counted = ["n", *[f"mark{i}" for i in range(len(marks))]]
    arrays = subset_survivors(mask_counts(df, fails, part=part, marks=marks), k, counted)
    weight = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    shapley = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda f: F.aggregate(
            F.sequence(F.lit(0), F.lit((1 << k) - 1)),
            F.lit(0).cast("long"),
            lambda total, s: total + F.get(weight, f * (1 << k) + s) * (F.get("n_left", s) - F.get("n_left", s.bitwiseOR(F.pow(F.lit(2), f).cast("int")))),
        ),
    )
    rows = arrays.withColumn("shapleys", shapley).withColumn("order", F.explode(F.from_json(F.lit(json.dumps(places)), "array<array<int>>")))
    rows = rows.select("*", F.posexplode("order").alias("done", "f"))
    bit = F.expr("shiftleft(1, f)")
    rows = rows.withColumn("before", F.expr("aggregate(slice(order, 1, done), 0, (set, x) -> set | shiftleft(1, x))")).withColumn("after", F.col("before").bitwiseOR(bit))
    named = F.from_json(F.lit(json.dumps(names)), "array<string>")
    lost = lambda n: F.get(f"{n}_left", F.col("before")) - F.get(f"{n}_left", F.col("after"))
    fail = F.get("n_left", F.lit(0)) - F.get("n_left", bit)
    return rows.select(
        "part",
        F.array_join(F.transform("order", lambda x: F.get(named, x)), between).alias("filter_order"),
        (F.col("done") + 1).alias("step"),
        F.get(named, F.col("f")).alias("filter"),
        F.get("n_left", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (fail - lost("n")).alias("redundant"),
        F.get("n_only", bit).alias("unique_fails"),
        *[lost(f"mark{i}").alias(f"{name}_lost") for i, name in enumerate(marks)],
        F.get("shapleys", F.col("f")).alias("shapley"),
    )
