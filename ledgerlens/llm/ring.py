"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring.  A key belongs to the arc
that its hash falls on; the arc names all shards in clockwise order.  Keys are
admitted in the order of a second hash, their ticket: each takes the first shard
of its arc that is not full, so what overflows goes on clockwise.  A shard's
capacity is a bound on its rows; with no slack the capacities add up to the
number of rows, so counts differ by one at most.

That admission is sequential only in name.  Between two moments at which a
shard becomes full, every key's shard depends on its arc alone.  So the ring is
described by at most one ticket a shard (the last it admits), found from counts
by arc and ticket range; a range that holds such a ticket is counted again more
finely until at most ``settle`` keys remain, which are admitted one by one on
the driver.  Then each row finds its shard by itself.  No text is shuffled, no
shard or key gathers in one task.

A ticket comes from the id, the text and a number among equal rows, so that
another layout of the same rows deals them alike, and a third of all rows with one
id and text are spread like others.  Equal rows are numbered inside their partition,
from the count of those in partitions before it.  Slots number the rows
of a shard in ticket order, without gaps: ticket ranges are counted, and rows
are numbered inside a range.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id is a key
like any other; repeated rows get slots of their own; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

BITS = 60  # of a ticket
FIRST_BITS = 8  # of a count by ticket range


class Ring:
    """Points of all shards; arcs are numbered by the point that ends them."""

    def __init__(self, shards: int, virtual_nodes: int):
        points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> 1, s) for s in range(shards) for v in range(virtual_nodes))
        self.points = [p for p, _ in points]
        owners = [s for _, s in points]
        self.order = []  # shards of each arc, clockwise
        for i in range(len(owners)):
            seen: dict[int, None] = {}
            for s in [*owners[i:], *owners[:i]]:
                seen.setdefault(s)
                if len(seen) == shards:
                    break
            self.order.append(list(seen))

    def arc(self, position: Column) -> Column:
        """Number of the first point at or after a 63-bit position (the ring is closed)."""
        at = np.array(self.points, np.int64)

        def find(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at, x.to_numpy(np.int64)) % len(at))

        return F.pandas_udf(find, "int")(position)


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: equal shares, at most one apart, with ``slack`` more of each."""
    return [math.ceil((n // shards + (s < n % shards)) * (1 + slack)) for s in range(shards)]


def _assign(ring: Ring, full: set[int]) -> list[int]:
    return [next(s for s in order if s not in full) for order in ring.order]


def fill(keys: DataFrame, ring: Ring, bound: list[int], settle: int) -> list[tuple[int, int, int]]:
    """(ticket, place, shard) of the last key that each shard admits before it is full, in that order.

    ``keys`` has (arc, ticket, place); (ticket, place) is the order of admission.
    """
    left, events = list(bound), []
    full = {s for s, c in enumerate(bound) if c == 0}
    def counted(prefix: int, below: int) -> list[tuple[int, int, dict[int, int]]]:
        step = min(FIRST_BITS, below)
        rows = keys.where(F.shiftright("ticket", below) == prefix).groupBy(F.shiftright("ticket", below - step).alias("p"), "arc").agg(F.count(F.lit(1)).alias("n")).collect()
        ranges: dict[int, dict[int, int]] = {}
        for r in rows:
            ranges.setdefault(r["p"], {})[r["arc"]] = r["n"]
        return [(p, below - step, ranges[p]) for p in sorted(ranges)]

    stack = counted(0, BITS)[::-1]  # ticket ranges still to admit, as (prefix, bits below it, rows by arc)
    while stack:
        prefix, below, counts = stack.pop()
        if len(full) == len(bound):
            break
        target = _assign(ring, full)
        load = [0] * len(bound)
        for arc, n in counts.items():
            load[target[arc]] += n
        if all(load[s] < left[s] or load[s] == 0 for s in range(len(bound))):
            left = [a - b for a, b in zip(left, load)]
            continue
        if sum(counts.values()) > settle and below > 0:
            stack += counted(prefix, below)[::-1]
            continue
        rows = keys.where(F.shiftright("ticket", below) == prefix).select("ticket", "place", "arc").collect()
        for r in sorted(rows):
            if len(full) == len(bound):
                break
            s = target[r["arc"]]
            left[s] -= 1
            if left[s] == 0:
                events.append((r["ticket"], r["place"], s))
                full.add(s)
                if len(full) < len(bound):
                    target = _assign(ring, full)
    return events


def shard_of(ring: Ring, bound: list[int], events: list[tuple[int, int, int]]) -> Column:
    """The shard of a row from its arc and its (ticket, place)."""
    phases, full = [], {s for s, c in enumerate(bound) if c == 0}
    for ticket, place, s in events:
        phases.append((ticket, place, list(_assign(ring, full))))
        full = full | {s}
    last = _assign(ring, full) if len(full) < len(bound) else phases[-1][2]
    pick = lambda table: F.element_at(F.array(*map(F.lit, table)), F.col("arc") + 1)
    chosen = pick(last)
    for ticket, place, table in reversed(phases):
        chosen = F.when((F.col("ticket") < ticket) | ((F.col("ticket") == ticket) & (F.col("place") <= place)), pick(table)).otherwise(chosen)
    return chosen.cast("int")


def with_slots(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, by (ticket, place).

    Rows are counted by ticket range (at most 4,096 of them), and each range is
    numbered from the total of those before it.  Tickets are hashes, so ranges
    and the sorts inside them are even.
    """
    bits = min(12, max(0, math.ceil(math.log2(max(1, n) / 20_000))))
    rows = rows.withColumn("part", F.shiftright("ticket", BITS - bits))
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows_here"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("part", "shard").orderBy("ticket", "place"))
    return rows.withColumn("nth", nth).join(F.broadcast(offsets), ["part", "shard"]).withColumn("slot", (F.col("offset") + F.col("nth") - 1).cast("long")).drop("part", "nth", "offset")


def ticketed(rows: DataFrame) -> DataFrame:
    """Adds ``ticket``: a hash of the id, the text and the number among equal rows."""
    rows = written(rows.withColumn("pid", F.shiftright("place", 33)))
    same = ["id", "text_hash", "pid"]
    nth = F.row_number().over(W.partitionBy(*same).orderBy("place")) - 1
    before = F.sum("here").over(W.partitionBy("id", "text_hash").orderBy("pid").rowsBetween(W.unboundedPreceding, -1))
    counts = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("here")).select(*same, F.coalesce(before, F.lit(0)).alias("before"))
    counts = written(counts.where("before > 0"))  # only rows that equal others in earlier partitions
    both = rows.withColumn("nth", nth).alias("l").join(counts.alias("r"), F.expr("l.id <=> r.id AND l.text_hash = r.text_hash AND l.pid = r.pid"), "left")
    number = (F.col("nth") + F.coalesce("before", F.lit(0))).cast("long")
    return both.select("l.*", number.alias("number")).withColumn("ticket", F.shiftrightunsigned(F.xxhash64("id", "text_hash", "number"), 64 - BITS)).drop("nth", "number", "pid", "text_hash")


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", virtual_nodes: int = 32, slack: float = 0.0, settle: int = 20_000) -> DataFrame:
    """One row per document: (key, size, text_crc32, shard, slot); no shard has more rows than its capacity."""
    ring = Ring(shards, virtual_nodes)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(text)).alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    keys = written(ticketed(rows).withColumn("arc", ring.arc(F.shiftrightunsigned(F.xxhash64("id"), 1))))
    n = keys.count()
    bound = capacities(n, shards, slack)
    events = fill(keys.select("arc", "ticket", "place"), ring, bound, settle)
    placed = keys.withColumn("shard", shard_of(ring, bound, events)) if n else keys.withColumn("shard", F.lit(0))
    return with_slots(placed, n).select(F.col("id").alias(key), "size", "text_crc32", "shard", "slot")
