"""Repeated passages and near-duplicate paragraphs by MinHash banding.

Two kinds of paragraphs are sketched.  Lines of more than ``MIN_WORDS`` words
take MinHash signatures of their five-word shingles; bands are tuned for recall
at the wanted Jaccard similarity, lines that collide in a band are candidates,
candidates are verified by exact Jaccard on their shingle sets, and verified
links are clustered by components.  Passages that stand inside other text have
no paragraph borders, so every run of words is a paragraph too: of each
``REACH`` consecutive windows of ``WINDOW`` words the one with the least hash is
kept.  Equal passages keep equal windows, so a passage of ``WINDOW + REACH - 1``
= 50 words or more that repeats is always found, and windows match exactly.  The
kept windows of a repeat leave up to ``REACH - 1`` words at either end: there the
windows grow word by word as long as another document has the same words, so
that spans hold the whole repeat.  Each grown run has a keeper of its own, the
first of the documents known to hold that run, and what a document loses stands in the keeper.

Of every class the first document keeps its text; the others list the spans to
remove.  Result rows are (document, keeper) pairs with spans.

Scale: equal paragraphs and windows are one node, however many documents hold
them; band keys are counted before any row is joined back; a band of many lines
gives one edge a line.  A candidate class is verified in groups of at most
``group_bound`` lines (pairs of blocks beyond that, so no pair is lost), and inside
a group only lines outside the largest component are compared with all others.
Only windows at the end of a run of windows with one keeper are grown: the words
beside them (32-bit hashes) are sorted over all tasks by ranges, and a row shares
most words with the nearest row of another document before or after it; texts of documents with such
windows are read again, by broadcast up to ``broadcast_places`` places and by a
shuffle beyond that.

Defined cases: null, blank and short texts have no paragraphs; a text equal to
another is one long passage; repeats inside one document only are not reported;
repeated rows and ids are documents of their own; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import components, steady, written

MIN_WORDS = 50
WINDOW, REACH = 30, 21
SHINGLE = 5
SIMILARITY, RECALL, ROWS = 0.8, 0.9995, 4
BLOCK = 8192  # lines hashed together
SORTED = 100_000  # rows beside windows that one task sorts
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def tune_bands(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` that miss a pair at ``similarity`` with probability at most ``1 - recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


BANDS = tune_bands(SIMILARITY, RECALL, ROWS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    size = len(h) - n + 1
    if size <= 0:
        return h[:0]
    out, done = np.zeros(size, np.uint64), 0
    power, width = h, 1
    while width <= n:
        if n & width:
            out = out * BASE ** np.uint64(width) + power[done:done + size]
            done += width
        if 2 * width <= n:
            power = power[:-width] * BASE ** np.uint64(width) + power[width:]
        width *= 2
    return mix(out)


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``n`` neighbours."""
    pick, width = (np.minimum if least else np.maximum), 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:len(x) - (n - width)], x[n - width:]) if n > width else x


def kept_windows(x: np.ndarray) -> np.ndarray:
    """Positions of the least of each ``REACH`` neighbours; of equal neighbours one in ``REACH``."""
    if len(x) < REACH:
        return np.zeros(0, np.int64)
    low = _slide(x, REACH, True)
    edge = np.zeros(REACH - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), REACH, False) == x)
    head = np.concatenate([[True], (x[at[1:]] != x[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    since = at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    return at[since % REACH == 0]


def band_keys(shingles: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys of many shingle lists, one row each: all lists are hashed together, seed by seed."""
    sizes = np.array([len(x) for x in shingles])
    starts, every = np.cumsum(sizes) - sizes, np.concatenate(shingles)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * BASE)
    keys = np.empty((len(shingles), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(shingles), band + 1, np.uint64)
        for seed in seeds[band * rows:(band + 1) * rows]:
            key = mix(key * BASE + np.minimum.reduceat((every ^ seed) * (seed | np.uint64(1)), starts))
        keys[:, band] = key
    return keys


_OUT = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])
_DDL = "kind string, node long, rid long, pos int, start int, stop int, keys array<long>, shingles binary"


def places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes offsets of words (start, stop), the line of each word, and code points before each byte."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return edge[::2], edge[1::2], np.cumsum(raw == 10)[np.minimum(edge[::2], max(0, len(raw) - 1))] if len(raw) else edge[::2], points


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) -> kept windows ('window'), long lines ('line'), and once a batch each line's keys and shingles ('content')."""
    cache = _Words()
    for batch in batches:
        found: list[tuple[str, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]] = []
        contents: dict[int, np.ndarray] = {}
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = (text or b"").lower().split()
            if len(words) < MIN_WORDS:
                continue
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
            start, stop, line, points = places(text)
            x = runs_of(h, WINDOW)
            at = kept_windows(x)
            found.append(("window", x[at], rid, points[start[at]], points[stop[at + WINDOW - 1]], at))
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            nodes, a, b = [], [], []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(h)]):
                if j - i > MIN_WORDS:
                    node = xxhash.xxh64_intdigest(h[i:j].tobytes())
                    nodes.append(node)
                    a.append(points[start[i]])
                    b.append(points[stop[j - 1]])
                    if node not in contents:
                        contents[node] = runs_of(h[i:j], SHINGLE)
            if nodes:
                found.append(("line", np.array(nodes, np.uint64), rid, np.array(a), np.array(b), np.zeros(len(a))))
        if not found:
            continue
        sizes = [len(f[1]) for f in found]
        n = sum(sizes)
        blank = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())
        join = lambda i, t: np.concatenate([f[i] for f in found]).astype(t)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([f[0] for f in found], sizes), pa.string()), pa.array(join(1, np.uint64).view(np.int64)), pa.array(np.repeat([f[2] for f in found], sizes), pa.int64()),
            pa.array(join(5, np.int32)), pa.array(join(3, np.int32)), pa.array(join(4, np.int32)), *blank], schema=_OUT)
        lines = list(contents.items())
        for k in range(0, len(lines), BLOCK):
            part = lines[k:k + BLOCK]
            n, keys = len(part), band_keys([x for _, x in part], BANDS, ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.array(["content"] * n), pa.array(np.array([node for node, _ in part], np.uint64).view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([np.unique(x.astype(np.uint32)).tobytes() for _, x in part], pa.binary())], schema=_OUT)


def similar(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is similar: (index, smaller index), a spanning forest of all pairs at or above the threshold.

    A set is compared with all others by an inverted index.  Once a set is in the
    largest component it need not be compared itself: whatever lies outside that
    component is compared with everything.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    posting, starts = owner[by], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    own = np.concatenate([[0], np.cumsum(sizes)])
    label, done = np.arange(n), np.zeros(n, bool)
    left, right = [], []
    while True:
        count = np.bincount(label, minlength=n)
        largest = int(np.argmax(count))
        rest = np.flatnonzero(~done & ((label != largest) | (count[largest] == 1)))
        if not len(rest) or (count[largest] == n):
            break
        i = int(rest[0])
        done[i] = True
        mine = inverse[own[i]:own[i + 1]]
        common = np.bincount(np.concatenate([posting[starts[v]:starts[v + 1]] for v in mine]), minlength=n)
        near = np.flatnonzero(common >= threshold * (sizes + sizes[i] - common) - 1e-9)
        near = near[label[near] != label[i]]
        for other in near[np.unique(label[near], return_index=True)[1]].tolist():
            left.append(max(i, other))
            right.append(min(i, other))
        joined = np.isin(label, np.append(np.unique(label[near]), label[i]))
        label[joined] = label[joined].min()
    return np.array(left, np.int64), np.array(right, np.int64)


def _verify(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = similar([np.frombuffer(x, np.uint32) for x in rows["shingles"]], threshold)
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return run


def line_classes(sketch: DataFrame, threshold: float, group_bound: int) -> DataFrame:
    """(node, root) of all lines that are similar to another line, by verified components."""
    content = sketch.where("kind = 'content'").select("node", "keys", "shingles")
    keyed = content.select("node", F.explode("keys").alias("key"))
    busy = written(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low"))
    candidates = keyed.join(busy, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    groups = written(components(candidates))
    # one group for a class within the bound; beyond it, a group for every pair of blocks of its lines.
    # Classes beyond the bound are at most one in group_bound of the lines.
    large = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group_bound)
    blocks = groups.join(F.broadcast(large), "root", "left").withColumn("n", F.coalesce(F.ceil(F.col("size") / group_bound), F.lit(1)).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    pairs = blocks.withColumn("block", block).select("node", "root", "block", other)
    pairs = pairs.select("node", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    once = content.groupBy("node").agg(F.first("shingles").alias("shingles"))
    tasks = int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # comparing takes time, not bytes: tasks are not merged by size
    links = written(once.join(pairs, "node").repartition(tasks, "root", "i", "j").groupBy("root", "i", "j").applyInPandas(_verify(threshold), "a long, b long"))
    return components(links)


_BESIDE = "node long, beside binary, rid long, left boolean, start int, stop int, cuts binary, open boolean"


def _varying(matrix: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Binary values: the valid leading entries of each row."""
    offsets = np.concatenate([[0], np.cumsum(valid.sum(1) * matrix.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix[valid].tobytes())])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, places) -> one row for each asked side of a window: up to ``REACH - 1`` words beside it, as 32-bit hashes, and where they end."""
    cache, width = _Words(), np.arange(REACH - 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, begins, ends = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = text.lower().split()
            start, stop, _, points = places(text)
            hashes.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
            begins.append(points[start])
            ends.append(points[stop])
        sizes = np.array([len(h) for h in hashes])
        h, begin, end = mix(np.concatenate(hashes)).astype(np.uint32), np.concatenate(begins), np.concatenate(ends)
        asked = batch.column(2)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        pos, node, left, right = (asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
        rid = batch.column(0).to_numpy()
        base = (np.cumsum(sizes) - sizes)[doc] + pos
        for side, mine in ((True, left.astype(bool)), (False, right.astype(bool))):
            room = pos if side else sizes[doc] - pos - WINDOW
            mine = np.flatnonzero(mine & (room > 0))
            if not len(mine):
                continue
            valid = width < room[mine, None]
            at = np.where(valid, base[mine, None] + (-1 - width if side else WINDOW + width), 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(mix(node[mine].view(np.uint64) + np.uint64(1 + side)).view(np.int64)), _varying(h[at], valid), pa.array(rid[doc[mine]]), pa.array(np.full(len(mine), side)),
                pa.array(begin[base[mine]].astype(np.int32)), pa.array(end[base[mine] + WINDOW - 1].astype(np.int32)),
                _varying((begin if side else end)[at].astype(np.int32), valid), pa.array(np.full(len(mine), True))],
                names=["node", "beside", "rid", "left", "start", "stop", "cuts", "open"])


def common_words(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
    """Sorted rows beside windows to (grown runs, rows that need the neighbouring tasks' rows).

    The most words that a row shares with a row of another document are those that
    it shares with the nearest such row before or after it.  Only the first and the
    last document's rows of a task can have that neighbour in another task: they go on, with a
    closed row of the next document beside them.  ``last``: there is no other task.
    """
    n, width = rows.num_rows, REACH - 1
    node, rid = rows["node"].to_numpy(), rows["rid"].to_numpy()
    open_ = rows["open"].to_numpy(zero_copy_only=False).astype(bool)
    both = [rows[c].combine_chunks().cast(pa.binary()) if rows.num_rows else pa.array([], pa.binary()) for c in ("beside", "cuts")]
    size = np.array(pa.compute.binary_length(both[0]).to_numpy(), np.int64) // 4
    words, cuts = np.zeros((n, width), np.uint32), np.zeros((n, width), np.int32)
    valid = np.arange(width) < size[:, None]
    words[valid] = np.frombuffer(b"".join(both[0].to_pylist()), np.uint32)
    cuts[valid] = np.frombuffer(b"".join(both[1].to_pylist()), np.int32)
    alike = (words[1:] == words[:-1]) & valid[1:] & valid[:-1] & (node[1:] == node[:-1])[:, None]
    shared = np.concatenate([[0], np.minimum.accumulate(alike, 1).sum(1), [0]])  # with the row before
    same = np.concatenate([[False], rid[1:] == rid[:-1], [False]])
    before, other = shared[:-1].copy(), np.concatenate([[0], rid[:-1]])
    for i in np.flatnonzero(same[:-1]).tolist():
        before[i], other[i] = min(before[i], before[i - 1]), other[i - 1]
    after, another = shared[1:].copy(), np.concatenate([rid[1:], [0]])
    for i in np.flatnonzero(same[1:])[::-1].tolist():
        after[i], another[i] = min(after[i], after[i + 1]), another[i + 1]
    if same[:-1].any():  # the first document has none before it, the last none after it
        borders = np.flatnonzero(~same)
        before[:borders[1]], after[borders[-2]:] = 0, 0
    most = np.maximum(before, after)
    witness = np.where(before >= after, other, another)
    edge = np.zeros(n, bool)
    if n and not last:
        borders = np.flatnonzero(~same)  # starts of runs of one document, and n
        edge[:borders[1]], edge[borders[-2]:] = True, True
    passed = edge.copy()
    if n and not last:
        passed[min(borders[1], n - 1)], passed[max(borders[-2] - 1, 0)] = True, True
    key = node.view(np.uint64).copy()
    for j in range(width):
        key = np.where(j < most, mix(key * BASE + words[:, j]), key)
    left = rows["left"].to_numpy(zero_copy_only=False).astype(bool)
    cut = cuts[np.arange(n), np.maximum(most - 1, 0)] if n else np.zeros(0, np.int32)
    start, stop = np.where(left, cut, rows["start"].to_numpy()), np.where(left, rows["stop"].to_numpy(), cut)
    done = np.flatnonzero(open_ & ~edge & (most > 0))
    grown_ = pa.table({"node": key[done].view(np.int64), "rid": rid[done], "start": start[done].astype(np.int32), "stop": stop[done].astype(np.int32), "low": np.minimum(rid, witness)[done]})
    return grown_, rows.filter(pa.array(passed)).set_column(7, "open", pa.array((open_ & edge)[passed]))


def _neighbours(last: bool):
    """Rows beside windows, sorted, to grown runs (``low`` not null) and rows that go on (``low`` null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        grown_, further = common_words(pa.Table.from_batches(held), last)
        for table_ in (grown_, further):
            if table_.num_rows:
                columns = [table_[f.name].combine_chunks() if f.name in table_.column_names else pa.nulls(table_.num_rows, f.type) for f in _MET]
                yield pa.RecordBatch.from_arrays(columns, schema=_MET)

    return run


_MET = pa.schema([("node", pa.int64()), ("beside", pa.binary()), ("rid", pa.int64()), ("left", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), ("cuts", pa.binary()), ("open", pa.bool_()), ("low", pa.int64())])


def repeated_of(places_: DataFrame) -> DataFrame:
    """(node, keeper) of the nodes that occur in two or more documents."""
    return written(places_.groupBy("node").agg(F.min("rid").alias("keeper"), F.max("rid").alias("last")).where("keeper <> last").select("node", "keeper"))


def grown(docs: DataFrame, windows: DataFrame, broadcast_places: int) -> DataFrame:
    """(rid, start, stop, node, keeper): repeated windows with the words beside them that repeat too.

    A window needs no growing towards a neighbour of the same keeper: words that
    repeat up to that neighbour lie in it, and a longer repeat holds the neighbour.
    All places of a window are grown if one of them must be.
    """
    order = Window.partitionBy("rid").orderBy("pos")
    ended = lambda x: ~F.coalesce((F.abs(x("pos").over(order) - F.col("pos")) <= WINDOW) & (x("keeper").over(order) == F.col("keeper")), F.lit(False))
    ends = windows.select("node", ended(F.lag).alias("left"), ended(F.lead).alias("right"))
    asked = written(ends.groupBy("node").agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left OR right"))
    asked = windows.select("node", "rid", "pos").join(asked, "node").select("rid", F.struct("pos", "node", "left", "right").alias("place"))
    asked = written(asked.groupBy("rid").agg(F.collect_list("place").alias("places")))
    few = (asked.agg(F.sum(F.size("places"))).first()[0] or 0) <= broadcast_places
    held = docs.join(F.broadcast(asked) if few else asked.hint("merge"), "rid").select("rid", "text", "places")
    beside, found, size = written(held.mapInArrow(_beside, _BESIDE)), [], SORTED
    while True:
        tasks, size = -(-beside.count() // size) or 1, 2 * size  # what goes on is a few rows a task, or one document's
        sorted_ = beside.repartitionByRange(tasks, "node", "beside", "rid") if tasks > 1 else beside.coalesce(1)
        met = written(sorted_.sortWithinPartitions("node", "beside", "rid").mapInArrow(_neighbours(tasks == 1), _BESIDE + ", low long"))
        found.append(met.where("low IS NOT NULL").select("node", "rid", "start", "stop", "low"))
        if tasks == 1:
            break
        beside = met.where("low IS NULL").drop("low")
    runs = reduce(DataFrame.union, found)
    keepers = written(runs.groupBy("node").agg(F.min("low").alias("keeper")))
    return runs.join(keepers, "node").select("rid", "start", "stop", "node", "keeper")


def occurrences(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY, group_bound: int = 20_000, broadcast_places: int = 1_000_000) -> DataFrame:
    """(rid, kind, start, stop, class, keeper): all places of windows, grown windows and lines that occur in two or more documents.

    ``docs`` has ``rid``; ``keeper`` is the smallest rid of the class.
    """
    docs = docs.select("rid", F.col(text).alias("text"))
    sketch = written(docs.mapInArrow(_sketch, _DDL))
    windows = sketch.where("kind = 'window'").select("node", "rid", "pos", "start", "stop")
    windows = written(windows.join(repeated_of(windows), "node"))
    of_windows = windows.select("rid", "start", "stop", "node", "keeper").union(grown(docs, windows, broadcast_places))
    of_windows = of_windows.select("rid", F.lit("passage").alias("kind"), "start", "stop", F.col("node").alias("class"), "keeper")
    roots = line_classes(sketch, threshold, group_bound)
    lines = sketch.where("kind = 'line'").select("node", "rid", "start", "stop")
    lines = lines.join(roots, "node", "left").select("rid", "start", "stop", F.coalesce("root", "node").alias("class"))
    kept = written(lines.groupBy("class").agg(F.min("rid").alias("keeper"), F.max("rid").alias("last")).where("keeper <> last").select("class", "keeper"))
    of_lines = lines.join(kept, "class").select("rid", F.lit("paragraph").alias("kind"), "start", "stop", "class", "keeper")
    return of_windows.union(of_lines)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column: spans -> merged spans."""
    for batch in batches:
        spans = [[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in x])] for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, batch.schema.types[-1])], schema=batch.schema)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (key, keeper_<key>, kind, spans, removed): a document, the first with the same passages, and where they stand.

    A keeper has rows with itself, with ``removed`` false.  Spans are code points, stop exclusive, merged.
    """
    held = steady(docs).select(F.col(key).alias("id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    found = occurrences(held.select("rid", "text"), **options)
    pairs = found.groupBy("rid", "keeper", "kind").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    pairs = pairs.mapInArrow(_merge, T.StructType([*pairs.schema.fields[:-1], T.StructField("spans", pairs.schema["spans"].dataType)]))
    names = held.select(F.col("rid"), F.col("id"))
    own = pairs.join(names, "rid")
    first = names.select(F.col("rid").alias("keeper"), F.col("id").alias("keeper_id"))
    return own.join(first, "keeper").select(F.col("id").alias(key), F.col("keeper_id").alias(f"keeper_{key}"), "kind", "spans", F.expr("rid <> keeper").alias("removed"))


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans."""
    out, at = [], 0
    for a, b in merged(spans):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])
