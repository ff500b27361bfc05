"""Ranked lexical search with the roles reversed: documents are streamed through an index of the queries.

The items (queries) are few and the documents many.  An inverted index over the
items' terms is broadcast; every document is read where it lies and only its
counts of indexed terms are kept.  With the collection's figures known, each
document's term counts pass through the index, scores are summed for the items
that share a term with it, and a heap of ``k`` entries for each item holds the
best documents of the task.  The tasks' heaps are merged in two steps.

Score of a document with n terms for an item: the sum, over the item's terms with
repeats, of w * ((10^9 * tf) div (1000 * tf + 8 * m)) with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 25 + (75 * n * N) div L.

Scale: no text and no pair moves; a task sends at most k rows an item.  The index
holds the items of at most ``block_bytes`` bytes of text; more items make more
blocks, each of which is one more scan of the documents.  A task holds one index,
one Arrow batch and score cells for ``CELLS`` (document, item) pairs at a time.

Defined cases: null and termless texts belong to no count and are never found; an
item without terms has no rows; repeated items are ranked apart, repeated
documents take a place each; equal scores go by ascending document key, null
keys last; keys of documents are integers; empty tables give empty results;
other columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

CELLS = 1 << 22
# Bytes of terms keep their value (upper case lowered), all others become a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


@dataclass
class Index:
    """Terms of the items; the postings of term t are entries ``starts[t]`` to ``starts[t + 1]``."""

    ids: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray  # how often the item repeats the term
    numbers: list[int]  # of the items

    @classmethod
    def of(cls, rows: list[tuple[int, bytes | None]]) -> Index:
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for place, (_, text) in enumerate(rows):
            for term, times in Counter(terms_of(text)).items():
                postings.setdefault(term, []).append((place, times))
        pairs = [p for own in postings.values() for p in own]
        flat = np.array(pairs, np.int64).reshape(-1, 2)
        return cls({term: i for i, term in enumerate(postings)}, np.cumsum([0, *map(len, postings.values())]), flat[:, 0], flat[:, 1], [number for number, _ in rows])


def _counter(shared) -> object:
    """Documents to rows of their indexed terms, and one row of totals for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        find, known = index.ids.get, len(index.ids)
        holding, n_docs, n_terms = np.zeros(known, np.int64), 0, 0

        def rows(docs, kinds, sizes, totals, terms, times):
            return pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["doc", "kind", "n", "total", "terms", "times"])

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                found, times = np.unique(np.fromiter((i for i in map(find, words) if i is not None), np.uint32), return_counts=True)
                if len(found):
                    holding[found] += 1
                    out.append((doc, len(words), found.tobytes(), times.astype(np.uint32).tobytes()))
            if out:
                docs, sizes, terms, times = zip(*out)
                yield rows(docs, [0] * len(out), sizes, sizes, terms, times)
        held = np.flatnonzero(holding).astype(np.uint32)
        yield rows([None], [1], [n_docs], [n_terms], [held.tobytes()], [holding[held].tobytes()])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of totals to (term, documents that hold it)."""
    for batch in batches:
        for terms, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.uint32).astype(np.int64)), pa.array(np.frombuffer(times, np.int64))], names=["term", "df"])


def _ranker(shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> object:
    """Term counts to the task's heaps: rows (item, doc, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        width = len(index.numbers)
        heaps: list[list] = [[] for _ in range(width)]
        floor = np.ones(width, np.int64)  # a score below it can't enter the heap
        many = np.diff(index.starts)

        def update(docs: list, m: np.ndarray, at: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
            value = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[at]))
            reps = many[terms]
            entry = np.repeat(np.arange(len(terms)), reps)
            posting = np.arange(len(entry)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(index.starts[terms], reps)
            scores = np.zeros(len(docs) * width, np.int64)
            np.add.at(scores, at[entry] * width + index.items[posting], value[entry] * index.times[posting])
            scores = scores.reshape(len(docs), width)
            least = np.maximum(floor, np.partition(scores, -k, axis=0)[-k]) if len(docs) > k else floor
            for d, item in np.argwhere(scores >= least).tolist():
                doc, heap = docs[d], heaps[item]
                new = (int(scores[d, item]), doc is not None, -(doc or 0))
                if len(heap) < k:
                    heapq.heappush(heap, new)
                elif new > heap[0]:
                    heapq.heapreplace(heap, new)
                if len(heap) == k:
                    floor[item] = max(1, heap[0][0])

        for batch in batches:
            docs, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, times = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            begin, cost = 0, 0
            for i in range(len(docs) + 1):
                if i == len(docs) or cost > CELLS:
                    own = slice(begin, i)
                    if i > begin:
                        lengths = [len(x) // 4 for x in held[own]]
                        update(docs[own], np.array([25 + 75 * n * n_docs // n_terms for n in sizes[own]], np.int64), np.repeat(np.arange(i - begin), lengths),
                               np.frombuffer(b"".join(held[own]), np.uint32), np.frombuffer(b"".join(times[own]), np.uint32).astype(np.int64))
                    begin, cost = i, 0
                if i < len(docs):
                    cost += width + int(many[np.frombuffer(held[i], np.uint32)].sum())
        found = [(index.numbers[item], -key if known else None, score) for item, heap in enumerate(heaps) for score, known, key in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "doc", "score"])

    return run


def _best(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           k: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """The ``k`` best documents of each item: (item, rank, key, score)."""
    c = lambda name: F.col(f"`{name}`")
    spark = docs.sparkSession
    asked = written(items.select(c(item).alias("id"), c(item_text).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    texts = docs.select(c(key).cast("long").alias("doc"), c(text).alias("text"))
    n_blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    found = []
    for b in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).select("item", F.col("text").cast("binary").alias("text"))
        index = Index.of([(r["item"], None if r["text"] is None else bytes(r["text"])) for r in own.collect()])
        if not index.ids:
            continue
        shared = spark.sparkContext.broadcast(index)
        counts = written(texts.mapInArrow(_counter(shared), "doc long, kind int, n long, total long, terms binary, times binary"))
        totals = counts.where("kind = 1")
        n_docs, n_terms = totals.agg(F.sum("n"), F.sum("total")).first()
        df = np.zeros(len(index.ids), np.int64)
        for r in totals.select("terms", "times").mapInArrow(_holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64) if n_docs else df
        rows = counts.where("kind = 0").select("doc", "n", "terms", "times")
        found.append(rows.mapInArrow(_ranker(shared, weights, n_docs or 0, n_terms or 1, k), "item long, doc long, score long"))
    if not found:
        found = [texts.limit(0).select(F.lit(0).cast("long").alias("item"), "doc", F.lit(0).cast("long").alias("score"))]
    heaps = reduce(DataFrame.union, found).withColumn("salt", F.spark_partition_id() % 256)
    best = _best(_best(heaps, k, "item", "salt").drop("rank"), k, "item")
    return best.join(asked.select("item", "id"), "item").select(F.col("id").alias(item), "rank", F.col("doc").alias(key), "score")
