"""Benchmark decontamination with an FM-index per training shard.

A shard is up to ``shard_words`` words of consecutive documents of one Arrow
batch.  Its suffixes are sorted by prefix doubling (documents end in separators
of their own, so no phrase crosses a document), the Burrows-Wheeler text is held
in a wavelet matrix with rank counts, and every ``sample``-th text position is
kept.  All phrases are then searched backwards at once, occurrences are located
by walking to the next sampled position, and the hit words become merged spans.

No row moves: documents are scanned where they are read, and only the phrases
travel, in blocks of at most ``block_phrases`` (phrase, item) pairs.  With more
than one block the scan runs once a block and the spans of a document are merged.

Defined cases: a null or wordless text has no words and no hits; an item without
words has no window; a null item id counts as one item with an empty name;
repeated items count once, repeated documents are judged one by one; a document
longer than a shard is indexed in pieces that overlap by a window less one word;
empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.llm.common import steady

WINDOW = 13
SPAN = "array<struct<start: int, stop: int>>"
# Bytes of words keep their value (upper case lowered), all others become a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WaveletMatrix:
    """Rank over a sequence of small integers, one bit vector a level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        n = len(values)
        for level in range(levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], ones]))
            self.zeros.append(n - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of each symbol's run lies in the last level; differences are ranks."""
        for level in range(self.levels):
            one = self._ones(level, at)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and their places in the last level."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            one = self._ones(level, at)
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[level] + one, at - one)
        return symbol, at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions by suffix; ties end at the separators, which are all different."""
    n = len(text)
    width = max(1, int(text.max()).bit_length())
    packed = max(1, min(62 // width, n))
    key = np.zeros(n, np.int64)
    for i in range(packed):
        key <<= width
        key[:n - i] |= text[i:]
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = first
    depth = packed
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.concatenate([head[1:], [True]]))]
        depth *= 2
    return order


class FMIndex:
    """Counts and locates phrases in a text of ``pieces`` word lists."""

    def __init__(self, pieces: list[list[bytes]], sample: int = 8):
        ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        n = int(self.starts[-1])
        symbols = np.zeros(n, np.int64)
        for start, piece in zip(self.starts.tolist(), pieces):
            symbols[start:start + len(piece)] = np.fromiter(map(ids.__getitem__, piece), np.int64, len(piece))
        self.ids = dict(ids)
        distinct = symbols + len(pieces)  # separators below all words, each its own
        distinct[self.starts[1:] - 1] = np.arange(len(pieces))
        order = suffix_array(distinct)
        self.levels = max(1, len(ids).bit_length())
        self.tree = WaveletMatrix(symbols[order - 1], self.levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(ids) + 1))])
        every = np.arange(len(ids) + 1)
        self.base = self.tree.place(every, np.zeros_like(every))
        starts_piece = np.zeros(n, bool)
        starts_piece[self.starts[:-1]] = True
        marked = (order % sample == 0) | starts_piece[order]
        self.marked, self.marks_before, self.samples = marked, np.cumsum(marked) - marked, order[marked]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.place(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, given as rows of word ids (zero: a word the shard lacks)."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        inside = np.arange(phrases.shape[1])[None, :] < lengths[:, None]
        live = np.flatnonzero(((phrases > 0) | ~inside).all(1) & (lengths > 0))
        high[live] = self.first[-1]
        for step in range(1, phrases.shape[1] + 1):
            go = live[lengths[live] >= step]
            if not len(go):
                break
            symbol = phrases[go, lengths[go] - step]
            low[go], high[go] = self._step(symbol, low[go]), self._step(symbol, high[go])
            live = live[high[live] > low[live]]
        alive = np.zeros(len(phrases), bool)
        alive[live] = True
        high[~alive] = low[~alive]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled position, then add the steps."""
        found, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            here = self.marked[at]
            found[todo[here]] = self.samples[self.marks_before[at[here]]] + walked[todo[here]]
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol, place = self.tree.access(at)
                at = self.first[symbol] + place - self.base[symbol]
                walked[todo] += 1
        return found


@dataclass(frozen=True)
class Phrases:
    """One block of phrases: words by number, phrases as rows of numbers, items of each phrase."""

    words: list[bytes]
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @staticmethod
    def of(pairs: list[tuple[bytes, str]]) -> Phrases:
        items: defaultdict[bytes, list[str]] = defaultdict(list)
        for phrase, item in pairs:
            items[phrase].append(item)
        ids: defaultdict[bytes, int] = defaultdict(count(0).__next__)
        split = [p.split() for p in items]
        rows = np.zeros((len(split), max([1, *map(len, split)])), np.int64)
        for i, ws in enumerate(split):
            rows[i, :len(ws)] = [ids[w] for w in ws]
        return Phrases(list(ids), rows, np.array([len(ws) for ws in split], np.int64), list(items.values()))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _search_shard(pieces: list[tuple[int, int, list[bytes]]], block: Phrases, spans: list[list], found: list[set], sample: int) -> None:
    """pieces: (document, offset in its words, words); adds the document's hit spans and items."""
    index = FMIndex([p[2] for p in pieces], sample)
    known = np.array([index.ids.get(w, 0) for w in block.words] or [0], np.int64)
    low, high = index.search(known[block.rows], block.lengths)
    hits = high - low
    if not hits.any():
        return
    phrase = np.repeat(np.arange(len(hits)), hits)
    rows = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits) + low[phrase]
    at = index.locate(rows)
    depth = np.zeros(int(index.starts[-1]) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + block.lengths[phrase], -1)
    covered = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
        piece = int(np.searchsorted(index.starts, start, "right")) - 1
        doc, offset, _ = pieces[piece]
        shift = offset - int(index.starts[piece])
        spans[doc].append((start + shift, stop + shift))
    piece = np.searchsorted(index.starts, at, "right") - 1
    for p, f in np.unique(np.stack([piece, phrase], 1), axis=0).tolist():
        found[pieces[p][0]].update(block.items[f])


def scan_texts(texts: list[bytes | None], block: Phrases, shard_words: int, sample: int) -> tuple[list[int], list[list], list[list[str]]]:
    """Word counts, merged spans of hit words and item ids, one of each a text."""
    n_words: list[int] = []
    spans: list[list] = [[] for _ in texts]
    found: list[set] = [set() for _ in texts]
    shard: list[tuple[int, int, list[bytes]]] = []
    size = 0
    stride = max(shard_words, 2 * WINDOW) - (WINDOW - 1)
    for doc, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        for offset in range(0, max(1, len(words) - (WINDOW - 1)), stride):
            piece = words[offset:offset + stride + WINDOW - 1] if len(words) > stride else words
            if piece:
                shard.append((doc, offset, piece))
                size += len(piece)
            if size >= shard_words:
                _search_shard(shard, block, spans, found, sample)
                shard, size = [], 0
    if shard:
        _search_shard(shard, block, spans, found, sample)
    return n_words, [_merge(s) for s in spans], [sorted(f) for f in found]


def _scanner(text: str, block: Phrases, shard_words: int, sample: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n, spans, items = scan_texts(column.cast(pa.binary()).to_pylist(), block, shard_words, sample)
            found = [pa.array(n, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string()))]
            keep = [i for i, f in enumerate(batch.schema.names) if f != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *found], names=[*(batch.schema.names[i] for i in keep), "n_words", "spans", "items"])

    return run


def phrases_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct rows (phrase, item): windows of 13 words, or the whole of a shorter item."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, items = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ws = words_of(body)
                for i in range(max(1, len(ws) - WINDOW + 1) if ws else 0):
                    phrases.append(b" ".join(ws[i:i + WINDOW]))
                    items.append(name or "")
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(items, pa.string())], names=["phrase", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(windows, "phrase binary, item string").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         shard_words: int = 1 << 20, sample: int = 8, block_phrases: int = 50_000) -> DataFrame:
    """``docs`` in a struct column ``row``, with n_words, spans (of words, stop exclusive, merged) and items (sorted ids)."""
    phrases = phrases_of(benchmark, item, item_text)
    n_blocks = max(1, -(-phrases.count() // block_phrases))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("scanned"))
    if n_blocks > 1:
        held = steady(held).withColumn("rid", F.monotonically_increasing_id())
    found = []
    for b in range(n_blocks):
        own = phrases if n_blocks == 1 else phrases.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)) == b)
        block = Phrases.of([(bytes(r["phrase"]), r["item"]) for r in own.collect()])
        source = held if b == 0 else held.drop("row")
        schema = StructType([*source.drop("scanned").schema.fields, *StructType.fromDDL(f"n_words long, spans {SPAN}, items array<string>").fields])
        found.append(source.mapInArrow(_scanner("scanned", block, shard_words, sample), schema))
    if n_blocks == 1:
        return found[0]
    rest = reduce(DataFrame.union, [f.select("rid", "spans", "items") for f in found])
    merged = rest.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = F.udf(lambda spans: _merge([(s["start"], s["stop"]) for s in spans]), SPAN)
    return found[0].select("row", "n_words", "rid").join(merged, "rid").select("row", "n_words", merge("spans").alias("spans"), "items")


def hit_words(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (at least one word in twenty is hit)."""
    n_hit = F.aggregate("spans", F.lit(0), lambda total, s: total + s["stop"] - s["start"]).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: (key, n_words, n_hit, n_items, items, spans, contaminated)."""
    found = hit_words(scan(docs.select(F.col(key).alias("id"), F.col(options.pop("text", "text")).alias("text")), benchmark, **options))
    return found.select(F.col("row.id").alias(key), "n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    body = text.encode("utf-8", "surrogatepass")
    plain = body.translate(_WORDS)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for start, stop in spans:
        out.append(body[last:places[start][0]])
        last = places[stop - 1][1]
    return b"".join([*out, body[last:]]).decode("utf-8", "surrogatepass")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that the rule does not call contaminated, unchanged."""
    return hit_words(scan(docs, benchmark, **options)).where("NOT contaminated").select("row.*")
