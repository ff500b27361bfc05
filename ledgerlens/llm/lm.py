"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is an interpolated bigram model (Witten-Bell) over add-one unigrams:
``P(w|v) = (c(v,w) + T(v) P(w)) / (c(v) + T(v))``, T(v) being the number of
different successors of v; the start of a text has the end token as context.
Counts come from the training documents only.

Work goes by blocks (neighbouring documents, ``block_bytes`` of text) and shards (of words, and
of contexts).  A block asks each shard once for the different words, then for
the different pairs, that its documents hold, with its own training counts; a
shard adds up what all blocks bring, builds its part of the trie and answers.
Every message is one row of packed arrays, so the shuffles carry different words
and pairs of a block, not tokens.  The trie of a shard has two levels in flat
buffers (they could be mapped from a file as they are): contexts with monotone
Elias-Fano pointers, and the successors of all contexts as one monotone
Elias-Fano sequence with a quantised probability each; a pair is found by
successor search inside its context's range.  A context with more than
``piece`` training tokens is split by its successors' hashes over several
shards, so a word with a third of all tokens does not gather in one task.

Words are known by 64-bit hashes; in messages a context has 40 bits of its hash, a
successor 32, and a context's count eight steps an octave.  Probabilities are
quantised to 255 steps of the logarithm; base scores use exact counts.

Defined cases: a null or blank text is the end token alone; without training
documents every count is zero and all scores are those of unknown words;
repeated rows and ids count and score as documents of their own; a null id
belongs to the training part; texts are scored whole; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import steady, written

END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
HELD_OUT, FOLDS = 2, 7
SUCCESSOR_BITS, CONTEXT_BITS = 32, 40
STEPS, LOWEST = 254, -9.0  # quantised logarithms from 1e-9 to 1


class EliasFano:
    """A sorted sequence of integers: low bits packed, high bits in unary, both in flat buffers."""

    def __init__(self, values: np.ndarray, universe: int):
        n = self.n = len(values)
        self.width = w = max(0, int(universe // max(1, n)).bit_length() - 1)
        low = values.astype(np.uint64) & np.uint64((1 << w) - 1)
        bits = np.arange(n, dtype=np.uint64) * np.uint64(w)
        self.low = np.zeros(n * w // 64 + 2, np.uint64)
        at, shift = (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
        if n:
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.low[at[heads]] = np.bitwise_or.reduceat(low << shift, heads)
            spill = (shift > 0) & (shift + np.uint64(w) > 64)  # at most one value crosses into each word
            self.low[at[spill] + 1] |= low[spill] >> (np.uint64(64) - shift[spill])
        high = (values.astype(np.uint64) >> np.uint64(w)).astype(np.int64) + np.arange(n)
        size = int(high[-1]) + 2 if n else 1
        marks = np.zeros((size // 64 + 1) * 64, np.uint8)
        marks[high] = 1
        self.high = np.packbits(marks, bitorder="little").view(np.uint64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(self.high).astype(np.int64))])
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))])

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        w = np.uint64(self.width)
        bit = i.astype(np.uint64) * w
        at, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        rest = np.where(shift > 0, self.low[at + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[at] >> shift) | rest) & np.uint64((1 << self.width) - 1)

    @staticmethod
    def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one (from 0) inside each word."""
        place = np.zeros(len(words), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(words >> place & np.uint64((1 << step) - 1)).astype(np.int64)
            go = k >= lower
            k = np.where(go, k - lower, k)
            place = np.where(go, place + np.uint64(step), place)
        return place.astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._select(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self.low_bits(i)

    def below(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits less than ``bucket``."""
        k = bucket - 1
        word = np.minimum(np.searchsorted(self.zeros, np.maximum(k, 0), "right") - 1, len(self.high) - 1)
        place = word * 64 + self._select(~self.high[word], np.maximum(k, 0) - self.zeros[word])
        return np.where(bucket > 0, np.minimum(place - k, self.n), 0)

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Index in [start, stop] of the first value not below ``x``."""
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        last = len(self.zeros) and int(self.zeros[-1]) - 1
        low = np.maximum(start, self.below(np.minimum(bucket, last)))
        high = np.maximum(low, np.minimum(stop, self.below(np.minimum(bucket + 1, last))))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            less = self[middle] < x[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)


def quantise(p: np.ndarray) -> np.ndarray:
    """Code 1 to 255 of a probability; 0 is kept for pairs never seen."""
    steps = np.round((np.log10(np.maximum(p, 10 ** LOWEST)) - LOWEST) * (STEPS / -LOWEST))
    return (np.clip(steps, 0, STEPS) + 1).astype(np.uint8)


DECODED = np.concatenate([[0.0], 10 ** (LOWEST + np.arange(STEPS + 1) * (-LOWEST / STEPS))])


class Trie:
    """Level one: contexts; level two: their successors."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, owner: np.ndarray, successor: np.ndarray, pairs: np.ndarray):
        """Sorted contexts and their counts; pairs sorted by (owner, successor), owner an index of contexts."""
        n = len(contexts)
        self.contexts = contexts
        self.pointers = EliasFano(np.searchsorted(owner, np.arange(n + 1)), len(owner) + 1)
        self.kinds = np.bincount(owner, minlength=n).astype(np.uint32)  # different successors
        self.successors = EliasFano((owner.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor, max(1, n) << SUCCESSOR_BITS)
        self.codes = np.append(quantise(pairs / counts[owner]), np.uint8(0))

    def find(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.contexts, context)

    def lookup(self, node: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs (context index, successor); 0 if the pair is not in the trie."""
        start, stop = self.pointers[node].astype(np.int64), self.pointers[node + 1].astype(np.int64)
        x = (node.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor
        at = self.successors.successor(x, start, stop)
        found = at < stop
        found[found] = self.successors[at[found]] == x[found]
        return np.where(found, self.codes[np.minimum(at, len(self.codes) - 1)], np.uint8(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def _planes(x: np.ndarray) -> bytes:
    """uint32 as four compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _joined(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(planes), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _wide(x: np.ndarray) -> bytes:
    """int64 as two halves of compressed planes."""
    low = _planes(x & 0xFFFFFFFF)
    return len(low).to_bytes(4, "little") + low + _planes(x >> 32)


def _widened(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return _joined(data[4 + n:]).astype(np.int64) << 32 | _joined(data[4:4 + n]).astype(np.int64)


def _packed5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked5(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def octaves(counts: np.ndarray) -> np.ndarray:
    """Least number of eighths of an octave that is not below the count; 0 for none and for one."""
    return np.ceil(8 * np.log2(np.maximum(counts, 1)) - 1e-9).astype(np.int64)


def rounded_up(steps: np.ndarray) -> np.ndarray:
    return 2.0 ** (steps / 8)


# A message: its kind, its block and shard, and packed arrays.
MESSAGE = "kind string, block long, shard int, a binary, b binary, c binary, d binary, e binary"
FIELDS = ("kind", "block", "shard", "a", "b", "c", "d", "e")
Message = tuple


def _frame(rows: list[Message]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=FIELDS)


def _runs(sorted_: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of the values 0 to n - 1 in a sorted array."""
    at = np.searchsorted(sorted_, np.arange(n + 1))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _word_order(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's words by (shard, hash), and their shards in that order."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((hashes, shard))
    return order, shard[order]


def _block(block: int, rids: np.ndarray, train: np.ndarray, texts: list[bytes | None]) -> Message:
    """The documents of a block as a stream of word numbers."""
    ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)  # 0 is the end token
    parts, lengths = [], []
    for text in texts:
        words = (text or b"").lower().split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
        parts.append(np.zeros(1, np.uint32))
        lengths.append(len(words) + 1)
    stream, lengths = np.concatenate(parts), np.array(lengths, np.int64)
    n = len(ids) + 1
    hashes = np.fromiter((END, *map(xxhash.xxh64_intdigest, ids)), np.uint64, n)
    # frequent words get small numbers, so that the stream compresses
    by_use = np.argsort(-np.bincount(stream, minlength=n), kind="stable")
    number = np.empty(n, np.uint32)
    number[by_use] = np.arange(n, dtype=np.uint32)
    stream, hashes = number[stream], hashes[by_use]
    return ("block", block, None, rids.astype("<i8").tobytes(), lengths.tobytes(), train.tobytes(), _planes(stream), hashes.tobytes())


def _ask_words(shards: int):
    """Blocks -> their questions for words, with the block's training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lengths, train, stream, hashes = (batch.column(batch.schema.get_field_index(f))[i].as_py() for f in ("block", "b", "c", "d", "e"))
                hashes, used = np.frombuffer(hashes, np.uint64), np.repeat(np.frombuffer(train, bool), np.frombuffer(lengths, np.int64))
                counts = np.bincount(_joined(stream)[used], minlength=len(hashes))
                order, shard = _word_order(hashes, shards)
                rows = [("words", block, s, hashes[order[x:y]].tobytes(), _planes(counts[order[x:y]]), None, None, None)
                        for s, (x, y) in enumerate(_runs(shard, shards)) if y > x]
                yield pa.RecordBatch.from_pandas(_frame(rows), schema=_SCHEMA, preserve_index=False)

    return run


def _tokenise(block_bytes: int):
    """(rid, train, text) -> blocks of about ``block_bytes`` of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 28)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 1
            of_block = np.cumsum(sizes) // block_bytes
            rids, train = np.asarray(batch.column(0)), np.array(batch.column(1).to_pylist(), bool)
            for i in np.unique(of_block).tolist():
                x, y = np.searchsorted(of_block, [i, i + 1]).tolist()
                rows = [_block(next(number), rids[x:y], train[x:y], texts.slice(x, y - x).to_pylist())]
                yield pa.RecordBatch.from_pandas(_frame(rows), schema=_SCHEMA, preserve_index=False)

    return run


_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), *((x, pa.binary()) for x in "abcde")])


def _count_words(key: tuple, questions: pd.DataFrame) -> pd.DataFrame:
    """All questions of one shard -> an answer for each block (total counts), and the shard's totals."""
    questions = questions.sort_values("block")
    asked = [np.frombuffer(x, np.uint64) for x in questions["a"]]
    counts = np.concatenate([_joined(x) for x in questions["b"]])
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    answers, at = [], 0
    for block, own in zip(questions["block"], asked):
        answers.append(("counts", block, key[0], _wide(total[inverse[at:at + len(own)]]), None, None, None, None))
        at += len(own)
    sums = np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()
    return _frame([*answers, ("totals", -1, key[0], sums, None, None, None, None)])


class Block:
    """A block's documents with the words' total counts, and its different pairs in the order of the questions."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, shards: int, piece: int):
        self.rids, self.lengths, self.train = np.frombuffer(row["a"], "<i8"), np.frombuffer(row["b"], np.int64), np.frombuffer(row["c"], bool)
        self.stream, self.hashes = _joined(row["d"]).astype(np.int64), np.frombuffer(row["e"], np.uint64)
        order, _ = _word_order(self.hashes, shards)
        counts = answers[answers["kind"] == "counts"].sort_values("shard")["a"]
        self.counts = np.empty(len(order), np.int64)
        self.counts[order] = np.concatenate([_widened(x) for x in counts])
        n = len(self.hashes)
        end = int(np.flatnonzero(self.hashes == np.uint64(END))[0])
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = end
        pairs, self.pair_of = np.unique(before * n + self.stream, return_inverse=True)
        context, word = pairs // n, pairs % n
        trained = np.bincount(self.pair_of[np.repeat(self.train, self.lengths)], minlength=len(pairs))
        pieces = 1 + self.counts // piece
        part = (_mix(self.hashes[word]) % pieces[context].astype(np.uint64)).astype(np.int64)
        # every part of a split context is asked, as its number of successors is the sum over its parts
        asked = np.zeros(n, bool)
        asked[context] = True
        split = np.flatnonzero(asked & (pieces > 1))
        whole = np.repeat(split, pieces[split])
        parts = np.arange(len(whole)) - np.repeat(np.cumsum(pieces[split]) - pieces[split], pieces[split])
        context = np.concatenate([context, whole])
        self.word = np.concatenate([word, np.full(len(whole), -1)])
        trained, part = np.concatenate([trained, np.zeros(len(whole), np.int64)]), np.concatenate([part, parts])
        shard = (_mix(self.hashes[context] + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort((shard * n + context) * int(pieces.max()) + part, kind="stable")  # words are in order already
        self.context, self.part, self.shard, self.trained = (x[self.order] for x in (context, part, shard, trained))
        self.word = self.word[self.order]
        self.n_pairs = len(pairs)
        first = np.concatenate([[True], (self.context[1:] != self.context[:-1]) | (self.part[1:] != self.part[:-1]) | (self.shard[1:] != self.shard[:-1])])
        self.node = np.cumsum(first) - 1  # of each entry
        self.first = np.flatnonzero(first)


def _ask_pairs(shards: int, piece: int):
    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows.iloc[0], answers, shards, piece)
        out: list[Message] = []
        for s, (x, y) in enumerate(_runs(block.shard, shards)):
            if y > x:
                heads = block.first[np.searchsorted(block.first, x):np.searchsorted(block.first, y)]
                sizes = np.diff(np.append(heads, y))
                contexts = block.hashes[block.context[heads]] + block.part[heads].astype(np.uint64)
                word = block.word[x:y]
                low = np.where(word >= 0, block.hashes[word] & np.uint64((1 << SUCCESSOR_BITS) - 1), np.uint64(0))
                trained = np.where(word >= 0, block.trained[x:y] + 1, 0)  # 0: no pair, only the context is asked
                out.append(("pairs", int(key[0]), s, _packed5(contexts), _planes(octaves(block.counts[block.context[heads]])), _planes(sizes), low.astype("<u4").tobytes(), _planes(trained)))
        return _frame(out)

    return run


def _answer_pairs(key: tuple, questions: pd.DataFrame) -> pd.DataFrame:
    """All questions of one shard -> its trie -> for each block the successors of contexts and the codes of pairs."""
    questions = questions.sort_values("block")
    contexts = [_unpacked5(x) for x in questions["a"]]
    totals = rounded_up(np.concatenate([_joined(x) for x in questions["b"]]).astype(float))
    sizes = [_joined(x).astype(np.int64) for x in questions["c"]]
    names, first, node = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
    owner = np.repeat(node, np.concatenate(sizes))
    successor = np.concatenate([np.frombuffer(x, "<u4") for x in questions["d"]]).astype(np.uint64)
    trained = np.concatenate([_joined(x).astype(np.int64) for x in questions["e"]]) - 1
    seen = trained > 0
    pair = (owner[seen].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successor[seen]
    order = np.argsort(pair)
    pair, t = pair[order], trained[seen][order]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    summed = np.add.reduceat(t, starts) if len(starts) else t
    pair = pair[starts]
    trie = Trie(names, totals[first], (pair >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), pair & np.uint64((1 << SUCCESSOR_BITS) - 1), summed)
    out: list[Message] = []
    at = 0
    for block, own, size in zip(questions["block"], contexts, sizes):
        here = trie.find(own)
        n = int(size.sum())
        codes = trie.lookup(np.repeat(here, size), successor[at:at + n])
        out.append(("codes", block, key[0], _planes(trie.kinds[here]), codes.tobytes(), None, None, None))
        at += n
    return _frame(out)


def _score(shards: int, piece: int, n_train: int, n_kinds: int):
    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows.iloc[0], answers, shards, piece)
        codes = answers[answers["kind"] == "codes"].sort_values("shard")
        seen = DECODED[np.concatenate([np.frombuffer(x, np.uint8) for x in codes["b"]])]
        kinds = np.bincount(block.context[block.first], weights=np.concatenate([_joined(x) for x in codes["a"]]), minlength=len(block.hashes))
        base = (block.counts + 1) / (n_train + n_kinds + 1)
        weight = block.counts + kinds
        known = block.word >= 0
        c, w = block.context[known], block.word[known]
        stored = rounded_up(octaves(block.counts).astype(float))  # the count the probability was taken of
        total = np.maximum(weight[c], 1)
        p = np.where(weight[c] > 0, (seen[known] * stored[c] + kinds[c] * base[w]) / total, base[w])
        pair = np.empty(block.n_pairs)
        pair[block.order[known]] = np.log10(p)
        starts = np.cumsum(block.lengths) - block.lengths
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "rid": block.rids, "n_tokens": block.lengths, "n_known": add((block.counts[block.stream] > 0).astype(np.int64)),
            "base_score": add(np.log10(base)[block.stream]), "score": add(pair[block.pair_of]),
        })

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, piece: int = 1_000_000, block_bytes: int = 12 << 20) -> DataFrame:
    """One row per document: (key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``shard_bytes``: text that one shard of words or contexts stands for; ``piece``:
    training tokens of a context in one shard; ``block_bytes``: text of a block.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    held = steady(docs).select(F.col(key).alias("id"), F.col(text).alias("text"), (fold == HELD_OUT).alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, math.ceil(size / shard_bytes))
    blocks = written(held.select("rid", F.expr("NOT held_out").alias("train"), "text").mapInArrow(_tokenise(block_bytes), MESSAGE))
    counts = written(blocks.mapInArrow(_ask_words(shards), MESSAGE).groupBy("shard").applyInPandas(_count_words, MESSAGE))
    sums = [np.frombuffer(bytes(r["a"]), "<i8") for r in counts.where("kind = 'totals'").select("a").collect()]
    n_train, n_kinds = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    answers = counts.where("kind = 'counts'")
    asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_ask_pairs(shards, piece), MESSAGE)
    codes = asked.groupBy("shard").applyInPandas(_answer_pairs, MESSAGE)
    scored = blocks.groupBy("block").cogroup(answers.union(codes).groupBy("block")).applyInPandas(
        _score(shards, piece, n_train, n_kinds), "rid long, n_tokens long, n_known long, base_score double, score double")
    return held.select("id", "held_out", "rid").join(scored, "rid").select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
