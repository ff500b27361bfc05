"""Phrase collocations by dynamic itemset counting.

Texts become blocks of word numbers, dealt to ``SHARDS`` shards.  The shards are
scanned in turn, over and over, and phrases of all lengths are counted in the
same scans: single words from the first scan on, a longer phrase from the scan
after both of its subphrases (without its last word, without its first word) have
reached the threshold.  Each phrase is counted for exactly one cycle, that is in
every shard once, wherever in the cycle it began.  Scans end when no phrase is
left on its way.

Which phrases have reached the threshold, and in which scan, is told to the tasks
by a table of ``slots`` bytes, sent compressed: the slot of a phrase's hash holds one more than
that scan, and a slot that is set never changes.  A shared slot makes a phrase
count too early, never too late, and every task and scan sees the same slot, so
each phrase has one definite first scan and its cycle stays whole.  Phrases are
told apart by 64-bit hashes (of 10^9 different phrases on their way, two meet in
one run of 37, and then matter only if one is frequent).  Every count carries a
block that holds the phrase, and when the cycles are over that block gives its text.

Scale: blocks are written once; a scan reads one shard of them.  Tasks send
(hash, count) rows of phrases on their way, one for each block that holds them;
sums are combined before the shuffle, so a word or phrase with a third of all
occurrences is one row a task.  Only set slots reach the driver, at most
``slots`` of them.  Everything after counting works on frequent phrases, of
which there are at most as many as words divided by the threshold, for each length.

Defined cases: a null text is empty, a null language is ``und``; texts without
words add nothing; repeated rows count each time; a piece of any length is
counted whole; an empty table gives none; other columns are left out, whatever
their names.  Ties go by count, then by phrase in byte order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table_written, written

LONGEST = 5
SHARDS = 4
BLOCK_WORDS = 2_000_000
# A-Z become lower case, marks that end a piece become a line feed, a tab becomes a space.
_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
BREAK = b"\n"
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Numbers(dict):
    """Numbers words as they come; 0 is the empty string between two spaces, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, BREAK: 1})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, number, total, ids, words): texts as numbers of the block's words."""
    kept: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    size: dict[str, int] = {}
    number = 0

    def block(lang: str) -> pa.RecordBatch:
        nonlocal number
        numbers, parts = kept.pop(lang)
        ids = np.concatenate(parts)
        ids = ids[ids != 0] - 1  # 0 is now the end of a piece
        number, size[lang] = number + 1, 0
        columns = [[lang], [number], [int(np.count_nonzero(ids))], [ids.astype(np.uint32).tobytes()], [b" ".join(list(numbers)[2:])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                          names=["lang", "number", "total", "ids", "words"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = (text.as_py().translate(_PIECES).replace(BREAK, b" \n ") + b" \n").split(b" ")
            numbers, parts = kept.setdefault(lang, (_Numbers(), []))
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            size[lang] = size.get(lang, 0) + len(words)
            if size[lang] >= BLOCK_WORDS:
                yield block(lang)
    for lang in list(kept):
        yield block(lang)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    x = a * A + (b ^ (b >> np.uint64(31))) * B
    x = (x ^ (x >> np.uint64(29))) * C
    return x ^ (x >> np.uint64(32))


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _both_slots(hashes: np.ndarray, block, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Two slots that stand for a phrase in a block: a phrase not named for the block seldom finds both set."""
    pair = _mixed(hashes, np.asarray(block).astype(np.uint64))
    return _slot(pair, slots), _slot(pair >> np.uint64(32), slots)


def _levels(lang: str, ids: bytes, words: bytes, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (length, places, hashes, first scan) of the phrases at these places that may be on their way.

    ``places`` count from 0 over all words and ends of pieces; single words come
    once each, with place -1, and the number of their occurrences as first scan.
    """
    at = np.frombuffer(ids, np.uint32)
    vocabulary = words.split(b" ") if words else []
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))
    yield 1, np.full(len(own), -1), own, np.bincount(at, minlength=len(own) + 1)[1:]
    reached = np.concatenate([[0], table[_slot(own, len(table))]]).astype(np.int64)[at]
    hashes = np.concatenate([np.zeros(1, np.uint64), own])[at]
    single = hashes
    for length in range(2, LONGEST + 1):
        # hashes[i], reached[i]: of the phrase of length - 1 words at place i (reached 0: not frequent, or none)
        places = np.flatnonzero((reached[:-1] > 0) & (reached[1:] > 0))
        if not len(places):
            return
        first = np.maximum(reached[places], reached[places + 1])
        mixed = _mixed(hashes[places], single[places + length - 1])
        yield length, places, mixed, first
        longer = np.zeros(len(hashes) - 1, np.uint64)
        longer[places] = mixed
        hashes = longer
        # a shared slot may have been set before the phrase itself could be counted
        told = table[_slot(mixed, len(table))].astype(np.int64)
        reached = np.zeros(len(hashes), np.int64)
        reached[places] = np.where(told > 0, np.maximum(told, first), 0)


def _packed(table: np.ndarray) -> bytes:
    return zlib.compress(table.tobytes(), 1)


def _table(shared) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), np.uint8)


def _scanner(shared, scan: int) -> object:
    """Blocks to rows (hash, n, told) of the phrases counted in this scan; told holds a block, the first scan and the length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared)
        for batch in batches:
            for lang, block, ids, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for length, places, hashes, first in _levels(lang, ids, words, table):
                    if length == 1:
                        if scan >= SHARDS:
                            continue
                        found, count, first = hashes, first, np.zeros(len(hashes), np.int64)
                    else:
                        active = scan < first + SHARDS
                        found, where, count = np.unique(hashes[active], return_index=True, return_counts=True)
                        first = first[active][where]
                    if len(found):
                        told = (block << 16) | (first << 8) | length
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64)), pa.array(told)], names=["hash", "n", "told"])

    return run


def _texts(shared, named) -> object:
    """Blocks to rows (lang, hash, phrase): each phrase from the one block that is named for it (and a few by chance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = _table(shared), _table(named)
        for batch in batches:
            for lang, block, ids, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at, vocabulary = np.frombuffer(ids, np.uint32), words.split(b" ")
                for length, places, hashes, _ in _levels(lang, ids, words, table):
                    one, other = _both_slots(hashes, block, len(wanted))
                    own = np.flatnonzero(wanted[one] & wanted[other])
                    found, one = np.unique(hashes[own], return_index=True)
                    if length == 1:
                        phrases = [vocabulary[i] for i in own[one].tolist()]
                    else:
                        rows = at[places[own[one]][:, None] + np.arange(length)] - 1
                        phrases = [b" ".join([vocabulary[i] for i in row]) for row in rows.tolist()]
                    if phrases:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(phrases, pa.binary()).cast(pa.string())],
                                                         names=["lang", "hash", "phrase"])

    return run


def _set_slots(rows: DataFrame, slot, *more) -> pa.Table:
    """The distinct slots of ``rows``, at most as many as there are slots."""
    return rows.groupBy(slot.alias("slot")).agg(*(more or [F.count(F.lit(1))])).toArrow()


def frequent(blocks: DataFrame, threshold: int, slots: int = 1 << 24) -> DataFrame:
    """Dynamic counting: (lang, phrase, f) of all phrases of up to ``LONGEST`` words that occur ``threshold`` times or more.

    ``blocks``: rows of :func:`blocks_of`, written and partitioned by shard.
    """
    broadcast = blocks.sparkSession.sparkContext.broadcast
    table, longest = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
    scan, until, state, ended = 0, SHARDS, None, []
    first, length = F.expr("(told div 256) % 256"), F.expr("told % 256")
    while scan < until:
        shared = broadcast(_packed(table))
        own = blocks.where(F.col("shard") == scan % SHARDS).select("lang", "block", "ids", "words").mapInArrow(_scanner(shared, scan), "hash long, n long, told long")
        if state is not None:
            own = own.union(state.where(first + SHARDS > scan))
        state = written(own.groupBy("hash").agg(F.sum("n").alias("n"), F.max("told").alias("told")))
        shared.destroy()
        often = state.where(F.col("n") >= threshold)
        ended.append(often.where(first + SHARDS - 1 == scan))
        reached = _set_slots(often, F.expr(f"hash & {slots - 1}L"), F.min(length).alias("length"))
        at, short = reached["slot"].to_numpy(), reached["length"].to_numpy() < LONGEST
        longest[at[~short]] = 1
        new = at[short][table[at[short]] == 0]
        table[new] = scan + 1
        if len(new):
            until = scan + 1 + SHARDS
        scan += 1
    counted = written(reduce(DataFrame.union, ended).select("hash", F.col("n").alias("f"), F.expr("told div 65536").alias("block")))
    wanted = np.zeros(slots, np.uint8)
    for part in counted.select("hash", "block").mapInArrow(_named(slots), "slot long").distinct().toArrow()["slot"].chunks:
        wanted[part.to_numpy()] = 1
    texts = blocks.select("lang", "block", "ids", "words").mapInArrow(_texts(broadcast(_packed(np.maximum(table, longest))), broadcast(_packed(wanted))), "lang string, hash long, phrase string")
    return texts.groupBy("hash").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase")).join(counted.select("hash", "f"), "hash").select("lang", "phrase", "f")


def _named(slots: int) -> object:
    """Rows (hash, block) to the two slots that stand for the phrase in this block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots_of = _both_slots(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), slots)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots_of))], names=["slot"])

    return run


def blocks_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The texts as blocks of word numbers, written to the shared folder by shard."""
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(F.coalesce(c(lang), F.lit("und")).alias("lang"), F.coalesce(c(text), F.lit("")).alias("text"))
    made = rows.mapInArrow(_blocks, "lang string, number long, total long, ids binary, words binary")
    made = made.withColumn("block", F.spark_partition_id() * F.lit(1 << 20).cast("long") + F.col("number"))
    return table_written(made.withColumn("shard", F.pmod(F.col("number") + F.spark_partition_id(), F.lit(SHARDS)).cast("int")), "shard")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = 100, top: int = 2000, slots: int = 1 << 24) -> DataFrame:
    """The best ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score), see the module.

    A phrase cut after k words scores floor(1000 * a * n / (l * r)); the lowest
    cut counts.  Phrases inside a longer one with as many occurrences are left out.
    """
    blocks = blocks_of(docs, text, lang)
    found = written(frequent(blocks, threshold, slots))
    words = F.split("phrase", " ")
    phrases = found.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    within = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array(part(1, F.size("words") - 1), part(2, F.size("words") - 1))).alias("phrase"), "a").distinct()
    left = phrases.join(within, ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words")).alias("tail"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    totals = blocks.groupBy("lang").agg(F.sum("total").alias("n"))
    whole = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals), "lang")
    big = lambda name: F.col(name).cast("decimal(38,0)")
    scored = whole.withColumn("big", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n")).withColumn("of", big("l") * big("r"))
    scored = scored.withColumn("score", F.expr("big div of"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")

    def best(rows: DataFrame, *group) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    return best(best(salted, "lang", "salt").drop("rank"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
