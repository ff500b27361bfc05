"""SimHash near-duplicates with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments.  Two fingerprints that differ
in at most two bits agree exactly in one segment (pigeonhole), and the two
errors fall on the others.  A segment, padded to 23 bits, is decoded by the
perfect binary Golay code: its keys are the indices of all code words within
four bits, one or six of them.  Two segments that differ in up to two bits
always share such an index.  So a key (exact segment, index of the next
segment) misses no link, and has 33 or 34 bits.

Only different fingerprints take part: copies are folded to one row before any
key is made.  A bucket larger than ``bucket_bound`` is not compared: its rows go
on with further exact bits (pigeonhole over the bits left), until at most
2**12 fingerprints can share a bucket.  Every bucket yields a spanning forest
of its links, never all pairs.

Defined cases: null and blank texts have the fingerprint zero and are linked
like any other; repeated rows and ids are members like any other; a null id is
never the smallest; very long texts are hashed whole in blocks; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, steady, written

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCK = 1 << 16  # shingles voted at a time
# Where the three segments lie, and the generator of the Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101
LAST_BITS = 12


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        votes += np.unpackbits(hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def fingerprints(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bytes by place, and for each syndrome its error patterns of weight up to four."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [remainder(1 << b) for b in range(24)]
    by_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            for b in range(8):
                if byte >> b & 1:
                    by_byte[place, byte] ^= single[8 * place + b]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            patterns[s].append(sum(1 << b for b in bits))
    counts = np.array([len(p) for p in patterns], np.int64)
    table = np.zeros((2048, 6), np.int64)
    for s, p in enumerate(patterns):
        table[s, :len(p)] = p
    return by_byte, table, counts


def golay_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit values: (which value, index) of every code word within four bits."""
    by_byte, table, counts = _code()
    v = segment.astype(np.int64)
    syndrome = by_byte[0, v & 255] ^ by_byte[1, v >> 8 & 255] ^ by_byte[2, v >> 16 & 255]
    n = counts[syndrome]
    which = np.repeat(np.arange(len(v)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, (v[which] ^ table[syndrome[which], nth]) >> 11


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    start, width = SEGMENTS[i]
    return (fp >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64)


def _mask(i: int) -> int:
    start, width = SEGMENTS[i]
    return ((1 << width) - 1) << start


def golay_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (fp) -> rows (key, fp, mask): mask has the bits in which a bucket's fingerprints agree."""
    for batch in batches:
        fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for i in range(3):
            which, index = golay_indices(_segment(fp, (i + 1) % 3))
            key = (i << 60) | (_segment(fp, i)[which] << 12) | index
            yield pd.DataFrame({"key": key, "fp": fp[which].view(np.int64), "mask": np.full(len(which), np.uint64(_mask(i))).view(np.int64)})


def _forest(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smaller one) that connect what is linked within equal ``group`` runs."""
    n = len(fp)
    left, right = [], []
    alive = np.arange(n)
    step = 0
    while True:
        step += 1
        alive = alive[alive + step < n]
        alive = alive[group[alive + step] == group[alive]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= MAX_BITS]
        left.append(near)
        right.append(near + step)
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    linked = label != np.arange(n)
    return fp[linked], fp[label[linked]]


def _refined(fp: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    """Three rows for each: one third of the bits not yet agreed joins the mask."""
    frames = []
    for m in np.unique(mask):
        rest = [b for b in range(64) if not int(m) >> b & 1]
        own = fp[mask == m]
        for part in np.array_split(np.array(rest, np.uint64), 3):
            wider = np.uint64(int(m) | sum(1 << int(b) for b in part))
            agreed = (own & wider) * np.uint64(0x9E3779B97F4A7C15) ^ wider * np.uint64(0xC2B2AE3D27D4EB4F)
            frames.append(pd.DataFrame({"key": agreed.view(np.int64), "fp": own.view(np.int64), "mask": np.full(len(own), wider).view(np.int64)}))
    return pd.concat(frames)


def compare_buckets(bound: int):
    """Rows sorted by key -> rows (key, fp, mask, other): an edge has ``other``, a row to refine has ``key``."""
    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = _forest(frame["key"].to_numpy(), frame["fp"].to_numpy(np.int64).view(np.uint64))
        out = pd.DataFrame({"fp": a.view(np.int64), "other": b.view(np.int64)}).drop_duplicates()
        return out.assign(key=pd.array([None] * len(out), "Int64"), mask=pd.array([None] * len(out), "Int64"))[["key", "fp", "mask", "other"]]

    def refined(frame: pd.DataFrame) -> pd.DataFrame:
        out = _refined(frame["fp"].to_numpy(np.int64).view(np.uint64), frame["mask"].to_numpy(np.int64).view(np.uint64))
        return out.assign(other=pd.array([None] * len(out), "Int64"))[["key", "fp", "mask", "other"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the rows of the last key so far
        flooding = None  # the key whose bucket is over the bound
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            held = None
            if flooding is not None:
                more = rows["key"] == flooding
                if more.any():
                    yield refined(rows[more])
                rows = rows[~more]
                if not len(rows):
                    continue
                flooding = None
            last = rows["key"].iloc[-1]
            size = rows.groupby("key", sort=False)["key"].transform("size")
            tail = rows["key"] == last
            large = (size > bound) & ((64 - np.bitwise_count(rows["mask"].to_numpy(np.int64).view(np.uint64))) > LAST_BITS)
            if large.any():
                yield refined(rows[large])
            if (large & tail).any():
                flooding = last
            else:
                held = rows[tail]
            done = rows[~large & ~tail & (size > 1)]
            if len(done):
                yield edges(done)
        if held is not None and len(held) > 1:
            yield edges(held)

    return run


def links(prints: DataFrame, bucket_bound: int = 4096) -> DataFrame:
    """Different fingerprints (fp) -> a spanning forest of all links of at most two bits: rows (fp, other)."""
    rows = prints.mapInPandas(golay_keys, "key long, fp long, mask long")
    found = None
    while True:
        out = written(rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(compare_buckets(bucket_bound), "key long, fp long, mask long, other long"))
        edges = out.where("other IS NOT NULL").select("fp", "other")
        found = edges if found is None else found.union(edges)
        rows = out.where("other IS NULL").select("key", "fp", "mask")
        if rows.isEmpty():
            return found


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bound: int = 4096) -> DataFrame:
    """One row per document: (key, fp, component_id), the smallest ``key`` of its class."""
    prints = written(docs.select(F.col(key).alias("id"), fingerprints(F.col(text)).alias("fp")))
    folded = written(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(folded.select("fp"), bucket_bound), "fp", "other")
    named = folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(F.col("id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class, unchanged: the first in the order of the input's partitions."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = steady(docs).select(F.struct(*columns).alias("row"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    kept = classes(held, "rid", "text").where("rid = component_id").select("rid")
    return held.select("rid", "row").join(kept, "rid", "left_semi").select("row.*")
