"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text where its content says so,
so that documents with common passages share chunks.  A chunk that occurs more
than once is encoded once, by the task that holds its first occurrence, and
travels to the others as token ids; all other chunks are encoded where they are
read and never move.  A chunk's tokens hold wherever it stands between its first
and its last join point (a single space between two visible ASCII characters,
where the splitting pattern always breaks); what lies between the last join
point of a chunk and the first of the next is encoded anew, and the window grows
to further join points until its ends fall on token ends of both chunks.

Decoding concatenates the bytes of the tokens.

Scale: one narrow shuffle of chunk hashes, and shuffles of what is shared; the
texts stay where they are.  The per-document list of shared chunks is broadcast
only up to ``broadcast_rows`` documents, beyond that it is joined by a shuffle.

Defined cases: a null text encodes as the empty text; special tokens in a text
are encoded as such, as the tokenizers library does; repeated rows are separate
documents; texts without join points are encoded whole; empty tables give empty
results; extra columns are ignored or passed through as the function says.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlens.llm.common import steady, written

# Fixed values of the vocabulary: its special token, and its splitting pattern.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JOIN = re.compile(rb"(?<=[!-~]) (?=[!-~])")
LEAST, MEAN_BITS = 256, 11  # shortest chunk in bytes; a cut in 2**11 bytes on average
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


class Codec:
    """The vocabulary of one rank file, with tables for digests and decoding."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(max(ranks.values()), SPECIAL_ID) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.bytes[SPECIAL_ID] = SPECIAL.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.type = np.dtype(np.uint16 if len(self.bytes) <= 1 << 16 else np.int32)  # of ids on their way

    def encode(self, text: bytes) -> np.ndarray:
        plain = text.decode("utf-8", "surrogatepass")
        if SPECIAL not in plain:
            return np.array(self.bpe.encode_ordinary(plain), self.type)
        ids: list[int] = []
        for i, part in enumerate(plain.split(SPECIAL)):
            ids += [SPECIAL_ID] * (i > 0) + self.bpe.encode_ordinary(part)
        return np.array(ids, self.type)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        own = ids.tolist()
        joined = ",".join(map(self.names.__getitem__, own)).encode()
        return len(own), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decode(own).encode()).hexdigest()


@lru_cache(maxsize=4)
def codec(ranks_path: str) -> Codec:
    return Codec(ranks_path)


def chunks(text: bytes) -> list[tuple[int, int]]:
    """Content-defined pieces of ``text``, cut between characters."""
    cuts, last = [0], 0
    if len(text) > LEAST:
        h = GEAR[np.frombuffer(text, np.uint8)]
        for shift in (1, 2, 4, 8, 16):
            wider = h.copy()
            wider[shift:] += h[:-shift] << np.uint32(shift)
            h = wider
        for at in (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist():
            while at < len(text) and text[at] & 0xC0 == 0x80:
                at += 1
            if at - last >= LEAST and at < len(text):
                cuts.append(at)
                last = at
    return list(zip(cuts, [*cuts[1:], len(text)]))


def core(chunk: bytes) -> tuple[int, int] | None:
    """First and last join point of a chunk; None if there is nothing between them."""
    first = JOIN.search(chunk)
    if not first:
        return None
    last = first.start()
    reach = 64
    while True:
        tail = [m.start() for m in JOIN.finditer(chunk, max(0, len(chunk) - reach))]
        if tail or reach >= len(chunk):
            last = max(last, tail[-1] if tail else 0)
            break
        reach *= 4
    return (first.start(), last) if last > first.start() else None


def core_tokens(codec_: Codec, chunk: bytes, first: int, last: int) -> np.ndarray:
    """Tokens of the chunk between its join points; where they disagree with token ends, that stretch is encoded anew."""
    ids = codec_.encode(chunk)
    ends = np.concatenate([[0], np.cumsum(codec_.lengths[ids])])
    a, b = np.searchsorted(ends, first), np.searchsorted(ends, last)
    return ids[a:b] if ends[a] == first and ends[b] == last else codec_.encode(chunk[first:last])


def plan(text: bytes) -> list[tuple[int, int, bytes | None, int, int]]:
    """The text as (start, stop, hash, chunk start, chunk stop): cores of chunks with the chunk's hash, windows between them without."""
    parts: list[tuple[int, int, bytes | None, int, int]] = []
    done = 0
    for a, b in chunks(text):
        chunk = text[a:b]
        inner = core(chunk)
        if inner:
            parts += [(done, a + inner[0], None, 0, 0), (a + inner[0], a + inner[1], xxhash.xxh3_128_digest(chunk), a, b)]
            done = a + inner[1]
    return [*parts, (done, len(text), None, 0, 0)]


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) -> (rid, seq, h): the chunks of each document and their places in its plan."""
    for batch in batches:
        rids, seqs, hashes = [], [], []
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for seq, (_, _, h, _, _) in enumerate(plan(text or b"")):
                if h is not None:
                    rids.append(rid)
                    seqs.append(seq)
                    hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(seqs, pa.int32()), pa.array(hashes, pa.binary())], names=["rid", "seq", "h"])


def tokens_of(own: Codec, text: bytes, absent: set[int] = frozenset()) -> list[tuple[int, bytes | None, np.ndarray | None]]:
    """(seq, chunk hash, ids) of the text's plan; no ids for the places in ``absent``."""
    found = []
    for seq, (a, b, h, start, stop) in enumerate(plan(text)):
        ids = None if seq in absent else own.encode(text[a:b]) if h is None else core_tokens(own, text[start:stop], a - start, b - start)
        found.append((seq, h, ids))
    return found


def _encode_shared(ranks_path: str):
    """(row, rid, text, shared) -> pieces and holes of these documents, and the chunks they own for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            out: list[tuple] = []  # kind, place in the batch, rid, seq, h, body
            for at, (rid, text, shared) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                mine = {x["seq"]: x["own"] for x in shared}
                for seq, h, ids in tokens_of(own, text or b"", {k for k, v in mine.items() if not v}):
                    if ids is None:
                        out.append(("hole", None, rid, seq, h, None))
                        continue
                    out.append(("piece", None if seq else at, rid, seq, None, ids.tobytes()))
                    if mine.get(seq):
                        out.append(("chunk", None, None, None, h, ids.tobytes()))
            columns = list(zip(*out)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            kind, places, *rest = (pa.array(c, t) for c, t in zip(columns, types))
            yield pa.RecordBatch.from_arrays([kind, batch.column(0).take(places), *rest], names=["kind", "row", "rid", "seq", "h", "body"])

    return run


def _columns(own: Codec, ids: list[np.ndarray], outputs: str) -> tuple[list[pa.Array], list[str]]:
    if outputs == "digests":
        columns = list(zip(*map(own.digests, ids))) or [(), (), ()]
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"]
    arrays, names = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["n_tokens", "ids"]
    if outputs == "texts":
        arrays, names = [*arrays, pa.array([own.decode(x.tolist()) for x in ids], pa.string())], [*names, "decoded"]
    return arrays, names


def _encode_alone(ranks_path: str, outputs: str):
    """(row, text) -> (row, outputs) for documents all of whose chunks are their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            ids = [np.concatenate([x for _, _, x in tokens_of(own, t or b"")]) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            arrays, names = _columns(own, ids, outputs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *names])

    return run


def _put_together(ranks_path: str, outputs: str):
    """(row, parts in order) -> (row, outputs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            ids = [np.frombuffer(b"".join(parts), own.type) for parts in batch.column(1).to_pylist()]
            arrays, names = _columns(own, ids, outputs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *names])

    return run


# What each kind of output adds to a document.
OUTPUTS = {"ids": "n_tokens long, ids array<int>", "texts": "n_tokens long, ids array<int>, decoded string",
           "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None, outputs: str = "ids",
           broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document: the columns ``keep`` in a struct ``row``, then the columns of ``OUTPUTS[outputs]``.

    Documents whose chunks are all their own are encoded and digested in one
    task; only documents with chunks that another one owns are put together by
    a shuffle of token ids.
    """
    names = docs.columns if keep is None else keep
    held = steady(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col(f"`{text}`").alias("text"))
    refs = written(held.select("rid", "text").mapInArrow(_references, "rid long, seq int, h binary"))
    owners = refs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "seq")).alias("owner")).where("n > 1").select("h", "owner")
    owners = written(owners)  # so that the join below is of two plain exchanges, which may be split where a chunk is hot
    shared = refs.join(owners, "h").select("rid", F.struct("seq", F.expr("rid = owner.rid AND seq = owner.seq").alias("own")).alias("x"))
    shared = written(shared.groupBy("rid").agg(F.collect_list("x").alias("shared")))
    side = F.broadcast(shared) if shared.count() <= broadcast_rows else shared.hint("merge")
    row = StructField("row", held.schema["row"].dataType, True)
    end = StructType([row, *StructType.fromDDL(OUTPUTS[outputs]).fields])
    alone = held.join(side.select("rid"), "rid", "left_anti").select("row", "text").mapInArrow(_encode_alone(ranks_path, outputs), end)
    schema = StructType([*StructType.fromDDL("kind string").fields, row, *StructType.fromDDL("rid long, seq int, h binary, body binary").fields])
    out = written(held.join(side, "rid").select("row", "rid", "text", "shared").mapInArrow(_encode_shared(ranks_path), schema))
    chunk = out.where("kind = 'chunk'").select("h", F.col("body").alias("ids"))
    holes = out.where("kind = 'hole'").select("rid", "seq", "h").join(chunk, "h").select(F.lit(None).cast(row.dataType).alias("row"), "rid", "seq", F.col("ids").alias("body"))
    parts = out.where("kind = 'piece'").select("row", "rid", "seq", "body").union(holes)
    whole = parts.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "body"))), lambda p: p["body"]).alias("parts"))
    return alone.union(whole.select("row", "parts").mapInArrow(_put_together(ranks_path, outputs), end))
