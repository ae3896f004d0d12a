"""Lexical retrieval packing: documents are packed into sequences next to their BM25 neighbours.

Documents become token ids with an end token. They are dealt into shards by ranges of a min-hash of their token triples, so that texts
with passages in common tend to share a shard; a large group of equal hashes spreads over several shards by doc_id. A task goes
through its range in shards of about SHARD tokens. Each shard has an inverted index from token to documents with BM25 weights. A
seed document's terms are all looked up; the best unused documents fill its window one after the other. What
doesn't fit of the last one is the seed of the next window, so windows are full. Without unused neighbours the next unused document
fills on. What remains at the end of a range is cut into sequences whose lengths are powers of two, which need no padding.

Null and empty texts are the end token alone. Rows are packed one by one, repeated or not; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import map_blocks, partitions, small_batches, stage
from .tokens import encoder

LENGTH, END = 4096, 2
#: Tokens of a shard, about.
SHARD = 4_000_000
#: Neighbours that are sorted first.
BEST = 64
#: Share of a shard's documents beyond which a term's weights are kept as a row.
COMMON = 0.125
K1, B = 1.2, 0.75


def tokenised(docs: DataFrame, name: str, end: int = END) -> DataFrame:
    """doc_id, ids (32-bit or, if the vocabulary allows, 16-bit little-endian), sig (a min-hash) of each row."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(name)
        ids, first = coder.encode_many(block.column("text").fill_null("").to_pylist(), end)
        kind = "<u2" if coder.whole.get_vocab_size() <= 1 << 16 else "<u4"
        h = ids.astype(np.uint64)
        h[:-2] = T.mix(h[:-2] + (h[1:-1] << np.uint64(20)) + (h[2:] << np.uint64(40)))
        # triples that reach into the next text count for no text, but for texts too short to have others
        inner = np.ones(len(ids), bool)
        tail = first[1:, None] - np.array([1, 2])
        inner[tail[tail >= first[:-1, None]]] = False
        inner[first[:-1]] = True
        sig = np.minimum.reduceat(np.where(inner, h, np.uint64(0xFFFFFFFFFFFFFFFF)), first[:-1])
        raw, ids = ids.astype(kind).tobytes(), None
        at = (first * np.dtype(kind).itemsize).tolist()
        return pa.record_batch({"doc_id": block.column("doc_id"), "ids": pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), "sig": pa.array((sig >> np.uint64(1)).astype(np.int64)), "width": pa.array(np.full(block.num_rows, np.dtype(kind).itemsize, np.int32))})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_blocks(slim, run, "doc_id long, ids binary, sig long, width int")


class Index:
    """BM25 index of one shard's documents. ended: their last ids are end tokens, which all have, and are no terms."""

    def __init__(self, docs: list[np.ndarray], ended: bool = False):
        self.bodies = bodies = [d[:-1] for d in docs] if ended else docs
        sizes = np.array([len(d) for d in bodies], np.int64)
        flat, owner = np.concatenate(bodies), np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        term, doc = flat[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])[: len(term)])
        times = np.diff(np.append(new, len(term))).astype(np.float32)
        self.doc = doc[new]
        term = term[new]
        n = int(flat.max()) + 1 if len(flat) else 0
        self.begin = np.searchsorted(term, np.arange(n + 1))
        self.df = np.diff(self.begin)
        self.idf = np.log1p((len(docs) - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        norm = (K1 * (1 - B + B * sizes / max(1, sizes.mean()))).astype(np.float32)
        self.weight = self.idf[term] * times * np.float32(K1 + 1) / (times + norm[self.doc])
        # a term that COMMON of the documents have is a row of weights, so at most 4 / COMMON bytes a posting
        often = np.flatnonzero(self.df > COMMON * len(docs))
        self.row = np.full(n, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)), np.float32)
        at = self.row[term]
        self.rows[at[at >= 0], self.doc[at >= 0]] = self.weight[at >= 0]
        self.docs, self.unused = docs, np.ones(len(docs), bool)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; ties by position. They are sorted by the BEST best at first, then all."""
        terms = np.unique(self.bodies[seed])
        terms = terms[self.df[terms] > 1]
        if not len(terms):
            return
        row = self.row[terms]
        score = np.zeros(len(self.docs), np.float32)
        for r in row[row >= 0].tolist():
            score += self.rows[r]
        rare = terms[row < 0]
        slices = [slice(x, y) for x, y in zip(self.begin[rare].tolist(), self.begin[rare + 1].tolist(), strict=True)]
        if slices:
            score += np.bincount(np.concatenate([self.doc[s] for s in slices]), np.concatenate([self.weight[s] for s in slices]), len(self.docs)).astype(np.float32)
        score[~self.unused] = 0
        found = np.flatnonzero(score)
        last = np.partition(score[found], len(found) - BEST)[len(found) - BEST] if len(found) > 4 * BEST else 0
        for some in (found[score[found] >= last], found[score[found] < last]):
            yield from some[np.argsort(-score[some], kind="stable")].tolist()


def in_order(docs: list[np.ndarray], length: int, room: int, ended: bool = False) -> Iterator[int]:
    """The documents in the order in which they fill windows; room is what the first window has left. ended as in Index."""
    index = Index(docs, ended)
    after = 0
    seed = -1
    while True:
        if seed < 0:
            while after < len(docs) and not index.unused[after]:
                after += 1
            if after == len(docs):
                return
            seed = after
            index.unused[seed] = False
            yield seed
            room -= len(docs[seed])
        if room <= 0:  # cut: the rest of this document opens the next window
            room = length - (-room) % length
        for near in index.neighbours(seed):
            index.unused[near] = False
            yield near
            room -= len(docs[near])
            if room <= 0:
                break
        seed = near if room <= 0 else -1


def pack_tokens(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents, from tokens(doc_id, ids, sig, width): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() << 36, 0
        tail: list[list] = []  # pieces of the last sequence, which may stay short, and their ids
        names, docs, held = [], [], 0

        def shard() -> Iterator[list]:
            nonlocal sequence, filled, tail
            for i in in_order(docs, length, length - filled, ended=True):
                ids, at = docs[i], 0
                while at < len(ids):
                    size = min(length - filled, len(ids) - at)
                    tail.append([names[i], at, size, ids[at : at + size].astype("<u4"), len(ids), sequence, filled])
                    at, filled = at + size, filled + size
                    if filled == length:
                        yield from tail
                        sequence, filled, tail = sequence + 1, 0, []

        def end() -> Iterator[list]:
            """What is left, cut at the powers of two that it is the sum of."""
            left, number, room, at = filled, sequence, 0, 0
            for name, start, size, ids, total, _, _ in tail:
                done = 0
                while done < size:
                    if not room:
                        room, at = 1 << (left.bit_length() - 1), 0
                        left -= room
                        number += 1
                    some = min(room, size - done)
                    yield [name, start + done, some, ids[done : done + some], total, number - 1, at]
                    done, room, at = done + some, room - some, at + some

        def batch(pieces: list[list]) -> pa.RecordBatch:
            name, start, size, ids, total, seq, at = zip(*pieces, strict=True)
            crc = [zlib.crc32(x.tobytes()) for x in ids]
            cols = {"doc_id": name, "start": start, "length": size, "ids_crc32": crc, "doc_tokens": total, "sequence_id": seq, "offset": at}
            return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in cols.items()})

        for x in batches:
            for name, raw, width in zip(x.column("doc_id").to_pylist(), x.column("ids").to_pylist(), x.column("width").to_pylist(), strict=True):
                names.append(name)
                docs.append(np.frombuffer(raw, f"<u{width}"))
                held += len(docs[-1])
                if held >= SHARD:
                    if pieces := list(shard()):
                        yield batch(pieces)
                    names, docs, held = [], [], 0
        pieces = list(shard()) if docs else []
        pieces += end()
        if pieces:
            yield batch(pieces)

    small_batches(tokens.sparkSession)
    # a task's memory holds one shard; dealing by ranges of (sig, doc_id) splits groups of equal sig
    dealt = tokens.repartitionByRange(partitions(tokens.sparkSession), "sig", "doc_id").sortWithinPartitions("sig", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, name: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of all rows of docs(doc_id, text); see pack_tokens."""
    return pack_tokens(stage(tokenised(docs, name, end)), length)
