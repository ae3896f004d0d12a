"""LM scoring: a bigram model whose n-grams are kept in Elias-Fano tries, one for each shard.

Tokens are words (runs of bytes other than ASCII white space, A-Z as a-z) and an end token for each text. A word's probability after a
context is smoothed with its own: p(w | c) = (n(c, w) + m * p(w)) / (n(c) + m) with p(w) = (n(w) + 1) / (N + V + 1), which sums to
one. Each context takes m from STRENGTHS by the leave-one-out likelihood of all that follows it in training texts; frequent contexts,
where m hardly matters, take the first.

Texts are staged as blocks of distinct words and token numbers. Each block asks shards about its distinct words, then about
its distinct pairs: what is sent grows with the corpus but a frequent word or pair is sent once a block. A shard counts, and
builds its trie in a memory-mapped file in the task's own temporary folder, which goes with the task: Elias-Fano levels for contexts, for pointers
from a context to its successors and for successors (numbers in the shard's vocabulary, relative to their context), with each pair's
smoothed probability and each context's share of the smoothing as 16 bits of their logarithms (STEP). Pairs are found by successor search within their
context's range; a pair that the trie lacks has its context's share of the word's own probability, and a context that it lacks leaves the word's own.
Successors of contexts that make up 1 / HOT of all tokens or more are split over SPLIT nodes by the word, so no shard gets a frequent context whole.

Null texts are empty: the end token alone. Rows are scored one by one. Without training texts every probability is 1.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import texts as T
from .blocks import pack, unpack
from .common import blocks as sliced
from .common import drop, partitions, small_batches, stage, text_bytes
from .eliasfano import EliasFano

_U64 = np.uint64
#: Hashes of the end token and of the context of a text's first token.
END, START = _U64(0x5851F42D4C957F2D), _U64(0x14057B7EF767814F)
STRENGTHS = (32.0, 8.0, 128.0, 2.0, 512.0, 4096.0)
HOT, SPLIT = 2000, 64
#: Values are 2^(-(q - 1) / STEP), q of 16 bits: within 0.14 % of what they stand for.
STEP = 256
BYTES = 10 << 20

_TOKENS = "block long, ids array<long>, held binary, first binary, words binary, tokens binary"


def token_blocks(docs: DataFrame, held: Column) -> DataFrame:
    """Blocks of docs(doc_id, text): distinct words by falling frequency and the texts' tokens as their numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, out, marks, sizes, held_bytes = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words, tokens, times = np.unique(np.concatenate(out), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            planes = rank[tokens].view(np.uint8).reshape(-1, 4).T
            first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            return pa.record_batch({"block": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([pack(np.array(marks, np.uint8))], pa.binary()), "first": pa.array([pack(first)], pa.binary()), "words": pa.array([pack(words[order])], pa.binary()), "tokens": pa.array([pack(planes)], pa.binary())})

        for x in sliced(batches, limit=1 << 20):
            data, offsets = text_bytes(x.column("text"))
            if ids and held_bytes + len(data) > BYTES:
                yield block()
                number, ids, out, marks, sizes, held_bytes = number + 1, [], [], [], [], 0
            starts, ends, first = T.spans(data, offsets)
            words = T.hash_spans(data, starts, ends)
            out.append(np.insert(words, first[1:], END))
            ids += x.column("doc_id").to_pylist()
            marks += x.column("held").to_pylist()
            sizes.append(np.diff(first) + 1)
            held_bytes += len(data)
        if ids:
            yield block()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    return B.bucketed(slim.mapInArrow(run, _TOKENS), "block")


class Block:
    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], unpack(row["held"], np.uint8).astype(bool)
        self.first, self.words = unpack(row["first"], np.int64), unpack(row["words"], _U64)
        planes = unpack(row["tokens"], np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32).astype(np.int64)
        self.owner = T.owners(self.first)
        self.trains = ~self.held[self.owner]
        self.order = np.argsort(self.words)  # words by hash, as shards see them

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's pair (context, token), the distinct pairs, and for each token the number of its pair; START is len(words)."""
        n = len(self.words)
        context = np.concatenate([[n], self.tokens[:-1]])
        context[self.first[:-1]] = n
        return np.unique(context * np.int64(n + 1) + self.tokens, return_inverse=True)

    def nodes(self, pairs: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node (63 bits of hash) and word of the distinct pairs: a hot context has SPLIT nodes."""
        n = len(self.words)
        hashes = np.append(self.words, START)
        context, word = hashes[pairs // (n + 1)], self.words[pairs % (n + 1)]
        split = np.isin(np.append(self.words, START), hot)[pairs // (n + 1)]
        node = np.where(split, context + ((word >> _U64(20)) % _U64(SPLIT) + _U64(1)) * _U64(0x9E3779B97F4A7C15), context)
        return T.mix(node) >> _U64(1), word


def _cut(sorted_hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    edges = (np.arange(shards + 1, dtype=np.float64) / shards * 2.0**bits)
    cut = np.searchsorted(sorted_hashes, edges[:-1].astype(_U64))
    return np.append(cut, len(sorted_hashes))


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                words, counts = b.words[b.order], b.word_counts()[b.order].astype(np.uint32)
                cut = _cut(words, 64, shards)
                some = np.flatnonzero(np.diff(cut)).tolist()
                yield pa.record_batch({"block": pa.array([row["block"]] * len(some), pa.int64()), "shard": pa.array(some, pa.int32()), "words": pa.array([pack(words[cut[s] : cut[s + 1]]) for s in some], pa.binary()), "counts": pa.array([pack(counts[cut[s] : cut[s + 1]]) for s in some], pa.binary())})

    return run


_ANSWER = "block long, shard int, pairs boolean, data binary, hash long, n long"


def _answers(block: list, shard: int, pairs: bool, data: list, hashes: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.Table:
    more = 0 if hashes is None else len(hashes)
    return pa.table({
        "block": pa.array(block + [-2] * more, pa.int64()), "shard": pa.array([shard] * (len(block) + more), pa.int32()), "pairs": pa.array([pairs] * (len(block) + more)),
        "data": pa.array(data + [None] * more, pa.binary()), "hash": pa.array([None] * len(block) + ([] if hashes is None else hashes.view(np.int64).tolist()), pa.int64()), "n": pa.array([None] * len(block) + ([] if n is None else n.tolist()), pa.int64()),
    })


def _count_words(table: pa.Table) -> pa.Table:
    """Of one shard: to each block its words' training counts; as block -2 frequent words, as -3 the end token, as -1 V and N."""
    lists = [unpack(x, _U64) for x in table.column("words").to_pylist()]
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    words, at = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(at, counts, len(words)).astype(np.int64)
    ends = np.cumsum([len(x) for x in lists])
    answers = [pack(total[a].astype(np.uint64)) for a in np.split(at, ends[:-1])]
    often = np.flatnonzero((total > 0) & (total >= total.sum() // HOT))
    out = _answers(table.column("block").to_pylist(), table.column("shard")[0].as_py(), False, answers, words[often], total[often])
    ends = int(total[words == END].sum())
    sums = pa.table({"block": pa.array([-1, -3], pa.int64()), "shard": pa.array([out.column("shard")[0].as_py()] * 2, pa.int32()), "pairs": pa.array([False] * 2), "data": pa.array([None] * 2, pa.binary()), "hash": pa.array([int((total > 0).sum()), 0], pa.int64()), "n": pa.array([int(total.sum()), ends], pa.int64())})
    return pa.concat_tables([out, sums])


def _planes(words: np.ndarray) -> bytes:
    """The words' upper 48 bits, by bytes."""
    return pack(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, 2:].T)


def _words(raw: bytes) -> np.ndarray:
    planes = unpack(raw, np.uint8).reshape(6, -1)
    return np.ascontiguousarray(np.concatenate([planes, np.zeros((2, planes.shape[1]), np.uint8)]).T).reshape(-1).view(_U64)


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log2(p) * STEP), 0, 65_535).astype(np.uint16)


def _probability(q: np.ndarray) -> np.ndarray:
    return 2.0 ** (q.astype(float) / -STEP)


def _own_counts(b: Block, answers: list[dict]) -> np.ndarray:
    counts = np.empty(len(b.words), np.int64)
    counts[b.order] = np.concatenate([unpack(r["data"], _U64) for r in sorted(answers, key=lambda r: r["shard"])]).astype(np.int64)
    return counts


def _ask_pairs(shards: int, vocabulary: int, tokens: int, hot: np.ndarray):
    def run(answers: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {k: [] for k in ("nodes", "many", "words", "counts", "own")}
        some, block = [], None
        if blocks.num_rows:
            row = blocks.slice(0, 1).to_pylist()[0]
            b, block = Block(row), row["block"]
            own = _quantised((_own_counts(b, answers.to_pylist()) + 1.0) / (tokens + vocabulary + 1.0))
            distinct, at = b.pairs()
            counts = np.bincount(at[b.trains], minlength=len(distinct)).astype(np.uint32)
            node, word = b.nodes(distinct, hot)
            order = np.lexsort((word, node))
            node, word, counts, own = node[order], word[order], counts[order], own[distinct % (len(b.words) + 1)][order]
            cut = _cut(node, 63, shards)
            some = np.flatnonzero(np.diff(cut)).tolist()
            for s in some:
                part = slice(cut[s], cut[s + 1])
                nodes, many = np.unique(node[part], return_counts=True)
                for k, v in (("nodes", pack(nodes)), ("many", pack(many.astype(np.uint32))), ("words", _planes(word[part])), ("counts", pack(counts[part])), ("own", pack(own[part].view(np.uint8).reshape(-1, 2).T))):
                    out[k].append(v)
        return pa.table({"block": pa.array([block] * len(some), pa.int64()), "shard": pa.array(some, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    return run


class Trie:
    """Contexts with their shares of smoothing, their successors and the successors' quantised probabilities, in one memory-mapped file."""

    def __init__(self, node: np.ndarray, word: np.ndarray, value: np.ndarray, share: np.ndarray, folder: str):
        """node (63 bits), word (48 bits), value (16 bits): sorted by node and word, each pair once; share (16 bits): of each distinct node."""
        nodes, begin = np.unique(node, return_index=True)
        vocabulary, rank = np.unique(word, return_inverse=True)
        wide = len(vocabulary) + 1
        successors = np.repeat(np.arange(len(nodes)), np.diff(np.append(begin, len(node)))) * np.int64(wide) + rank
        levels = [EliasFano(nodes, 1 << 63), EliasFano(vocabulary, 1 << 48), EliasFano(np.append(begin, len(node)), len(node) + 1), EliasFano(successors, len(nodes) * wide + 1)]
        arrays = [a for level in levels for a in level.arrays()] + [share, value]
        path = os.path.join(folder, "trie")
        mapped, at = [], 0
        with open(path, "wb") as file:
            for a in arrays:
                file.write(a.tobytes() + bytes(-a.nbytes % 8))
        for a in arrays:
            mapped.append(np.memmap(path, a.dtype, "r", at, a.shape) if a.size else a)
            at += a.nbytes + -a.nbytes % 8
        self.nodes, self.vocabulary, self.pointers, self.successors = (EliasFano.load(mapped[4 * i : 4 * i + 4]) for i in range(4))
        self.share, self.value, self.wide = mapped[-2], mapped[-1], wide

    def _find(self, level: EliasFano, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(level.successor(x), max(0, len(level) - 1))
        return at, level[at] == x

    def values(self, nodes: np.ndarray, many: np.ndarray, word: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Quantised probabilities of pairs, many for each of nodes; own: those of the words alone."""
        out = own.copy()
        if not len(self.value):
            return out
        node, has = self._find(self.nodes, nodes)
        low, high = self.pointers[node].astype(np.int64), self.pointers[node + 1].astype(np.int64)
        node, low, high, has = (np.repeat(v, many) for v in (node, low, high, has))
        out[has] = np.minimum(own[has].astype(np.int64) + self.share[node[has]], 65_535)
        rank, known = self._find(self.vocabulary, word)
        some = np.flatnonzero(has & known)
        x = (node[some] * self.wide + rank[some]).astype(_U64)
        at = self.successors.successor(x, low[some], high[some])  # within the context's range
        inside = at < high[some]
        some, x, at = some[inside], x[inside], at[inside]
        same = self.successors[at] == x
        out[some[same]] = self.value[at[same]]
        return out


def _strengths(node: np.ndarray, count: np.ndarray, own: np.ndarray, total: np.ndarray, strengths: tuple[float, ...]) -> np.ndarray:
    """Of each node (numbers from 0, with total tokens after it) the strength of most leave-one-out likelihood; of equal ones the first."""
    best, strength = np.full(len(total), -np.inf), np.full(len(total), strengths[0])
    for m in strengths:
        left_out = np.log2((count - 1 + m * own) / (total[node] - 1 + m))
        likely = np.bincount(node, count * left_out, len(total))
        better = likely > best + 1e-9 * np.abs(likely)
        best[better], strength[better] = likely[better], m
    return strength


def _count_pairs(total_of: dict[int, int], strengths: tuple[float, ...]):
    """total_of: training tokens after each hot node's context."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [(unpack(r["nodes"], _U64), unpack(r["many"], np.uint32), _words(r["words"]) >> _U64(16), np.ascontiguousarray(unpack(r["own"], np.uint8).reshape(2, -1).T).reshape(-1).view(np.uint16)) for r in rows]
        counts = np.concatenate([unpack(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        seen = counts > 0
        node = np.concatenate([np.repeat(a, m) for a, m, _, _ in asked])[seen]
        word, own, counts = np.concatenate([w for _, _, w, _ in asked])[seen], np.concatenate([o for *_, o in asked])[seen], counts[seen]
        order = np.lexsort((word, node))
        node, word, own, counts = node[order], word[order], own[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (word[1:] != word[:-1])])) if len(node) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, new) if len(new) else counts
        node, word, own = node[new], word[new], _probability(own[new])
        nodes, at = np.unique(node, return_inverse=True)
        total = np.bincount(at, counts, len(nodes))
        hot = np.isin(nodes, np.array(list(total_of), _U64))
        total[hot] = [total_of[n] for n in nodes[hot].tolist()]
        m = np.where(hot, strengths[0], _strengths(at, counts, own, total, strengths))
        value, share = _quantised((counts + m[at] * own) / (total[at] + m[at])), _quantised(m / (total + m))
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(node, word, value, share, folder)
            answers = [pack(trie.values(*a)) for a in asked]
            del trie
        return _answers([r["block"] for r in rows], rows[0]["shard"], True, answers)

    return run


def _score(vocabulary: int, tokens: int, hot: np.ndarray):
    def run(answers: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        if blocks.num_rows:
            b = Block(blocks.slice(0, 1).to_pylist()[0])
            rows = answers.to_pylist()
            counts = _own_counts(b, [r for r in rows if not r["pairs"]])
            distinct, at = b.pairs()
            node, word = b.nodes(distinct, hot)
            order = np.lexsort((word, node))
            value = np.empty(len(distinct), np.uint16)
            value[order] = np.concatenate([unpack(r["data"], np.uint16) for r in sorted(rows, key=lambda r: r["shard"]) if r["pairs"]])
            own = np.log10((counts + 1.0) / (tokens + vocabulary + 1.0))
            texts = len(b.ids)
            out["doc_id"], out["held_out"] = b.ids, b.held.tolist()
            out["n_tokens"] = np.diff(b.first).tolist()
            out["n_known"] = np.bincount(b.owner, counts[b.tokens] > 0, texts).astype(np.int64).tolist()
            out["base_score"] = np.bincount(b.owner, own[b.tokens], texts).tolist()
            out["score"] = np.bincount(b.owner, (value * (-np.log10(2) / STEP))[at], texts).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "held_out": pa.array(out["held_out"], pa.bool_()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    return run


def score(docs: DataFrame, held: Column, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """Scores of all rows of docs(doc_id, text) by a model of those whose held is false: doc_id, held_out, n_tokens, n_known (tokens
    that training texts have), train_tokens, base_score (the words' own log10 probabilities) and score (the model's)."""
    spark = docs.sparkSession
    shards = 2 * partitions(spark)
    blocks = token_blocks(docs, held)
    asked = blocks.mapInArrow(_ask_words(shards), "block long, shard int, words binary, counts binary")
    words = stage(asked.groupBy("shard").applyInArrow(_count_words, _ANSWER))
    vocabulary, tokens = words.where("block = -1").agg(F.coalesce(F.sum("hash"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most HOT words have 1 / HOT of all tokens each
    often = {r["hash"] & (1 << 64) - 1: r["n"] for r in words.where((F.col("block") == -2) & (F.col("n") * HOT >= tokens)).select("hash", "n").collect()}
    starts = words.where("block = -3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    contexts = {h: n for h, n in often.items() if h != int(END)} | {int(START): starts}
    hot = np.array(sorted(contexts), _U64)
    step = np.arange(1, SPLIT + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    total_of = {int(x): n for h, n in contexts.items() for x in T.mix(_U64(h) + step) >> _U64(1)}
    counts = words.where("block >= 0").select("block", "shard", "pairs", "data")
    asked = counts.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_ask_pairs(shards, vocabulary, tokens, hot), "block long, shard int, nodes binary, many binary, words binary, counts binary, own binary")
    pairs = stage(asked.groupBy("shard").applyInArrow(_count_pairs(total_of, strengths), _ANSWER))
    answers = counts.unionByName(pairs.select("block", "shard", "pairs", "data"))
    scored = stage(answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_score(vocabulary, tokens, hot), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    B.forget(blocks)
    drop(words)
    drop(pairs)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
