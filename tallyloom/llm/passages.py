"""Substring dedup: passages of WORDS words or more that occur in several documents, near-copies included.

Texts are sequences of shingles (runs of five words, A-Z as a-z). Under a hash function, all subsequences of at least T
shingles (50 words) whose least hash stands at place c form one compact window: c with the ranges of starts left and ends right
of it, as the Cartesian tree of the hashes has them. A text has about 2n/T windows for each function. Windows
of two documents with the same least shingle make the documents a candidate there, if the 15 words right or left of it are the same
too: keys of a window are the shingle with one of its sides (a passage has all the words of one side, but for edits closer than that).
Each run of 50 words has a key of its own besides: documents with that key do have a passage in common, so each meets the first one
that has it, even if keys of parts of the run lead to a document with less of it. Shards gather keys by block; the blocks with a
key form a tree of FAN branches by their order, and each is compared with the one above it, so that a passage
that all documents have costs each block one comparison and no block more than FAN.

A candidate pair is verified on the words themselves: the windows' common range must hold T shingles; runs of equal words
around the anchors are joined over small gaps while the shingles' Jaccard similarity stays at 0.8 or more; joined runs of 50 words count.
The first document in reading order keeps a passage, later ones have it as a copy. Repeats within a document are left alone.
Null and short texts have no passages; rows with equal texts are copies of each other. Each row is a document of its own with a key
of its own; ids are carried, not interpreted, so they may repeat or be null, and spans are reported with the doc_id of their row.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import texts as T
from .common import partitions, small_batches, stage, text_bytes

WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
#: Words that go to another block on either side of what windows reach over.
MARGIN = 60
#: Hash functions; branches of a tree of blocks; words that a gap between runs may have.
FUNCTIONS, FAN, GAP = 4, 64, 25
_T = WORDS - SHINGLE + 1
_SIDE = 10  # shingles to the side of an anchor that a key takes: 15 words
_U64 = np.uint64


class Words:
    """Words and shingles of a block's texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = T.spans(data, offsets)
        self.words = T.hash_spans(data, starts, ends)
        value = np.zeros(len(self.words), _U64)
        for k in range(SHINGLE):
            value[: len(value) - k] = value[: len(value) - k] * _U64(0x9FB21C651E98DF25) + self.words[k:]
        self.shingles = T.mix(value)
        # of each word: the end of its text's shingles
        counts = np.diff(self.first)
        self.stop = np.repeat(self.first[1:] - SHINGLE + 1, counts)
        self.start = np.repeat(self.first[:-1], counts)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U64)
    padded[:n] = v
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _nearest_smaller(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest smaller one before it in its group, or -1: the Cartesian tree's left bounds."""
    left = np.arange(len(v)) - 1
    todo = np.flatnonzero(left >= 0)
    while len(todo):
        at = left[todo]
        same = group[at] == group[todo]
        left[todo[~same]] = -1
        larger = same & (v[at] > v[todo])
        todo = todo[larger]
        left[todo] = left[left[todo]]
        todo = todo[left[todo] >= 0]
    return left


def _run_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each WORDS consecutive words, by doubling: runs of 2, 4, 8 and so on, joined to WORDS."""
    factor, span, have, out = 0x9FB21C651E98DF25, 1, words, None
    left, done = WORDS, 0
    while left:
        if left & 1:
            part = have[done:]
            out = part if out is None else out[: len(part)] * _U64(pow(factor, span, 1 << 64)) + part
            done += span
        left >>= 1
        if left:
            have = have[:-span] * _U64(pow(factor, span, 1 << 64)) + have[span:]
            span *= 2
    return T.mix(out)


def windows(x: Words) -> tuple[np.ndarray, ...]:
    """Compact windows of a block and its runs of WORDS words: key, place of the anchor (index of a word), first start and last end (shingles). By key, then by place."""
    n = len(x.shingles)
    keys, places, lefts, rights = [], [], [], []
    if n >= _T:
        fits = np.flatnonzero(np.arange(n - _T + 1) + _T <= x.stop[: n - _T + 1])
        run = _run_hashes(x.words)[fits] >> _U64(16)
        low = _U64(0xFFFFFF)
        for f in range(FUNCTIONS):
            v = T.mix(x.shingles ^ _U64((f + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            least = _sliding_least(v & ~low | np.arange(n, dtype=_U64) & low, _T)
            anchor = np.unique((least[fits] & low).astype(np.int64))
            if not len(anchor):
                continue
            h, owner = v[anchor], x.start[anchor]
            before = _nearest_smaller(h, owner)
            after = (len(h) - 1 - _nearest_smaller(h[::-1], owner[::-1]))[::-1]
            begin = np.where(before >= 0, anchor[before] + 1, owner)
            end = np.where(after < len(h), anchor[np.minimum(after, len(h) - 1)], x.stop[anchor])
            keys.append(T.mix(h + _U64(f + 1)))
            places.append(anchor)
            lefts.append(begin)
            rights.append(end)
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(_U64), none, none, none
    key, place, left, right = (np.concatenate(z) for z in (keys, places, lefts, rights))
    side, where = [], []
    for sign in (1, -1):
        far = place + sign * _SIDE
        inside = np.flatnonzero((far < x.stop[place]) & (far >= x.start[place]))
        refined = key[inside] + _U64(2 + sign)
        for step in range(SHINGLE, _SIDE + 1, SHINGLE):
            refined = T.mix(refined + x.shingles[place[inside] + sign * step])
        side.append(refined)
        where.append(inside)
    at = np.concatenate(where)
    key, place, left, right = np.concatenate([*(z >> _U64(16) for z in side), run]), *(np.concatenate(z) for z in ((place[at], fits), (left[at], fits), (right[at], fits + _T)))
    order = np.argsort(place, kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    return key[order], place[order], left[order], right[order]


def _first_of(key: np.ndarray) -> np.ndarray:
    """The index of each key's first place, of keys in order."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _questions(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's distinct keys, by ranges of keys: block, shard, keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, data, offsets = B.texts_of(row)
                key, place, _, _ = windows(Words(data, offsets))
                key = key[_first_of(key)]
                cut = np.searchsorted(key, (np.arange(shards + 1, dtype=np.float64) / shards * 2.0**48).astype(_U64))
                cut[-1] = len(key)
                some = np.flatnonzero(np.diff(cut)).tolist()
                packed = [B.pack(np.ascontiguousarray(key[cut[s] : cut[s + 1]]).view(np.uint8).reshape(-1, 8)[:, :6].T) for s in some]
                yield pa.record_batch({"block": pa.array([row["block"]] * len(some), pa.int64()), "shard": pa.array(some, pa.int32()), "keys": pa.array(packed, pa.binary())})

    return blocks.mapInArrow(run, "block long, shard int, keys binary")


def _keys(raw: bytes) -> np.ndarray:
    planes = B.unpack(raw, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.reshape(-1).view(_U64)


def _requests(table: pa.Table) -> pa.Table:
    """Of one shard: for each block and block above it in a key's tree, those keys."""
    block = table.column("block").to_numpy()
    order = np.argsort(block)
    lists = [_keys(x) for x in table.column("keys").to_pylist()]
    key = np.concatenate([lists[i] for i in order])
    owner = np.repeat(np.arange(len(order), dtype=np.int32), [len(lists[i]) for i in order])
    at = np.argsort(key, kind="stable")
    key, owner = key[at], owner[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    rank = np.arange(len(key)) - head
    later = np.flatnonzero(rank > 0)
    above = owner[head[later] + (rank[later] - 1) // FAN]
    below, key = owner[later], key[later]
    at = np.lexsort((key, below, above))
    above, below, key = above[at], below[at], key[at]
    cut = np.flatnonzero(np.concatenate([[True], (above[1:] != above[:-1]) | (below[1:] != below[:-1])])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(key)) if len(cut) else cut
    names = block[order]
    return pa.table({
        "above": pa.array(names[above[cut]], pa.int64()), "below": pa.array(names[below[cut]], pa.int64()),
        "keys": pa.array([B.pack(key[a:b].view(np.uint8).reshape(-1, 8)[:, :6].T) for a, b in zip(cut, ends, strict=True)], pa.binary()),
    })


_REPLY = "block long, keys binary, doc binary, place binary, left binary, right binary, base binary, rows array<long>, ids array<long>, first binary, words binary"


def _reply(requests: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of one block: to each block that asked, where its keys first stand here, and the words of those documents."""
    out = {k: [] for k in ("block", "keys", "doc", "place", "left", "right", "base", "rows", "ids", "first", "words")}
    if requests.num_rows and blocks.num_rows:
        block = blocks.slice(0, 1).to_pylist()[0]
        rows, (ids, data, offsets) = block["rows"], B.texts_of(block)
        x = Words(data, offsets)
        key, place, left, right = windows(x)
        first = _first_of(key)
        known = key[first]
        asked = defaultdict(list)
        for below, raw in zip(requests.column("below").to_pylist(), requests.column("keys").to_pylist(), strict=True):
            asked[below].append(_keys(raw))
        words = x.words.astype(np.uint32)
        for below, lists in asked.items():
            wanted = np.unique(np.concatenate(lists))
            at = first[np.searchsorted(known, wanted)]
            doc = np.searchsorted(x.first, place[at], "right") - 1
            docs, doc = np.unique(doc, return_inverse=True)
            # of a document goes what its windows reach over, and MARGIN words on either side
            begin, stop = np.full(len(docs), len(words)), np.zeros(len(docs), np.int64)
            np.minimum.at(begin, doc, left[at] - MARGIN)
            np.maximum.at(stop, doc, right[at] + SHINGLE - 1 + MARGIN)
            begin, stop = np.maximum(begin, x.first[docs]), np.minimum(stop, x.first[docs + 1])
            out["block"].append(below)
            for name, value in (("keys", wanted), ("doc", doc.astype(np.int32)), ("place", (place[at] - begin[doc]).astype(np.int32)), ("left", (left[at] - begin[doc]).astype(np.int32)), ("right", (right[at] - begin[doc]).astype(np.int32)), ("base", (begin - x.first[docs]).astype(np.int64)), ("first", np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)), ("words", np.concatenate([words[a:b] for a, b in zip(begin, stop, strict=True)]))):
                out[name].append(B.pack(value))
            out["rows"].append([rows[d] for d in docs])
            out["ids"].append([ids[d] for d in docs])
    return pa.table({"block": pa.array(out["block"], pa.int64()), **{k: pa.array(out[k], pa.binary()) for k in ("keys", "doc", "place", "left", "right", "base")}, **{k: pa.array(out[k], pa.list_(pa.int64())) for k in ("rows", "ids")}, "first": pa.array(out["first"], pa.binary()), "words": pa.array(out["words"], pa.binary())})


def _runs(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of a[i] == b[i - shift] of at least SHINGLE words: (start, end, shift)."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    same = np.zeros(high - low + 2, bool)
    same[1:-1] = a[low:high] == b[low - shift : high - shift]
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + low
    long = edge[edge[:, 1] - edge[:, 0] >= SHINGLE]
    return [(int(s), int(e), shift) for s, e in long]


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b start with in common."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def _onward(a: np.ndarray, b: np.ndarray, runs: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Runs at other shifts that begin within GAP words of the end of one of runs, and of those, and so on."""
    seen, found = set(runs), set()
    for run in runs:
        while True:
            end, e = run[1], run[1] - run[2]
            x, y = a[end : end + GAP + SHINGLE], b[e : e + GAP + SHINGLE]
            if min(len(x), len(y)) < SHINGLE:
                break
            same = x[:, None] == y[None, :]
            rows, cols = len(x) - SHINGLE + 1, len(y) - SHINGLE + 1
            match = same[:rows, :cols].copy()
            for k in range(1, SHINGLE):
                match &= same[k : k + rows, k : k + cols]
            i, j = np.nonzero(match)
            if not len(i):
                break
            near = int(np.argmin(i + j))
            start, other = end + int(i[near]), e + int(j[near])
            run = (start, start + _equal(a[start:], b[other:]), start - other)
            if run in seen:
                break
            seen.add(run)
            found.add(run)
    return found


def alike(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Near-equal passages of word arrays a and b around pairs of anchors: (start, end) in a, (start, end) in b.

    Runs at the anchors' shifts are followed both ways to runs at other shifts, so words may be missing or inserted anywhere.
    """
    known = {r for s in {p - q for p, q in places} for r in _runs(a, b, s)}
    m, n = len(a), len(b)
    turned = _onward(a[::-1], b[::-1], {(m - e, m - s, m - n - shift) for s, e, shift in known})
    runs = sorted(known | _onward(a, b, known) | {(m - e, m - s, m - n - shift) for s, e, shift in turned})
    out, chain = [], None

    def close() -> None:
        if chain is not None and min(chain[1] - chain[0], chain[3] - chain[2]) >= WORDS:
            out.append(tuple(chain[:4]))

    for start, end, shift in runs:
        s, e = start - shift, end - shift
        if chain is not None and end > chain[1]:
            over = max(0, chain[1] - start, chain[3] - s)  # words that end one run and begin the next belong to the first
            if 0 < over <= end - start - SHINGLE and over < SHINGLE:
                start, s = start + over, s + over
        if chain is not None and start >= chain[1] and s >= chain[3] and max(start - chain[1], s - chain[3]) <= GAP:
            both = chain[4] + end - start - SHINGLE + 1
            union = (end - chain[0]) + (e - chain[2]) - 2 * (SHINGLE - 1) - both
            if both >= SIMILARITY * union:
                chain = [chain[0], end, chain[2], e, both]
                continue
        if chain is not None and end <= chain[1]:
            if end - start >= WORDS > chain[3] - chain[2]:
                out.append((start, end, s, e))
            continue  # inside what is found
        close()
        chain = [start, end, s, e, end - start - SHINGLE + 1]
    close()
    return out


def _distinct(*columns: np.ndarray) -> list[list[int]]:
    """The distinct rows of the columns, in order."""
    rows = np.stack([np.asarray(c, np.int64) for c in columns], axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new].tolist()


def _verify(replies: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of one block: its documents' passages that an earlier document has, and those earlier ones', overlapping ones joined."""
    found: dict[tuple, set] = defaultdict(set)
    if blocks.num_rows:
        block = blocks.slice(0, 1).to_pylist()[0]
        rows, (ids, data, offsets) = block["rows"], B.texts_of(block)
        x = Words(data, offsets)
        key, place, left, right = windows(x)
        doc = np.searchsorted(x.first, place, "right") - 1
        words = x.words.astype(np.uint32)
        pairs: dict[tuple, set] = defaultdict(set)
        sides: dict[tuple, tuple] = {}
        # copies within the block: each document with the key's first one here
        first = _first_of(key)
        head = np.repeat(first, np.diff(np.append(first, len(key))))
        i = np.flatnonzero(doc != doc[head])
        h = head[i]
        common = np.minimum(place[i] - left[i], place[h] - left[h]) + np.minimum(right[i] - place[i], right[h] - place[h])
        i, h = i[common >= _T], h[common >= _T]
        for d, other, shift in _distinct(doc[i], doc[h], (place[i] - x.first[doc[i]]) - (place[h] - x.first[doc[h]])):
            pairs[d, -1, other].add((shift, 0))
        for n, r in enumerate(replies.to_pylist()):
            keys, rdoc, rplace, rleft, rright = B.unpack(r["keys"], _U64), *(B.unpack(r[k], np.int32) for k in ("doc", "place", "left", "right"))
            rfirst, rwords = B.unpack(r["first"], np.int64), B.unpack(r["words"], np.uint32)
            sides[n] = (r["rows"], r["ids"], rfirst, rwords, B.unpack(r["base"], np.int64))
            # the block's windows with each of the reply's keys: the work follows the reply's size
            low, many = np.searchsorted(key, keys), np.searchsorted(key, keys, "right")
            many -= low
            at = np.repeat(np.arange(len(keys)), many)
            hit = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]
            common = np.minimum(place[hit] - left[hit], rplace[at] - rleft[at]) + np.minimum(right[hit] - place[hit], rright[at] - rplace[at])
            hit, at = hit[common >= _T], at[common >= _T]
            for d, other, shift in _distinct(doc[hit], rdoc[at], place[hit] - x.first[doc[hit]] - rplace[at]):
                pairs[d, n, other].add((shift, 0))
        for (d, n, other), places in pairs.items():
            a = words[x.first[d] : x.first[d + 1]]
            if n < 0:
                b, row, name, base = words[x.first[other] : x.first[other + 1]], rows[other], ids[other], 0
            else:
                numbers, names, rfirst, rwords, rbase = sides[n]
                b, row, name, base = rwords[rfirst[other] : rfirst[other + 1]], numbers[other], names[other], int(rbase[other])
            for s, e, s2, e2 in alike(a, b, list(places)):
                found[rows[d], ids[d], True].add((s, e))
                found[row, name, False].add((base + s2, base + e2))
    out = [(row, name, s, e, copy) for (row, name, copy), spans in sorted(found.items(), key=lambda x: (x[0][0], x[0][2])) for s, e in _joined(spans)]
    cols = list(zip(*out, strict=True)) or [[]] * 5
    return pa.table({"row": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "start": pa.array(cols[2], pa.int32()), "end": pa.array(cols[3], pa.int32()), "copy": pa.array(cols[4], pa.bool_())})


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, copy: the repeated passages of docs(doc_id, text).

    copy: an earlier document has the passage; else later ones have it. A document's passages of one kind don't overlap; of a
    copy and another passage that overlap, the copy counts for the overlap. Each row is a document; rows of one id have passages each.
    """
    return _of_rows(docs).drop("row")


def _of_rows(docs: DataFrame, row: str | None = None) -> DataFrame:
    """repeated() with the key of each row; row names its column in docs."""
    spark = docs.sparkSession
    blocks = B.of_texts(docs, row=row)
    requests = _questions(blocks, partitions(spark)).groupBy("shard").applyInArrow(_requests, "above long, below long, keys binary")
    replies = requests.groupBy("above").cogroup(blocks.groupBy("block")).applyInArrow(_reply, _REPLY)
    found = stage(replies.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_verify, "row long, doc_id long, start int, end int, copy boolean"))
    B.forget(blocks)
    lists = found.distinct().groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "end", "copy")).alias("spans"))  # at most FAN a key and place

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                copies = _joined([(s["start"], s["end"]) for s in row["spans"] if s["copy"]])
                first = []
                for s, e in _joined([(s["start"], s["end"]) for s in row["spans"] if not s["copy"]]):
                    for a, b in copies:
                        if a < e and b > s:
                            if a > s:
                                first.append((s, a))
                            s = max(s, b)
                    if s < e:
                        first.append((s, e))
                rows += [(row["row"], row["doc_id"], s, e, e - s, True) for s, e in copies] + [(row["row"], row["doc_id"], s, e, e - s, False) for s, e in first]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch({"row": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "start_word": pa.array(cols[2], pa.int32()), "end_word": pa.array(cols[3], pa.int32()), "n_words": pa.array(cols[4], pa.int32()), "copy": pa.array(cols[5], pa.bool_())})

    return lists.mapInArrow(run, "row long, doc_id long, start_word int, end_word int, n_words int, copy boolean")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs, with all columns, whose texts lack the passages that an earlier document has.

    A document that had words and keeps none is left out; all others stay. Rows are documents, whether their doc_id repeats or is null.
    n_chars, if docs has it, is counted anew for texts that changed.
    """
    mark, row = (f"_{uuid.uuid4().hex}" for _ in range(2))
    small_batches(docs.sparkSession)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))  # so that a row has the same number in both reads
    spans = _of_rows(numbered, row).where("copy").groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(mark))
    joined = numbered.join(spans, row, "left").select(*docs.columns, mark)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column("text").to_pylist(), batch.column(mark).to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            starts, _, first = T.spans(data, offsets)
            stays = np.ones(batch.num_rows, bool)
            chars = batch.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, cuts in enumerate(spans):
                if cuts:
                    edges = np.append(starts[first[i] : first[i + 1]], offsets[i + 1])
                    last, parts = offsets[i], []
                    for c in cuts:
                        parts.append(data[last : edges[min(c["start_word"], len(edges) - 1)]].tobytes())
                        last = edges[min(c["end_word"], len(edges) - 1)]
                    parts.append(data[last : offsets[i + 1]].tobytes())
                    left = b"".join(parts).decode()
                    stays[i] = bool(left.strip(" \t\n\x0b\x0c\r"))
                    text[i] = left
                    if chars is not None:
                        chars[i] = len(left)
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(text, pa.string())
            if chars is not None:
                columns["n_chars"] = pa.array(chars, batch.column("n_chars").type)
            yield pa.record_batch(columns).filter(pa.array(stays))

    return joined.mapInArrow(run, schema)
