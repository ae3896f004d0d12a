"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, in numpy over blocks of documents. Trees are grown on the driver from a bounded
sample of labelled rows (SAMPLE) over features in at most BINS bins, and flattened into arrays; scoring walks all
trees for all rows of a block at once, one level a step. Null texts are empty; an empty text is scored like any other.
Without labels every score is 0.5; with one class only it is that class's share. Each row is scored by its text alone, so repeated rows have
equal scores, a null doc_id stays null and other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import map_blocks, text_bytes

#: Labelled ids that a model learns from at most: those whose hash is under a bound that about so many are under.
SAMPLE = 16_000
BINS = 64
TREES, DEPTH, RATE, L2, LEAST = 60, 4, 0.15, 2.0, 8.0

_CLASSES = np.zeros((9, 256), np.float32)
_CLASSES[0, ord("A") : ord("Z") + 1] = 1
_CLASSES[1, ord("a") : ord("z") + 1] = 1
_CLASSES[2, ord("0") : ord("9") + 1] = 1
_CLASSES[3, [0x20, *range(0x09, 0x0E)]] = 1
_CLASSES[4, 0x0A] = 1
_CLASSES[5, [ord(c) for c in ".,;:"]] = 1
_CLASSES[6, [ord(c) for c in "!?"]] = 1
_CLASSES[7, [ord(c) for c in "#$%&*+-/<=>@[\\]^_`{|}~()\"'"]] = 1
_CLASSES[8, 128:] = 1
NAMES = ["upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "high", "log_bytes", "word_length", "word_spread", "longest_word", "distinct_words", "repeats_previous", "top_word", "distinct_pairs", "line_words", "symbol_words", "short_words", "distinct_lines"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) numbers for each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    total = sizes.clip(1)
    for k, row in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(row[data], dtype=np.float64)])
        out[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / total
    out[:, 9] = np.log1p(sizes)
    starts, ends, first = T.spans(data, offsets)
    words, length = T.hash_spans(data, starts, ends), (ends - starts).astype(np.float64)
    owner, count = T.owners(first), np.diff(first).clip(1)
    if not len(words):
        return out

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=x, minlength=n) / count

    out[:, 10] = mean(length)
    out[:, 11] = np.sqrt(np.maximum(mean(length**2) - out[:, 10] ** 2, 0))
    has = np.diff(first) > 0
    out[has, 12] = np.maximum.reduceat(length, first[:-1][has])
    inside = np.ones(len(words), bool)
    inside[first[:-1][has]] = False
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    out[:, 14] = mean((same & inside).astype(float))

    def groups(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and size of each distinct (owner, value)."""
        order = np.lexsort((x, owner))
        x, owner = x[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])]))
        return owner[new], np.diff(np.append(new, len(x)))

    who, times = groups(words, owner)
    out[:, 13] = np.bincount(who, minlength=n) / count
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    out[:, 15] = top / count
    pairs = words[1:] * np.uint64(0x9FB21C651E98DF25) + words[:-1]
    if len(pairs := pairs[inside[1:]]):
        who, _ = groups(pairs, owner[1:][inside[1:]])
        out[:, 16] = np.bincount(who, minlength=n) / (count - 1).clip(1)
    out[:, 17] = count / (out[:, 4] * total + 1)
    symbol = np.concatenate([[0], np.cumsum(_CLASSES[7][data] + _CLASSES[6][data])])
    out[:, 18] = mean((symbol[ends] - symbol[starts] > 0).astype(float))
    out[:, 19] = mean((length <= 2).astype(float))
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.union1d(np.concatenate([breaks + 1, offsets[:-1]]), [len(data)])
    edges = edges[edges <= len(data)]
    line_start, line_end = edges[:-1], edges[1:]
    full = line_end - line_start > 1
    line_start, line_end = line_start[full], line_end[full]
    if len(line_start):
        owner = np.searchsorted(offsets, line_start, "right") - 1
        who, _ = groups(T.hash_spans(data, line_start, line_end - (data[line_end - 1] == 0x0A)), owner)
        out[:, 20] = np.bincount(who, minlength=n) / np.bincount(owner, minlength=n).clip(1)
    return out


@dataclass
class Forest:
    """Trees as arrays (trees, nodes): children of node i are 2i + 1 and 2i + 2; leaves are the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees at once, a level a step."""
        n, trees = len(x), np.arange(len(self.feature))[None, :]
        node = np.zeros((n, len(self.feature)), np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(DEPTH if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + (self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1) if len(self.feature) else 0.0)
        return 1 / (1 + np.exp(-margin)) * np.ones(n)


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the logistic loss; each level's histograms come from one count over all features."""
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else min(max(float(y[0]), 1e-6), 1 - 1e-6)
        return Forest(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (many, width, BINS)
            g = np.bincount(key, np.repeat(grad, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(h < LEAST) | (ht - h < LEAST)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, k = divmod(int(b), BINS)
                if gain[i, f, k] > 1e-6 and k < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][k]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - nodes
        value = -RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + L2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_fold(column: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves that remainder (false for null)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Learns labels(doc_id, quality) from the texts of docs; of rows with the same id in labels, the lowest label counts.

    At most sample ids are learned from, picked by a hash. Of rows of docs with the same id that with the least statistics counts;
    labels without an id, with other values than 0 and 1 or without a text are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    # about half a percent fewer than sample by their hash, so that the limit hardly ever cuts
    share = min(1.0, 0.995 * sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*text_bytes(block.column("text")))
        return pa.record_batch({"doc_id": block.column("doc_id"), "y": block.column("y"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    # picked has at most sample rows of two numbers
    rows = map_blocks(_slim(docs).join(F.broadcast(picked), "doc_id"), run, "doc_id long, y double, x array<double>")
    # of rows that repeat an id one counts, so at most sample rows reach the driver
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    return grow(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": block.column("doc_id"), "score": pa.array(model.score(statistics(*text_bytes(block.column("text")))))})

    return map_blocks(_slim(docs), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least least."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        good = model.score(statistics(*text_bytes(block.column("text")))) >= least
        return block.filter(pa.array(good))

    return map_blocks(docs, run, docs.schema)
