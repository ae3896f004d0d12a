"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (line) is hashed to a wide vector: EQUAL lanes of 64 bits from BLAKE2b of the whole paragraph and LANES
lanes of 16 bits, into which each of its word pairs (a word with the one before it in the paragraph; the k-th
occurrence of a pair in a paragraph is a pair of its own) puts +1 or -1 at a hashed lane. A text's fingerprint is the sum of its paragraphs' vectors, modulo 2^64 and 2^16, beside the
numbers of paragraphs and of word pairs modulo 2^32. So it doesn't depend on the paragraphs' order, and paragraphs
are inserted and deleted by adding and subtracting vectors (insert, delete). Equal texts have equal fingerprints;
texts with other paragraphs differ in the 512 bits of the EQUAL lanes but for a negligible chance. With x and y for how often
texts have each pair, the small lanes estimate the likeness 2 * sum(x * y) / (sum(x * x) + sum(y * y)), with an error of about
1 / sqrt(LANES): the share of pairs in common, if paragraphs don't repeat. Lanes hold up to 32,767 repeats of one paragraph.

Empty lines are no paragraphs. An empty or null text has the zero fingerprint; two of those have likeness 1.
Rows with equal ids or null ids are rows of their own, in the order of a hash of their text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import BLOCK_BYTES, map_blocks, partitions, small_batches

EQUAL = 8
LANES = 256


def vectors(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: EQUAL lanes, small lanes, (paragraphs, word pairs)."""
    n = len(many)
    lines = [[p for p in t.split("\n") if p] for t in many]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    flat = [p.encode() for x in lines for p in x]
    digests = np.frombuffer(b"".join(hashlib.blake2b(p).digest() for p in flat), np.uint64).reshape(-1, EQUAL)
    sums = np.zeros((len(flat) + 1, EQUAL), np.uint64)
    np.cumsum(digests, axis=0, out=sums[1:])
    equal = sums[first[1:]] - sums[first[:-1]]
    data = np.frombuffer(b"".join(flat), np.uint8)
    starts, ends, word = T.spans(data, np.concatenate([[0], np.cumsum([len(p) for p in flat])]).astype(np.int64))
    hashes = T.hash_spans(data, starts, ends)
    before = np.concatenate([[0], hashes[:-1]]).astype(np.uint64)
    before[word[:-1][np.diff(word) > 0]] = 0
    pairs = T.mix(hashes + before * np.uint64(0x9FB21C651E98DF25))
    # the k-th occurrence of a pair in its paragraph counts as another pair
    paragraph = T.owners(word)
    order = np.lexsort((pairs, paragraph))
    same = np.zeros(len(order), bool)
    same[1:] = (pairs[order[1:]] == pairs[order[:-1]]) & (paragraph[order[1:]] == paragraph[order[:-1]])
    place = np.arange(len(order))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    again = order[same]
    pairs[again] = T.mix(pairs[again] + nth[same].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    of_text = word[first]
    owner = T.owners(of_text)
    lane = (pairs % np.uint64(LANES)).astype(np.int64)
    sign = ((pairs >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    small = np.bincount(owner * LANES + lane, weights=sign, minlength=n * LANES).astype(np.int64).astype(np.uint16).reshape(n, LANES)
    return equal, small, np.stack([np.diff(first), np.diff(of_text)], axis=1).astype(np.uint32)


def encode(equal: np.ndarray, small: np.ndarray, counts: np.ndarray) -> list[str]:
    return [a.astype("<u4").tobytes().hex() + b.astype("<u8").tobytes().hex() + c.astype("<u2").tobytes().hex() for a, b, c in zip(counts, equal, small, strict=True)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw, "<u8", EQUAL, 8), np.frombuffer(raw, "<u2", LANES, 8 + 8 * EQUAL), np.frombuffer(raw, "<u4", 2)


def fingerprint(text: str | None) -> str:
    return encode(*vectors([text or ""]))[0]


def _change(fp: str, paragraph: str, sign: int) -> str:
    (equal, small, counts), (e, s, c) = decode(fp), (x[0] for x in vectors([paragraph]))
    join = np.add if sign > 0 else np.subtract
    return encode(join(equal, e)[None], join(small, s)[None], join(counts, c)[None])[0]


def insert(fp: str, paragraph: str) -> str:
    """The fingerprint of the text with one more paragraph (or, if paragraph has several lines, with all of them)."""
    return _change(fp, paragraph, 1)


def delete(fp: str, paragraph: str) -> str:
    return _change(fp, paragraph, -1)


def _likeness(small_a: np.ndarray, small_b: np.ndarray) -> np.ndarray:
    a, b = small_a.astype(np.int16).astype(np.float64), small_b.astype(np.int16).astype(np.float64)
    norms = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    return np.clip(np.where((small_a == small_b).all(axis=1), 1.0, 2 * (a * b).sum(axis=1) / norms.clip(1)), 0, 1)


def likeness(a: str, b: str) -> float:
    """1 for equal texts, about 0 for texts without common word pairs; about the share of word pairs in common."""
    return float(_likeness(decode(a)[1][None], decode(b)[1][None])[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of docs(doc_id, text); other columns are ignored."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        many = block.column("text").fill_null("").to_pylist()
        return pa.record_batch({"doc_id": block.column("doc_id"), "n_chars": pa.array([len(t) for t in many], pa.int64()), "fingerprint": pa.array(encode(*vectors(many)), pa.string())})

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_blocks(slim, run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, copy, doc_id, text), of which a task has whole parts, sorted by descending doc_id within each.

    A part is a range of ids between quantiles; an id of many rows is cut by the hash of their text. Parts follow each other in descending
    order, and after its own rows each has, with copy = 1, the first row of the part after it (the last part: that of the first). So every
    row's next row is at hand and texts move once. Null ids come last; rows of equal ids follow in the order of a hash of their text.
    Only the parts' bounds and first rows' ids and hashes reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("tie"))
    many = 4 * partitions(spark)
    quantiles = rows.agg(F.percentile_approx("key", [k / many for k in range(1, many)], 10_000)).first()[0] or []
    # a key that k of the quantiles fall on is cut into as many ranges of the hash
    bounds = [(key, 2**63 - 1 - 2**64 * j // n) for key, n in Counter(quantiles).items() for j in range(n)]
    limits = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tie")) for k, t in bounds]) if bounds else F.array().cast("array<struct<key: long, tie: long>>")
    rows = rows.withColumn("part", F.size(F.filter(limits, lambda x: (x["key"] > F.col("key")) | ((x["key"] == F.col("key")) & (x["tie"] > F.col("tie"))))))
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).collect()}
    if not heads:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("copy"), "doc_id", "text")
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}

    def of_part(values: dict):
        return F.element_at(F.array(*[F.lit(values.get(p, 0)).cast("long") for p in range(filled[-1] + 1)]), F.col("part") + 1)

    head = (F.col("key") == of_part({p: h["key"] for p, h in heads.items()})) & (F.col("tie") == of_part({p: h["tie"] for p, h in heads.items()}))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    rows = rows.withColumn("at", F.explode(F.when(head, F.array(own, F.struct(of_part(before).cast("int").alias("part"), F.lit(1).alias("copy")))).otherwise(F.array(own))))
    rows = rows.select(F.col("at.part").alias("part"), F.col("at.copy").alias("copy"), "doc_id", "text", "key", "tie")
    rows = rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "copy", F.desc("key"), F.desc("tie"))
    return rows.select("part", "copy", "doc_id", "text")


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in descending doc_id order, after the last one the first.

    A single document is its own next one. Null texts are empty; rows with equal ids follow each other by a hash of their text.
    """

    def work(ids: list, many: list[str], last: bool) -> pa.RecordBatch:
        own = many if last else many[:-1]
        nexts = many[1:]
        edited = [t[: len(t) - (half := len(t) // 2)] + u[:half] for t, u in zip(own, nexts, strict=False)]
        n = len(edited)
        equal, small, counts = vectors(many + edited)
        e = slice(len(many), None)
        prints = encode(equal[:n], small[:n], counts[:n])
        return pa.record_batch({
            "doc_id": pa.array(ids[:n], pa.int64()), "n_chars": pa.array([len(t) for t in many[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(prints, pa.string()), "edited_fingerprint": pa.array(encode(equal[e], small[e], counts[e]), pa.string()),
            "near_edited": pa.array(_likeness(small[:n], small[e])),
            "near_next": pa.array(_likeness(small[:n], small[1 : n + 1])),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, many, held, ended = None, [], [], 0, False
        for batch in batches:
            for p, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")), strict=True):
                if p != part:
                    part, ids, many, held, ended = p, [], [], 0, False
                if ended:
                    continue  # further copies of the same head
                text = text or ""
                ids.append(doc_id)
                many.append(text)
                held += len(text)
                ended = copy == 1
                if (held > BLOCK_BYTES or ended) and len(many) > 1:
                    yield work(ids, many, False)
                    ids, many, held = ids[-1:], many[-1:], len(text)

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(slim).mapInArrow(run, schema)
