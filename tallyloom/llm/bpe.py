"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over WINDOW bytes cuts texts where its low bits are zero, so texts with passages in common have chunks in
common. Within a task's block each distinct chunk is encoded once: the ids of what lies between its first and last
space or line break. At a join the end of one chunk and the start of the next are put together again and re-encoded; the window of
re-encoding widens by whole chunks until white space bounds it on both sides. There the ids of the window and those of the chunks agree
with the whole text's, since the vocabulary's pre-tokenizer starts anew at white space.

Null texts are empty; an empty text has no ids and decodes to the empty text. Rows are encoded one by one, repeated or not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import map_blocks, text_bytes
from .tokens import encoder, gather

WINDOW, BITS = 24, 9


def cuts(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, bits: int = BITS) -> np.ndarray:
    """Places where chunks begin: the texts' own, and those that follow window bytes whose hash has its low bits zero."""
    if len(data) <= window:
        return offsets[:-1]
    ends = np.arange(window, len(data))
    low = T.hash_spans(data, ends - window, ends) & np.uint64((1 << bits) - 1)
    found = ends[(low == 0) & (data[ends] & 0xC0 != 0x80)]  # not inside a character
    return np.union1d(found, offsets[:-1])


def encode_texts(data: np.ndarray, offsets: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts of a block, and the index of each text's first id (n + 1 values)."""
    raw = data.tobytes()
    at = np.append(cuts(data, offsets), len(data))
    first = np.searchsorted(at, offsets)
    at = at.tolist()
    parts: dict[bytes, tuple[str, str | None, str]] = {}  # of distinct chunks: before, between and after white space
    number: dict[str, int] = {}  # of distinct strings to encode: what chunks have between white space, and joins
    order, ends = [], []
    for i in range(len(offsets) - 1):
        window = ""
        for k in range(first[i], first[i + 1] if offsets[i] < offsets[i + 1] else first[i]):
            chunk = raw[at[k] : at[k + 1]]
            if (found := parts.get(chunk)) is None:
                text = chunk.decode().replace("\n", " ")
                start, blank, rest = text.partition(" ")
                between, _, end = rest.rpartition(" ")
                found = parts[chunk] = (start, between if blank else None, end)
            start, between, end = found
            window += start
            if between is None:  # no white space yet: the window of re-encoding takes the whole chunk
                continue
            order.append(number.setdefault(window, len(number)))
            order.append(number.setdefault(between, len(number)))
            window = end
        order.append(number.setdefault(window, len(number)))
        ends.append(len(order))
    flat, begin = encoder(name).encode_many(list(number))
    ids, to = gather(flat, begin, np.array(order, np.int64))
    return ids, to[np.array([0, *ends], np.int64)]


def decoder(name: str):
    """A function from ids to text, as the file's decode: without a decoder of its own, its tokens joined by spaces."""
    whole = encoder(name).whole
    if whole.decoder is not None:
        return lambda ids: whole.decode(ids, skip_special_tokens=False)
    tokens = [whole.id_to_token(i) for i in range(whole.get_vocab_size(with_added_tokens=True))]
    return lambda ids: " ".join(map(tokens.__getitem__, ids))


def encode(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, ids of each row of docs(doc_id, text); other columns are ignored."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = encode_texts(*text_bytes(block.column("text")), name)
        return pa.record_batch({"doc_id": block.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))})

    return map_blocks(_slim(docs), run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 of each row of docs."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        back, numbers = decoder(name), [str(i) for i in range(encoder(name).whole.get_vocab_size())]
        ids, first = encode_texts(*text_bytes(block.column("text")), name)
        ids = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.record_batch({
            "doc_id": block.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(" ".join(map(numbers.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(back(x).encode()).hexdigest() for x in ids], pa.string()),
        })

    return map_blocks(_slim(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
