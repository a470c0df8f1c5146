"""Blocks of documents: how the operators on word windows keep shuffles small.

A mapper packs some thousand documents into a block and sends, for each bucket
of hashes, one binary row with what the block holds there, each hash once; so a
hash that is everywhere reaches its bucket once from each block. What a bucket
finds out goes back to the block in the order that it was sent.

Arrays are laid out byte plane by byte plane, which the shuffle's compression
rewards. A block's number is its task's partition and its place there, so a
task that runs again makes the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

BLOCK_WORDS, KEPT_WORDS = 1_000_000, 250_000


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; those met lately are looked up."""
    new = set(words).difference(_known)
    if len(_known) + len(new) > KEPT_WORDS:
        _known.clear()
        new = set(words)
    h = xxhash.xxh64_intdigest
    _known.update((w, h(w)) for w in new)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Words by ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_WORDS) -> Iterator[tuple[int, np.ndarray, list[int | None], np.ndarray, np.ndarray]]:
    """(number, word hashes, ids, words of each, third columns) of blocks of about most words, documents in ascending order of id, then third column, null ids last."""
    number, rows, total = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        for i, t, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            w = split(t.as_py())
            rows.append((i, word_hashes(w), x))
            total += len(w)
            if total >= most:
                yield _block(number, rows)
                number, rows, total = number + 1, [], 0
    if rows:
        yield _block(number, rows)


def _block(number: int, rows: list) -> tuple:
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    return number, np.concatenate([h for _, h, _ in rows]), [i for i, _, _ in rows], np.array([len(h) for _, h, _ in rows], np.int64), np.array([x for _, _, x in rows], np.int64)


def bucket_rows(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for each bucket, by the top bits, that has some of hashes."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    for b, places in zip(found.tolist(), np.split(order, at[1:])):
        yield b, places


def bits_for(n_bytes: int, bytes_in_bucket: int) -> int:
    """Bits so that each bucket has about so many bytes of text; 2 ** bits buckets, 8 at least."""
    return max(3, (max(1, n_bytes // bytes_in_bucket) - 1).bit_length())
