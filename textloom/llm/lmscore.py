"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Bigram and unigram counts form one table, partitioned by the hash of the n-gram.
Each block of documents sends its n-grams, once each with the block's count, to
their partitions, is joined there with the corpus counts, and gets these back in
its own order; documents then sum over their words. A document is scored by the
rest of the corpus: its own n-grams are taken off each count.

With c the count elsewhere and N the words elsewhere, a word w after v has
S = c(v w) / c(v) if c(v w) > 0, else ``backoff`` * S(w); S(w) = c(w) / N, or
0.5 / N if w occurs nowhere else. A first word has S(w).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .blocks import bits_for, blocks, bucket_rows, pack, unpack
from .common import cut

BACKOFF = 0.4
#: Text bytes whose n-grams one partition of the count table gathers.
BUCKET_BYTES = 12_000_000
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a pair of word hashes; the multiplications make the order count."""
    x = (v ^ (v >> np.uint64(32))) * _MIX + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _tables(h: np.ndarray, sizes: np.ndarray) -> tuple:
    """A block's words as numbers, its bigrams as numbers, and the hash of each number; bigrams do not cross documents."""
    words, word = np.unique(h, return_inverse=True)
    first = np.zeros(len(h), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return words, word, first, *_pairs(word, first)


def _pairs(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (previous, next) word numbers as one value each, and the number of the pair at each place that is not a first one."""
    at = np.nonzero(~first)[0]
    return np.unique(word[at - 1].astype(np.int64) << 32 | word[at], return_inverse=True)


def _map(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for number, h, ids, sizes, _ in blocks(batches):
            words, word, first, pairs, pair = _tables(h, sizes)
            grams = np.concatenate([words, _bigram(words[pairs >> 32], words[pairs & 0xFFFFFFFF])])
            counts = np.concatenate([np.bincount(word, minlength=len(words)), np.bincount(pair, minlength=len(pairs))]).astype(np.uint32)
            known, has = np.array([0 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8)
            rows = [(-1 - number, number, squeeze(pack(known) + has.tobytes()), squeeze(pack(sizes) + pack(word.astype(np.uint32))))]
            rows += [(b, number, pack(grams[k]), squeeze(pack(counts[k]) + pack(np.diff(k, prepend=0).astype(np.uint32)))) for b, k in bucket_rows(grams, bits)]
            for k in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 16]), (pa.int64(), pa.int64(), *[pa.binary()] * 2))], ["key", "block", "x", "y"])

    return run


def _count(key, t):
    """Of a partition of the table: each block's n-grams with the corpus counts. A block's own row passes."""
    if key[0].as_py() < 0:
        return t.drop_columns(["key"]).append_column("own", pa.array([True]))
    import zstandard

    open_, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    each = [unpack(x.as_py(), "<u8") for x in t.column("x")]
    rest = [open_(x.as_py()) for x in t.column("y")]
    table, at = np.unique(np.concatenate(each), return_inverse=True)
    total = np.zeros(len(table), np.int64)
    np.add.at(total, at, np.concatenate([unpack(r[: 4 * len(x)], "<u4") for x, r in zip(each, rest)]))
    back = np.split(total[at], np.cumsum([len(x) for x in each])[:-1])
    # The n-grams' numbers return with them; counts are small: the planes above the first compress away.
    data = [squeeze(pack(n) + r[4 * len(x):]) for n, x, r in zip(back, each, rest)]
    return pa.table({"block": t.column("block"), "x": pa.array(data, pa.binary()), "y": pa.array([b""] * len(back), pa.binary()), "own": pa.array([False] * len(back))})


def _score(backoff: float):
    def run(key, t):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        rows = t.to_pylist()
        own = next(r for r in rows if r["own"])
        head, tail = open_(own["x"]), open_(own["y"])
        n_docs = len(head) // 9
        sizes, word = unpack(tail[: 8 * n_docs], "<i8"), unpack(tail[8 * n_docs:], "<u4").astype(np.int64)
        ids, has = unpack(head[: 8 * len(sizes)], "<i8"), np.frombuffer(head[8 * len(sizes):], np.uint8)
        n_words = int(word.max()) + 1 if len(word) else 0
        first = np.zeros(len(word), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        pairs, pair = _pairs(word, first)
        corpus = np.zeros(n_words + len(pairs), np.int64)
        for r in rows:
            if not r["own"]:
                data = open_(r["x"])
                n = len(data) // 12
                corpus[np.cumsum(unpack(data[8 * n:], "<u4").astype(np.int64))] = unpack(data[: 8 * n], "<i8")
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.nonzero(~first)[0]
        c1 = corpus[word] - _own(doc, word)
        c2 = np.zeros(len(word), np.int64)
        c2[at] = corpus[n_words + pair] - _own(doc[at], pair)
        previous = np.ones(len(word), np.int64)
        previous[at] = c1[at - 1]
        seen = c2 > 0
        # Where a bigram occurs elsewhere so does its first word, with at least its count.
        log = np.where(seen, np.log(np.maximum(c2, 1) / np.maximum(previous, 1)), np.log(np.maximum(c1, 0.5)) + np.where(first, 0.0, np.log(backoff)))
        add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        return pa.table({"id": pa.array(ids, mask=has == 0), "n_words": pa.array(sizes), "n_backoff": pa.array(add(~seen & ~first).astype(np.int64)), "by_words": pa.array(add(~seen).astype(np.int64)), "log_counts": pa.array(add(log))})

    return run


def _own(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each place, how often its document has its number."""
    if not len(doc):
        return np.zeros(0, np.int64)
    _, at, n = np.unique(doc.astype(np.int64) << 32 | number, return_inverse=True, return_counts=True)
    return n[at]


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, n_words, n_backoff (long), log_score (double: sum of ln S), mean_log_score (double).

    Null or empty texts have no words, log_score 0 and a null mean. Each row is a document of its own, so repeated rows (and rows
    with a null id) count for each other. An empty table gives an empty result; further columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("none"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = rows.mapInArrow(_map(bits_for(total, bucket_bytes)), "key long, block long, x binary, y binary")
    counted = sent.groupBy("key").applyInArrow(_count, "block long, x binary, y binary, own boolean")
    parts = cut(counted.groupBy("block").applyInArrow(_score(backoff), "id long, n_words long, n_backoff long, by_words long, log_counts double"))
    n = F.lit(parts.agg(F.sum("n_words")).first()[0] or 0)
    score = F.col("log_counts") - F.when(F.col("by_words") > 0, F.col("by_words") * F.log(F.greatest(n - F.col("n_words"), F.lit(1)).cast("double"))).otherwise(0.0)
    return parts.withColumn("log_score", score).select(
        F.col("id").alias(id_col), "n_words", "n_backoff", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
