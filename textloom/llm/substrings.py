"""Substring dedup: windows of words that started earlier elsewhere are removed.

Every window of ``width`` words of every document gets a Rabin-Karp hash (a
polynomial in the words' 64-bit hashes, rolled along modulo 2**64). Buckets of
hashes count them and find the first start of each; every later start is sent
back, and touching windows merge into maximal intervals. Windows are judged on
the input. Equal hashes count as equal windows: at 10**12 windows the chance of
one false pair is about 3 %.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .blocks import bits_for, blocks, bucket_rows, pack, unpack

BASE = 0x9E3779B97F4A7C15
#: Text bytes whose windows one bucket gathers.
BUCKET_BYTES = 12_000_000
_ROW = "key long, block long, data binary, names binary"


def rabin_karp(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive values of h, from sums of h * BASE**i and the inverse powers."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.full(len(h), BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.add.accumulate(h * power, out=sums[1:])
    back = np.full(n, pow(BASE, -1, 2**64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return (sums[width:] - sums[:n]) * back


def starts(sizes: np.ndarray, width: int, ids: list, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and word number of each window that fits. Documents without an id, and repeated rows, have none."""
    ok = np.array([i is not None and (k == 0 or ids[k - 1] != i or texts[k - 1] != texts[k]) for k, i in enumerate(ids)], bool)
    n = np.where(ok, np.maximum(0, sizes - width + 1), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


def _later(hashes: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a window with the same hash starts earlier: at a smaller id, or there at a smaller start."""
    later = np.zeros(len(hashes), bool)
    order = np.argsort(hashes)
    s = hashes[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    on = order[many]
    on = on[np.lexsort((start[on], ids[on], hashes[on]))]
    head = np.ones(len(on), bool)
    head[1:] = hashes[on[1:]] != hashes[on[:-1]]
    lead = on[np.maximum.accumulate(np.where(head, np.arange(len(on)), 0))]
    later[on] = (ids[on] != ids[lead]) | (start[on] != start[lead])
    return later


def spots(doc: np.ndarray, start: np.ndarray) -> bytes:
    """Windows in ascending order of (doc, start): the documents that have some, how many each has, and their starts, as differences."""
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(head)
    step = np.diff(start, prepend=0)
    step[first] = start[first]
    parts = (np.diff(doc[first], prepend=0), np.diff(np.append(first, len(doc))), step)
    return struct.pack("<II", len(first), len(doc)) + b"".join(pack(x.astype(np.uint32)) for x in parts)


def unspots(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, number of windows of each, and all starts."""
    d, n = struct.unpack_from("<II", data)
    doc, count, step = (unpack(data[a:z], "<u4").astype(np.int64) for a, z in ((8, 8 + 4 * d), (8 + 4 * d, 8 + 8 * d), (8 + 8 * d, 8 + 8 * d + 4 * n)))
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    return np.cumsum(doc), count, total - np.repeat(total[first] - step[first], count)


def packed(hashes: np.ndarray, ids: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """What a block sends to a bucket: hashes of windows, where they are, and the ids of the documents that have them; nothing of other documents."""
    where = spots(doc, start)
    touched = ids[doc[np.flatnonzero(np.diff(doc, prepend=-1))]]
    return struct.pack("<I", len(where)) + where + pack(np.diff(touched, prepend=0)) + pack(hashes)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, ids, doc, start of each window."""
    (at,) = struct.unpack_from("<I", data)
    doc, count, start = unspots(data[4:4 + at])
    ids = np.cumsum(unpack(data[4 + at:4 + at + 8 * len(doc)], "<i8"))
    return unpack(data[4 + at + 8 * len(doc):], "<u8"), np.repeat(ids, count), np.repeat(doc, count), start


def sent_rows(number: int, h: np.ndarray, ids: list, sizes: np.ndarray, texts: np.ndarray, width: int, bits: int) -> list[tuple[int, int, bytes, bytes | None]]:
    """(key, block, data, names) of a block: its own row, with its windows that are later ones already, and a row for each bucket."""
    known = np.array([0 if i is None else i for i in ids], np.int64)
    doc, start = starts(sizes, width, ids, texts)
    hashes = rabin_karp(h, width)[(np.cumsum(sizes) - sizes)[doc] + start]
    later = _later(hashes, known[doc], start)
    rows = [(-1 - number, number, spots(doc[later], start[later]), pack(known) + pack(texts))]
    hashes, doc, start = hashes[~later], doc[~later], start[~later]
    return rows + [(b, number, packed(hashes[k], known, doc[k], start[k]), None) for b, k in bucket_rows(hashes, bits)]


def _map(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = sent_rows(*block, width, bits)
            for k in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 16]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "block", "data", "names"])

    return run


def _first_starts(key, t):
    """Of a bucket: per block, the windows that have an earlier start elsewhere. A block's own row passes."""
    if key[0].as_py() < 0:
        return t.drop_columns(["key"])
    block = t.column("block").to_pylist()
    each = [unpacked(x.as_py()) for x in t.column("data")]
    source = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
    hashes, ids, doc, start = (np.concatenate([x[k] for x in each]) for k in range(4))
    on = np.flatnonzero(_later(hashes, ids, start))
    begin = np.flatnonzero(np.diff(source[on], prepend=-1))
    out = [(block[source[p[0]]], spots(doc[p], start[p])) for p in np.split(on, begin[1:]) if len(p)]
    return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "data": pa.array([r[1] for r in out], pa.binary()), "names": pa.array([None] * len(out), pa.binary())})


def _intervals(width: int):
    """Of a block: (id, text_hash, spans) of its documents with words to remove, spans being maximal [start, end) one after the other."""
    def run(key, t):
        names = next(x.as_py() for x in t.column("names") if x.is_valid)
        half = len(names) // 2
        ids, texts = unpack(names[:half], "<i8"), unpack(names[half:], "<i8")
        each = [unspots(x.as_py()) for x in t.column("data")]
        doc, start = np.concatenate([np.repeat(d, c) for d, c, _ in each]), np.concatenate([s for *_, s in each])
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        new = np.ones(len(doc), bool)
        new[1:] = (start[1:] > start[:-1] + width) | (doc[1:] != doc[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)[: int(new.sum())]
        d = doc[new]
        spans = np.stack([start[new], start[last] + width], 1).astype(np.int32)
        found, at = np.unique(d, return_index=True)
        return pa.table({"id": pa.array(ids[found]), "text_hash": pa.array(texts[found]), "spans": pa.array([x.reshape(-1) for x in np.split(spans, at[1:])] if len(found) else [], pa.list_(pa.int32()))})

    return run


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, text_hash, spans) of the documents that lose words: [start, end) word numbers, flattened, ascending, maximal."""
    ship(df.sparkSession)
    rows = _named(df, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = rows.mapInArrow(_map(width, bits_for(total, bucket_bytes)), _ROW)
    found = sent.groupBy("key").applyInArrow(_first_starts, "block long, data binary, names binary")
    spans = found.groupBy("block").applyInArrow(_intervals(width), "id long, text_hash long, spans array<int>")
    return spans.groupBy("id", "text_hash").agg(F.first("spans").alias("spans"))  # repeated rows have the same spans in every block


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, kept = [], [], []
        for t, spans in zip(b.column(1), b.column(2).to_pylist()):
            w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            n.append(len(w))
            for a, z in sorted(zip((spans or [])[::2], (spans or [])[1::2]), reverse=True):
                del w[a:z]
            removed.append(n[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, n_words, n_removed (long), kept (the words left, joined by one space).

    A window of width words is removed if its words also start earlier: at a smaller id, or earlier in the same document. Null or
    empty texts have no words. Rows with a null id lose nothing and take nothing from others. Rows that repeat an id count as
    places of one document: the same window at the same word number is one there, else the later one goes. An empty table gives
    an empty result; further columns are ignored.
    """
    both = _named(df, id_col, text_col).join(removals(df, id_col, text_col, width, bucket_bytes), ["id", "text_hash"], "left").select("id", "text", "spans")
    return both.mapInArrow(_keep, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def digest(kept: DataFrame) -> DataFrame:
    """The result with the kept text as its hash."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def oracle(width: int = 20) -> str:
    """The digest in SQL, with whole windows as keys."""
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\v\f]+') AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS start FROM w WHERE len(ws) >= {width}),
    win AS (SELECT doc_id, start, array_to_string(ws[start:start + {width - 1}], ' ') AS t FROM s),
    early AS (SELECT t, min({{'d': doc_id, 's': start}}) AS f FROM win GROUP BY t HAVING count(*) > 1),
    bad AS (SELECT doc_id, start FROM win JOIN early USING (t) WHERE doc_id <> f.d OR start <> f.s),
    gone AS (SELECT DISTINCT doc_id, start + unnest(range({width})) AS i FROM bad),
    word AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
    left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)"""
