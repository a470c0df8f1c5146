"""64-bit and 128-bit murmur hashes, vectorised, and the string store built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import ship
from .symbols import SYMBOLS

M64 = 0xC6A4A7935BD1E995
MASK = 2**64 - 1


def hash64(data: bytes, seed: int = 1) -> int:
    """MurmurHash64A of the bytes."""
    h = (seed ^ (len(data) * M64)) & MASK
    whole = len(data) // 8 * 8
    for k in np.frombuffer(data[:whole], "<u8").tolist():
        k = k * M64 & MASK
        h = ((h ^ ((k ^ (k >> 47)) * M64 & MASK)) * M64) & MASK
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * M64 & MASK
    h = (h ^ (h >> 47)) * M64 & MASK
    return h ^ (h >> 47)


def string_id(text: str, symbols: dict[str, int] = SYMBOLS) -> int:
    """Id of a string in a string store: 0 for the empty one, a symbol's number, else its hash."""
    return 0 if not text else symbols.get(text) or hash64(text.encode())


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash4(ids: np.ndarray, seed: int) -> np.ndarray:
    """Four 32-bit words for each 64-bit id: the 128-bit x64 murmur finish of a single 8-byte block."""
    k = np.asarray(ids, np.uint64)
    k1 = _rot(k * np.uint64(0x87C37B91114253D5), 31) * np.uint64(0x4CF5AD432745937F)
    h1, h2 = k1 ^ np.uint64(seed), np.full(len(k), seed, np.uint64)
    h1, h2 = h1 ^ np.uint64(8), h2 ^ np.uint64(8)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = h1 + h2
    h2 = h2 + h1
    low = np.uint64(0xFFFFFFFF)
    return np.stack([h1 & low, h1 >> np.uint64(32), h2 & low, h2 >> np.uint64(32)], 1).astype(np.uint32)


def with_hash64(df: DataFrame, column: str, out: str, symbols: dict[str, int] = SYMBOLS) -> DataFrame:
    """Adds the string id of a column, as a long with the same 64 bits. Each distinct string of a batch is hashed once."""
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(column).dictionary_encode()
            ids = np.array([string_id(s or "", symbols) for s in coded.dictionary.to_pylist()], np.uint64).view(np.int64)
            yield b.append_column(out, pa.array(ids).take(coded.indices) if len(ids) else pa.nulls(len(b), pa.int64()))

    return df.mapInArrow(run, schema)


def string_table(df: DataFrame, column: str, symbols: dict[str, int] = SYMBOLS) -> DataFrame:
    """(text, id) of the distinct strings: symbols and the empty string are not stored."""
    distinct = df.select(F.col(column).alias("text")).distinct().filter(F.col("text") != "")
    if symbols:
        distinct = distinct.filter(~F.col("text").isin(*symbols))  # hashed once: a set test
    return with_hash64(distinct, "text", "id", symbols)


def lookup(ids: DataFrame, table: DataFrame, column: str = "id") -> DataFrame:
    """ids with text: of the empty string and the symbols without a table, of others as string_table has them; null where nothing has the id."""
    spark = ids.sparkSession
    known = spark.createDataFrame([("", 0), *((n, k) for n, k in SYMBOLS.items())], "text string, id long")
    names = table.select("text", "id").unionByName(known).withColumnRenamed("id", "_id")
    return ids.join(names, F.col(column) == F.col("_id"), "left").drop("_id")


def get(texts: DataFrame, table: DataFrame, column: str = "text") -> DataFrame:
    """texts with id: that of a stored string, a symbol or the empty string; null for others."""
    found = with_hash64(texts.select(F.col(column).alias("_text")).distinct(), "_text", "id")
    stored = table.select(F.col("text").alias("_text"), F.lit(True).alias("_stored"))
    small = (F.col("id") >= 0) & (F.col("id") <= len(SYMBOLS))
    found = found.join(stored, "_text", "left").select("_text", F.when(small | F.col("_stored"), F.col("id")).alias("id"))
    return texts.join(found, F.col(column) == F.col("_text"), "left").drop("_text")


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int, int, int]:
    """The public MurmurHash3, x86, 128 bits: four lanes, each block word mixed into its own."""
    m = 0xFFFFFFFF
    c = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
    turns, after, adds = (15, 16, 17, 18), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    word = lambda k, j: rot(k * c[j] & m, turns[j]) * c[(j + 1) % 4] & m

    def final(x: int) -> int:
        x = (x ^ x >> 16) * 0x85EBCA6B & m
        x = (x ^ x >> 13) * 0xC2B2AE35 & m
        return x ^ x >> 16

    h = [seed] * 4
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        for j in range(4):
            h[j] ^= word(int.from_bytes(data[at + 4 * j:at + 4 * j + 4], "little"), j)
            h[j] = ((rot(h[j], after[j]) + h[(j + 1) % 4]) * 5 + adds[j]) & m
    tail = data[whole:]
    for j in range(4):
        if part := tail[4 * j:4 * j + 4]:
            h[j] ^= word(int.from_bytes(part, "little"), j)
    h = [x ^ len(data) for x in h]
    for step in (lambda x: x, final):
        h = [step(x) for x in h]
        h[0] = sum(h) & m
        h[1:] = [(x + h[0]) & m for x in h[1:]]
    return tuple(h)


def with_hash4(df: DataFrame, column: str, out: str, seed: int) -> DataFrame:
    """Adds the four words of a long column's ids as an array."""
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = hash4(b.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), seed).astype(np.int64)
            yield b.append_column(out, pa.array(list(words), pa.list_(pa.int64())))

    return df.mapInArrow(run, schema)
