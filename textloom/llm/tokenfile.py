"""Token-ID output: documents, tokenized, in ascending order of id, as range-coded files.

Documents are dealt out by ranges of their id, sorted, tokenized by ``bytebpe``
and packed into groups of about ``GROUP_IDS`` ids of whole documents. A group is one string: the documents'
ids and lengths, then the ids by ``coder``. Spark's writer puts the groups
(part, group, ids, data) into the shared folder as files of binary rows, so that
a task that is lost writes again and nothing half-written stays.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import coder
from .bytebpe import ByteBPE
from .common import shared_folder, small

GROUP_IDS, PART_BYTES, END_ID = 4_000_000, 16_000_000, 0
#: Bytes of text that are tokenized at a time: few enough that numpy's arrays stay near the cache.
SLICE = 2_000_000

_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """Once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def write_group(ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    has = np.array([i is not None for i in ids], np.uint8)
    head = np.array([i or 0 for i in ids], "<i8").tobytes() + has.tobytes() + np.array([len(d) for d in docs], "<u4").tobytes()
    return struct.pack("<QI", len(ids), zlib.crc32(head)) + head + coder.encode(np.concatenate(docs) if docs else np.zeros(0))


def read_group(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    n, crc = struct.unpack_from("<QI", data)
    head = data[12:12 + 13 * n]
    if zlib.crc32(head) != crc:
        raise ValueError("the table of documents is damaged")
    has = np.frombuffer(head, np.uint8, n, 8 * n)
    ids = [i if h else None for i, h in zip(np.frombuffer(head, "<i8", n).tolist(), has)]
    ends = np.cumsum(np.frombuffer(head, "<u4", n, 9 * n).astype(np.int64))
    return ids, np.split(coder.decode(data[12 + 13 * n:]), ends[:-1]) if n else []


def _pack(path: str, end_id: int, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm.tokenfile import encoder, write_group
        from textloom.llm.tokens import slices

        part, group, ids, docs, total = TaskContext.get().partitionId(), 0, [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([group], pa.int32()), pa.array([total], pa.int64()), pa.array([write_group(ids, docs)], pa.binary())], ["part", "group", "n", "data"])
        encode = encoder(path).ids
        for b in batches:
            texts, names = b.column(1), b.column(0).to_pylist()
            for i, j in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE):
                for name, x in zip(names[i:j], encode(texts[i:j])):
                    ids.append(name)
                    docs.append(np.append(x, np.int32(end_id)))
                    total += len(docs[-1])
                    if total >= group_ids:
                        yield made()
                        group, ids, docs, total = group + 1, [], [], 0
        if ids:
            yield made()

    return run


def write_tokens(df: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, group_ids: int = GROUP_IDS, part_bytes: int = PART_BYTES) -> None:
    """Writes the documents below out. Null texts are empty (only the end id); rows with a null id come first, repeated rows each; rows that share an id are in the order of their text's hash."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The hash orders rows of one id; the row number, of no effect on the result, lets a hot pair of both be split too.
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(max(1, -(-size // part_bytes)), "id", "h", "r").sortWithinPartitions("id", "h", "r")
    ordered.select("id", "text").mapInArrow(_pack(path, end_id, group_ids), "part int, group int, n long, data binary").write.option("compression", "none").parquet(out)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from textloom.llm.tokenfile import read_group

    for b in batches:
        for part, group, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            ids, docs = read_group(data.as_py())
            n = np.array([len(d) for d in docs], np.int64)
            crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array([group] * len(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "group", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    ship(spark)
    files = spark.read.schema("part int, group int, n long, data binary").parquet(out)
    docs = files.select("part", "group", "data").mapInArrow(_unpack, "part int, group int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Offsets: of a part's groups within it, then of the parts; the single-partition sum runs over parts, some tens of MB of text each.
    within = Window.partitionBy("part").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.select("part", "group", "n")
    parts = groups.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    starts = groups.select("part", "group", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("g")).join(parts, "part").select("part", "group", (F.col("p") + F.col("g")).alias("o"))
    return docs.join(small(starts), ["part", "group"]).select("doc_id", (F.col("o") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes df's tokens to a new folder in the shared one and reads them back. An empty table gives an empty result."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/textloom-tokens-{uuid.uuid4().hex}"
    write_tokens(df, out, path, id_col, text_col, **options)
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return read_tokens(spark, out)
