"""SimHash near-duplicates: exact pairs by vantage-point trees, then components.

Fingerprints: XXH64 of each shingle, a bit set where over half the hashes have
it. Equal fingerprints are one class, so copies are never paired. Classes are
split by their Hamming distance from vantage points: distances below the radius
go near, the others far, and those within ``max_bits`` of it (by the triangle
inequality the only ones with partners on the other side) go to both. The first
splits make shards, in SQL; within a shard a tree of such splits ends in leaves
that are compared outright. A leaf and a shard return links from a class to the
smallest one that it reaches there, not pairs: a group of n linked classes makes
n rows. Components of those links are found by passing on smallest labels.

No vantage point divides a tight cluster. Such a one, large, is linked by points
half-way: two fingerprints differ in at most two bits exactly if flipping at most
one bit of each can give the same point. That is 65 points a row, sorted, instead
of all pairs; no point has more than 65 rows. A shard above a fixed number of
rows is linked so by a shuffle on the points, so no task takes more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import BROADCAST_ROWS, cut, small, some

LEAF, SHARD_ROWS = 192, 4096
#: An undivided leaf of more rows, and a shard of more rows, are linked by points half-way.
OUTRIGHT, LARGEST_SHARD = 2048, 65_536


def fingerprint(text: str | None, width: int = 3) -> int:
    """Fingerprint of one text; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= width:
        hashes = [h(b" ".join(w), 42)]
    else:
        line, ends, at = b" ".join(w), [], -1
        for x in w:
            at += len(x) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends]
        hashes = [h(line[a:b], 42) for a, b in zip(starts, ends[width - 1:])]
    total, n = np.zeros(64, np.int64), len(hashes)
    block = np.array(hashes, dtype="<u8")
    for k in range(0, n, 4096):
        total += np.unpackbits(block[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id, fp (long, the 64 bits) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches over the links a-b."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def _half_way(x: np.ndarray) -> np.ndarray:
    """Smallest index that each of the distinct fingerprints reaches over pairs of at most two differing bits."""
    n = len(x)
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    points = (x[:, None] ^ flips[None, :]).ravel()
    order = np.argsort(points, kind="stable")
    same = points[order[1:]] == points[order[:-1]]
    row = order // len(flips)
    return _labels(row[1:][same], row[:-1][same], n)


def linked(fps: np.ndarray, max_bits: int = 2, leaf: int = LEAF) -> np.ndarray:
    """Smallest index that each of the distinct fingerprints reaches over pairs of at most max_bits differing bits."""
    n = len(fps)
    lab = np.arange(n)
    rng = np.random.default_rng(n)
    stack = [np.arange(n)]
    a_all: list[np.ndarray] = []
    b_all: list[np.ndarray] = []
    while stack:
        at = stack.pop()
        x = fps[at]
        best = None
        if len(at) > leaf:
            for v in [x[rng.integers(len(at))], *rng.integers(0, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]:
                d = np.bitwise_count(x ^ v).astype(np.int64)
                mu = int(np.median(d))
                for m in (mu, mu + 1):
                    near, far = d < m + max_bits, d >= m
                    size = max(near.sum(), far.sum())
                    if best is None or size < best[0]:
                        best = (size, near, far)
                if best[0] <= 0.75 * len(at):
                    break
        if best is not None and best[0] <= 0.9 * len(at):
            stack += [at[best[1]], at[best[2]]]
            continue
        # A leaf, or a cluster that no vantage point divides: half-way points, or rows against rows, in blocks; links to the smallest reached so far.
        half_way = max_bits == 2 and len(at) > OUTRIGHT
        own = _half_way(x) if half_way else np.arange(len(at))
        for k in range(0, 0 if half_way else len(at), 512):
            i, j = np.nonzero(np.bitwise_count(x[k:k + 512, None] ^ x[None, :]) <= max_bits)
            if len(i) > len(x[k:k + 512]):
                keep = i + k < j
                merged = _labels(np.concatenate([i[keep] + k, np.arange(len(at))]), np.concatenate([j[keep], own]), len(at))
                own = merged
        moved = np.nonzero(own != np.arange(len(at)))[0]
        if len(moved):
            a_all.append(at[moved])
            b_all.append(at[own[moved]])
    return _labels(np.concatenate(a_all), np.concatenate(b_all), n) if a_all else lab


def _branch(paths, sides):
    return F.flatten(F.transform(paths, lambda p: F.transform(sides, lambda s: p * 2 + s)))


def _shards(classes: DataFrame, levels: int, max_bits: int) -> DataFrame:
    """fp, shard: each class in the shard, or shards, of its side of each of the first vantage points."""
    points = np.random.default_rng(64).integers(-(2**63), 2**63 - 1, max(levels, 1), dtype=np.int64)
    paths = F.array(F.lit(0).cast("long"))
    for v in points[:levels]:
        d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(v))))
        sides = F.when(d < 32, F.array(F.lit(0))).when(d < 32 + max_bits, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
        paths = _branch(paths, sides)
    return classes.select("fp", F.explode(paths).alias("shard"))


def _star_links(rows: DataFrame) -> DataFrame:
    """(a, b) links of the distinct fp within two bits: each with the smallest at each of its points half-way."""
    fp = F.col("fp")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    points = rows.select("fp", F.explode(F.transform(flips, lambda f: fp.bitwiseXOR(f))).alias("point"))
    # A point has at most 65 rows, one for each flip, so its list is short.
    met = points.groupBy("point").agg(F.collect_list("fp").alias("met")).filter(F.size("met") > 1)
    return met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).filter("a <> b")


def links(classes: DataFrame, n: int, max_bits: int = 2, shard_rows: int = SHARD_ROWS, largest: int = LARGEST_SHARD) -> DataFrame:
    """(a, b) links that connect exactly the distinct fp within max_bits of each other, directly or over others; n: their number.

    Shards of more than largest rows (max_bits 2 only) are linked by a shuffle on points half-way, not in one task.
    """
    levels = 0
    while n * 0.645**levels > shard_rows:
        levels += 1

    def run(key, t):
        fps = np.sort(t.column("fp").to_numpy().view(np.uint64))
        lab = linked(fps, max_bits)
        on = np.nonzero(lab != np.arange(len(fps)))[0]
        return pa.table({"a": fps[on].view(np.int64), "b": fps[lab[on]].view(np.int64)})

    shards = cut(_shards(classes, levels, max_bits))
    if max_bits != 2 or n <= largest or not some(large := cut(shards.groupBy("shard").count().filter(F.col("count") > largest).select("shard"))):
        return shards.groupBy("shard").applyInArrow(run, "a long, b long").distinct()
    bound = small(large)
    whole = shards.join(bound, "shard", "left_anti").groupBy("shard").applyInArrow(run, "a long, b long")
    return whole.unionByName(_star_links(shards.join(bound, "shard", "left_semi").select("fp").distinct())).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of the (a, b) links: root is the smallest node that it reaches.

    Rounds of: hang every neighbour on the smallest of them (large star), then every smaller-or-equal one (small star), until
    nothing moves. A node's neighbours are only ever reduced to their minimum, so no group is gathered in one task. A link stays
    one link or goes, so the first count bounds all rounds: few nodes are broadcast uncounted, many are written and counted.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = 2 * e.count() <= BROADCAST_ROWS
    for _ in range(60):
        before = e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.filter("b > a").join(F.broadcast(low) if few else small(cut(low)), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(big.filter("a <> b").distinct())
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        low = low if few else cut(low)
        star = e.join(F.broadcast(low) if few else small(low), "a")
        e = cut(star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        # Links are distinct in each, so those in both are there twice.
        if not some(before.unionByName(e).groupBy("a", "b").count().filter("count = 1")):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Rows with a null id take part;
    a component of such rows alone has a null component_id. Repeated rows are in one component; an empty table gives an empty
    result; further columns are ignored.
    """
    fp = cut(fingerprints(df, id_col, text_col, width))
    classes = cut(fp.groupBy("fp").agg(F.min("id").alias("least")))
    edges = components(links(classes.select("fp"), classes.count(), max_bits, shard_rows))
    # Every class with its root class, then the smallest id below each root: a row a class, whatever its number of copies.
    rooted = cut(classes.join(edges.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = cut(rooted.join(least, "root").select("fp", "component_id"))
    return fp.join(small(owner), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
