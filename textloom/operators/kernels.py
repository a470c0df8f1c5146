"""Dense kernels as higher-order functions and windows over array columns.

Rows hold array<float|double>; sums run in double, in index order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def matrix(rows: list[list[float]]) -> Column:
    """A literal matrix; for weights of bounded size."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def gemm(x: Column, b_columns: Column) -> Column:
    """A row times a matrix given by its columns."""
    return F.transform(b_columns, lambda c: dot(x, c))


def affine(x: Column, w: Column, bias: Column) -> Column:
    """x @ W.T + b, W given by its rows."""
    return F.zip_with(F.transform(w, lambda r: dot(x, r)), bias, lambda s, b: s + b)


def seq2col(rows: DataFrame, n: int = 1, group: str = "doc_id", order: str = "i", vec: str = "v", width: int | None = None) -> DataFrame:
    """v joined with its n neighbours on both sides; zeros beyond a sequence's ends."""
    w = Window.partitionBy(group).orderBy(order)
    zero = F.transform(F.col(vec), lambda x: x * 0) if width is None else F.array_repeat(F.lit(0.0).cast("float"), width)
    parts = [F.col(vec) if k == 0 else F.coalesce(F.lag(vec, k).over(w) if k > 0 else F.lead(vec, -k).over(w), zero) for k in range(n, -n - 1, -1)]
    return rows.withColumn(vec, F.concat(*parts))


def maxout(x: Column, pieces: int) -> Column:
    """Of each run of pieces values the greatest."""
    return F.transform(F.sequence(F.lit(0), (F.size(x) / pieces).cast("int") - 1), lambda k: F.array_max(F.slice(x, k * pieces + 1, F.lit(pieces))))


def mish(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v > 20, v.cast("double")).otherwise(v * F.tanh(F.log1p(F.exp(v.cast("double"))))))


def softmax(x: Column) -> Column:
    e = lambda v, top: F.exp(v.cast("double") - top)
    shifted = lambda a: F.transform(a, lambda v: e(v, F.array_max(a)))
    return F.element_at(F.transform(F.array(shifted(x)), lambda s: F.transform(s, lambda v: v / F.aggregate(s, F.lit(0.0), lambda p, q: p + q))), 1)


def layer_norm(x: Column, gain: Column, bias: Column, eps: float = 1e-8) -> Column:
    """Population variance over the row."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = lambda a: total(a) / F.size(a)
    centred = F.element_at(F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda v: v - m)), 1)
    normed = F.element_at(F.transform(F.array(centred), lambda c: F.transform(c, lambda v: v / F.sqrt(total(F.transform(c, lambda q: q * q)) / F.size(c) + eps))), 1)
    return F.zip_with(F.zip_with(normed, gain, lambda v, g: v * g), bias, lambda v, b: v + b)


def residual(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def gather_add(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """ids (row, ids array), table (id, v): row and the element-wise sum of its table rows."""
    each = ids.select("row", F.explode("ids").alias(key)).join(table, key).select("row", F.posexplode("v").alias("d", "x"))
    g = each.groupBy("row", "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return g.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))


def reduce_first(rows: DataFrame, group: str = "doc_id", order: str = "i", vec: str = "v") -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(vec, order).alias(vec))


def reduce_last(rows: DataFrame, group: str = "doc_id", order: str = "i", vec: str = "v") -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(vec, order).alias(vec))


def pad(rows: DataFrame, longest: int, width: int, group: str = "doc_id", order: str = "i", vec: str = "v") -> DataFrame:
    """A row a sequence: longest vectors, zeros where it has fewer."""
    g = rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, vec))), lambda x: x[vec]).alias(vec))
    return g.withColumn(vec, F.concat(vec, F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), F.lit(longest) - F.size(vec))))


def list2padded(rows: DataFrame, group: str = "doc_id", order: str = "i") -> DataFrame:
    """rows with time (place in its sequence) and slot (rank of the sequence: longer ones first, then as they come)."""
    size = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("slot", F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1)
    return rows.join(size.select(group, "slot"), group).withColumn("time", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def padded2list(padded: DataFrame, group: str = "doc_id") -> DataFrame:
    """The rows of list2padded as they were."""
    return padded.drop("slot", "time")


def argmax(x: Column) -> Column:
    """First place of the greatest value, from 0; null for an empty array."""
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)).cast("int") - 1)


def masked_argmax(x: Column, valid: Column) -> Column:
    """First place of the greatest valid value; -1 if none is valid."""
    kept = F.zip_with(x, valid, lambda v, ok: F.when(ok, v))
    return F.when(F.exists(valid, lambda v: v), F.array_position(kept, F.array_max(kept)).cast("int") - 1).otherwise(-1)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def static_vectors(tokens: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """tokens with v, the vector (vectors: key, v) of their text; zeros outside the vocabulary."""
    return tokens.join(vectors.select(F.col("key").alias("text"), "v"), "text", "left").withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0).cast("float"), width)))
