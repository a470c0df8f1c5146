"""Operators on parsed documents: children, subtrees, sentences, chunks, entities.

All take a token table with doc_id, i, head, ... and stay keyed by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

C = F.col

# Labels that can head a noun chunk.
CHUNK_DEPS = ("oprd", "nsubj", "dobj", "nsubjpass", "pcomp", "pobj", "dative", "appos", "attr", "ROOT")


def children(tokens: DataFrame) -> DataFrame:
    """(doc_id, i, children): ascending; tokens without children have none."""
    kids = tokens.filter("head <> i").groupBy("doc_id", F.col("head").alias("i")).agg(F.array_sort(F.collect_list("i")).alias("children"))
    return tokens.select("doc_id", "i").join(kids, ["doc_id", "i"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<int>")))


def ancestors(tokens: DataFrame, rounds: int = 24) -> DataFrame:
    """(doc_id, i, anc): each token with itself and every head above it.

    Reach doubles each round: what i reaches in 2**k steps reaches on as far again. Cycles only repeat pairs, which are kept once.
    """
    from ..plans.lineage import cut

    tokens = cut(tokens.select("doc_id", "i", "head"))
    up = tokens.select("doc_id", "i", F.col("head").alias("anc"))
    pairs = cut(up.unionByName(tokens.select("doc_id", "i", F.col("i").alias("anc"))).distinct())
    n = pairs.count()
    for _ in range(rounds):
        a, b = pairs.alias("a"), pairs.alias("b")
        far = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.anc") == F.col("b.i"))).select("a.doc_id", "a.i", "b.anc")
        # Rows without a document have no heads, as in SQL; each reaches itself.
        pairs = cut(far.unionByName(pairs.filter("doc_id IS NULL AND i = anc")).distinct())
        if (m := pairs.count()) == n:
            return pairs
        n = m
    raise RuntimeError("trees deeper than 2 ** rounds")


def subtree(tokens: DataFrame) -> DataFrame:
    """(doc_id, i, member): each token's subtree, itself included."""
    return ancestors(tokens).select("doc_id", F.col("anc").alias("i"), F.col("i").alias("member"))


#: Tokens that a worker holds before it works on the whole documents among them.
HELD = 200_000


@dataclass(frozen=True)
class Whole:
    """Work on batches of whole documents, a document's rows in order of i: the columns it takes besides doc_id, what it does with a batch and the places where documents begin, and what it returns besides doc_id."""

    columns: tuple[str, ...]
    body: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]
    schema: str


def _by_document(tokens: DataFrame, work_of: Whole) -> DataFrame:
    """The work over tokens, dealt out by document and sorted."""
    ship(tokens.sparkSession)
    body, schema = work_of.body, f"doc_id {dict(tokens.dtypes)['doc_id']}, {work_of.schema}"
    rows = tokens.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).select(C("_at").alias("at"), "doc_id", *work_of.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays(cs) for cs in zip(*[p.columns for p in parts])], parts[0].schema.names)
            return body(whole, np.flatnonzero(whole.column(0).to_numpy() == 0))

        for b in batches:
            begins = np.flatnonzero(b.column(0).to_numpy() == 0)
            if n + len(b) >= HELD and len(begins) and (n or begins[-1]):
                yield work([*held, b.slice(0, begins[-1])])
                held, n, b = [], 0, b.slice(begins[-1])
            held.append(b)
            n += len(b)
        if n:
            yield work(held)

    return rows.mapInArrow(run, schema)


def _nodes(t: pa.RecordBatch, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes are the distinct (document, i or head), in order: their documents' first rows, their i, their heads as nodes; and each row's node.

    A node that is no token heads itself. Raises where rows share a document and an i.
    """
    i, head = t.column("i").to_numpy().astype(np.int64), t.column("head").to_numpy().astype(np.int64)
    n = len(i)
    size = np.diff(np.append(begins, n))
    first = np.repeat(begins, size)
    if np.array_equal(i, np.arange(n) - first) and (head >= 0).all() and (head < np.repeat(size, size)).all():
        return first, i, first + head, np.arange(n)
    low = min(i.min(), head.min())
    width = max(i.max(), head.max()) - low + 1
    doc = np.repeat(np.arange(len(begins)), size)
    keys, node = np.unique(np.concatenate([doc * width + i - low, doc * width + head - low]), return_inverse=True)
    row, up = node[:n], np.arange(len(keys))
    if len(np.unique(row)) < n:
        raise ValueError("tokens share a document and an i")
    up[row] = node[n:]
    return begins[keys // width], keys % width + low, up, row


def _totals(up: np.ndarray, row: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node's subtree: number of tokens, sum of their i and the first of them. From the leaves up, level by level; a cycle's nodes share theirs."""
    place = np.arange(len(up))
    n, total, low = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64), np.full(len(up), len(up))
    n[row], total[row], low[row] = 1, i[row], row
    below = np.bincount(up[up != place], minlength=len(up))
    now = np.flatnonzero((below == 0) & (up != place))
    left = up != place
    while len(now):
        to = up[now]
        np.add.at(n, to, n[now])
        np.add.at(total, to, total[now])
        np.minimum.at(low, to, low[now])
        np.subtract.at(below, to, 1)
        left[now] = False
        to = np.unique(to)
        now = to[(below[to] == 0) & left[to]]
    for k in np.flatnonzero(left).tolist():
        if left[k]:
            ring = [k]
            while up[ring[-1]] != k:
                ring.append(int(up[ring[-1]]))
            left[ring] = False
            n[ring], total[ring], low[ring] = n[ring].sum(), total[ring].sum(), low[ring].min()
    return n, total, low


def _subtree_totals(t: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
    first, i, up, row = _nodes(t, begins)
    n, total, low = _totals(up, row, i)
    return pa.RecordBatch.from_arrays([t.column("doc_id").take(pa.array(first)), pa.array(i.astype(np.int32)), pa.array(n), pa.array(total), pa.array(i[low].astype(np.int32))], ["doc_id", "i", "n", "members", "left_edge"])


SUBTREE_TOTALS = Whole(("i", "head"), _subtree_totals, "i int, n long, members long, left_edge int")


def subtree_totals(tokens: DataFrame) -> DataFrame:
    """(doc_id, i, n, members, left_edge): of each token's subtree the number of tokens, the sum of their i and the least of them.

    As from the pairs of subtree(), without holding them. Heads that are no tokens have rows too. Raises where rows share a document and
    an i; subtree() takes such.
    """
    return _by_document(tokens, SUBTREE_TOTALS)


def left_edge(tokens: DataFrame) -> DataFrame:
    """(doc_id, i, left_edge): first token of each subtree.

    Each round a token takes the least of those whose head lies 2**k steps up at it, and heads reach twice as far: a row a token,
    however deep the tree. Cycles end with the longest document's length.
    """
    from ..plans.lineage import cut

    state = cut(tokens.select("doc_id", "i", F.col("i").alias("left_edge"), F.col("head").alias("up")))
    longest = state.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(longest - 1, 0).bit_length()):
        below = state.groupBy("doc_id", F.col("up").alias("i")).agg(F.min("left_edge").alias("low"))
        above = state.select("doc_id", F.col("i").alias("up"), F.col("up").alias("further"))
        both = state.join(below, ["doc_id", "i"], "left").join(above, ["doc_id", "up"], "left")
        further = F.coalesce("further", "up")
        # Rows that share a document and an i would multiply each round.
        state = cut(both.select("doc_id", "i", F.least("left_edge", "low").alias("left_edge"), further.alias("up"), (further != F.col("up")).alias("moved")).distinct())
        if state.filter("moved").limit(1).count() == 0:
            break
        state = state.drop("moved")
    return state.select("doc_id", "i", "left_edge").distinct()


def _conjunct_ends(tokens: DataFrame) -> DataFrame:
    """(doc_id, at, end): for each conjunct whose head lies to its left the token where climbing over such conjuncts ends. Reach doubles each round."""
    from ..plans.lineage import cut

    ends = cut(tokens.filter("dep = 'conj' AND head < i").select("doc_id", F.col("i").alias("at"), F.col("head").alias("end")))
    while True:
        on = ends.select("doc_id", F.col("at").alias("end"), F.col("end").alias("further"))
        step = cut(ends.join(on, ["doc_id", "end"], "left").select("doc_id", "at", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")).distinct())
        ends = step.drop("moved")
        if step.filter("moved").limit(1).count() == 0:
            return ends


def with_sentence(tokens: DataFrame) -> DataFrame:
    """Adds sent, the number of a token's sentence in its document. Fails where sentence starts are unknown (-1)."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("sent_start") == -1, F.raise_error(F.lit("sentence boundaries are not set")).cast("int")).otherwise(((F.col("i") > 0) & (F.col("sent_start") == 1)).cast("int"))
    return tokens.withColumn("sent", F.sum(known).over(w).cast("int"))


def sentences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, start, end)."""
    return with_sentence(tokens).groupBy("doc_id", "sent").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))


def noun_chunks(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end): base noun phrases, left to right, none overlapping the one before.

    A noun heads one if its label is a chunk label, or if it is a conjunct and the first head that is none, climbing while heads lie
    to the left, has such a label. The running end is an aggregate over a document's candidates.
    """
    from ..plans.lineage import cut

    tokens = cut(tokens.select("doc_id", "i", "head", "dep", "pos"))
    edge = left_edge(tokens)
    nominal = tokens.filter(F.col("pos").isin("NOUN", "PROPN", "PRON"))
    direct = nominal.filter(F.col("dep").isin(*CHUNK_DEPS)).select("doc_id", "i")
    chain = nominal.filter("dep = 'conj'").select("doc_id", "i", C("head").alias("at"))
    ended = chain.join(_conjunct_ends(tokens), ["doc_id", "at"], "left").select("doc_id", "i", F.coalesce("end", "at").alias("end"))
    heads = tokens.filter(C("dep").isin(*CHUNK_DEPS)).select("doc_id", C("i").alias("end"))
    found = direct.unionByName(ended.join(heads, ["doc_id", "end"]).select("doc_id", "i")).distinct().join(edge, ["doc_id", "i"])
    ordered = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "left_edge"))).alias("c"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    kept = F.aggregate(
        "c", F.struct(F.lit(-1).alias("last"), empty.alias("out")),
        lambda a, x: F.when(x["left_edge"] <= a["last"], a).otherwise(F.struct(x["i"].alias("last"), F.concat(a["out"], F.array(F.struct(x["left_edge"].alias("start"), (x["i"] + 1).alias("end")))).alias("out"))),
        lambda a: a["out"])
    return ordered.select("doc_id", F.inline(kept))


def _noun_chunk_texts(t: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
    first, i, up, row = _nodes(t, begins)
    low = _totals(up, row, i)[2]
    place, kinds = np.arange(len(up)), np.zeros(len(up), np.int64)
    among = lambda c, xs: pc.is_in(t.column(c), pa.array(xs, pa.string())).to_numpy(zero_copy_only=False)
    kinds[row] = among("pos", ("NOUN", "PROPN", "PRON")) | among("dep", CHUNK_DEPS).astype(np.int64) << 1 | among("dep", ("conj",)).astype(np.int64) << 2
    end = np.where((kinds & 4 > 0) & (up < place), up, place)
    while not np.array_equal(further := end[end], end):
        end = further
    heads = (kinds & 2 > 0) | (kinds & 4 > 0) & (kinds[end[up]] & 2 > 0)
    found = np.flatnonzero((kinds & 1 > 0) & heads)
    kept, doc, last = [], -1, -1
    for k, d, a in zip(found.tolist(), first[found].tolist(), low[found].tolist()):
        if d != doc or a > last:
            kept.append(k)
            doc, last = d, k
    z = np.array(kept, np.int64)
    a, rows = low[z], np.zeros(len(up), np.int64)
    rows[row] = np.arange(len(row))
    text, ws = t.column("text"), pc.fill_null(t.column("ws"), "")
    pieces = pc.binary_join_element_wise(text, ws, "")
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)
    data, size = pieces.buffers()[2].to_pybytes(), pc.binary_length(text).to_numpy()
    out = [data[x:y].decode() for x, y in zip(ends[rows[a]].tolist(), (ends[rows[z]] + size[rows[z]]).tolist())]
    return pa.RecordBatch.from_arrays([t.column("doc_id").take(pa.array(first[z])), pa.array(i[a].astype(np.int32)), pa.array((i[z] + 1).astype(np.int32)), pa.array(out, pa.string())], ["doc_id", "start", "end", "text"])


NOUN_CHUNK_TEXTS = Whole(("i", "head", "pos", "dep", "text", "ws"), _noun_chunk_texts, "start int, end int, text string")


def noun_chunk_texts(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, text) of noun_chunks(): one pass over whole documents. Raises where rows share a document and an i; noun_chunks() takes such."""
    return _by_document(tokens, NOUN_CHUNK_TEXTS)


def entities(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): B opens, I goes on, anything else closes; an I that follows no entity opens none."""
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("run", F.sum(F.when(F.col("ent_iob") == 1, 0).otherwise(1)).over(w))
    g = t.groupBy("doc_id", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.min_by("ent_type", "i").alias("label"), F.min_by("ent_iob", "i").alias("first"))
    return g.filter("first = 3").select("doc_id", "start", "end", "label")


def deprojectivize(tokens: DataFrame) -> DataFrame:
    """tokens with labels ``label||headlabel`` taken apart: the token moves to the nearest token below its head with that label.

    Left to right, later tokens seeing earlier moves, breadth first, children in order, whole levels. Documents without such a label pass.
    """
    ship(tokens.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i")
        head, dep = d["head"].tolist(), d["dep"].tolist()
        for k, label in enumerate(dep):
            if "||" not in (label or ""):
                continue
            own, want = label.split("||", 1)
            level, seen, new = [head[k]], {head[k]}, head[k]
            while level and new == head[k]:
                below = [c for p in level for c in range(len(head)) if head[c] == p and c != p and c not in seen and c != k]
                new = next((c for c in below if dep[c] == want), new)
                seen.update(below)
                level = below
            head[k], dep[k] = new, own
        return d.assign(head=head, dep=dep)

    has = tokens.filter(F.col("dep").contains("||")).select("doc_id").distinct()
    moved = tokens.join(has, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(run, tokens.schema)
    return tokens.join(has, "doc_id", "left_anti").unionByName(moved)
