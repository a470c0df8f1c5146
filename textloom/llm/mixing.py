"""Mixing sources to target weights by entropy balancing.

Targets: each source gets its share, by weight, of ``budget`` times all words,
but at most ``cap`` times its own; what a capped source cannot take is shared
again among the others. Rates: of all rates between 0 and cap that meet a
source's word target, those closest in relative entropy to equal ones are
``cap / (1 + exp(-lam * x))``, x being the size over its source's mean size; the
dual in lam is convex and Newton's steps from 0 approach its root from one side.
Each step is one aggregation over the distinct (source, size) pairs. Copies:
a document's rate is rounded down or up by a hash of its id; ``trials`` roundings
are summed in one pass and each source keeps the one nearest its target.

Sums run over integers or decimals, so that reruns agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, small, some, words

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """key, source_size -> key, source_size, n, target. One row a source; the sort runs over sources, not documents.

    The level t with sum(min(cap * size, t * weight)) = budget * sum(size): sources in ascending order of cap * size / weight,
    the capped ones are those before the first whose own ratio reaches the level left by those before it.
    """
    order = Window.orderBy(F.col("key").isNull(), "key")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = sizes.withColumn("w", w).withColumn("top", (cap * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("top") / F.col("w"), F.col("key").isNull(), "key")
    whole = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    ratio = F.col("top") / F.col("w")
    s = s.withColumn("level", F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("r"), "level"))).over(whole)["level"])
    return s.select("key", "source_size", "n", F.least(F.col("top"), F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return cap / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, trials: int = 64, steps: int = 40, close: float = 1e-5, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, size (long), source_size (long), target (double), rate (double), copies (int), taken (long). With keep, also _kept, a struct of those columns.

    size: words of the text. A source wholly capped takes every document cap times; sources without words take nothing.
    Null sources are one source, the last; null or empty texts have size 0 and are taken 0 times; repeated rows (same id) are
    taken equally often; an empty table gives an empty result; further columns are ignored.
    """
    docs = cut(df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("key"), F.size(words(text_col)).cast("long").alias("size")))
    sizes = cut(docs.groupBy("key", "size").agg(F.count("*").alias("n")))
    totals = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-9)
    state = targets(totals, weights, budget, cap).select("*", (F.col("source_size") / F.col("n")).alias("mean"), F.when(full, 700.0).otherwise(0.0).alias("lam"), full.alias("done"))
    state = cut(state)
    n_sources = state.count()
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(steps):
        if not some(state.filter(~F.col("done"))):
            break
        # Every source has a size, if only zero, so each comes out with its numbers; those without words add nothing.
        at = sizes.alias("z").join(small(state, n_sources).alias("s"), F.col("z.key").eqNullSafe(F.col("s.key")))
        x = F.col("z.size") / F.greatest(F.col("s.mean"), F.lit(1e-300))
        r = _rate(F.col("s.lam"), x, cap)
        words_at = F.when(F.col("z.size") > 0, F.col("z.size") * F.col("z.n"))
        own = [F.first(f"s.{c}").alias(c) for c in ("source_size", "n", "target", "mean", "lam", "done")]
        moved = at.groupBy(F.col("s.key").alias("key")).agg(*own, exact(words_at * r).alias("got"), exact(words_at * r * (1 - r / cap) * x).alias("slope"))
        off = F.coalesce(F.col("got"), F.col("target")) - F.col("target")
        ended = F.col("done") | (F.abs(off) <= close * F.greatest(F.col("target"), F.lit(1.0))) | (F.coalesce(F.col("slope"), F.lit(0.0)) <= 0)
        lam = F.when(ended, F.col("lam")).otherwise(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") - off / F.greatest(F.col("slope"), F.lit(1e-300)))))
        state = held(moved.select("key", "source_size", "n", "target", "mean", lam.alias("lam"), ended.alias("done")), n_sources)
    else:
        if some(state.filter(~F.col("done"))):
            raise RuntimeError(f"Newton's steps did not meet the targets in {steps}")
    d = _rated(docs, state, n_sources, cap)
    tried = d.filter(F.col("size") > 0).select("key", "target", "size", "_id", "rate", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    tried = tried.groupBy("key", "trial").agg(F.sum(F.col("size") * _copies(F.col("trial"), cap)).alias("got"), F.first("target").alias("target"))
    best = tried.groupBy("key").agg(F.min(F.struct(F.abs(F.col("got") - F.col("target")).alias("off"), "trial")).alias("b")).select(F.col("key").alias("k"), F.col("b.trial").alias("trial"))
    state = held(state.join(small(held(best, n_sources), n_sources), F.col("key").eqNullSafe(F.col("k")), "left").drop("k"), n_sources)
    if keep:
        # Columns stay with their rows: sizes are counted again, and only the sources' few numbers are joined.
        docs = df.select(F.struct(*keep).alias("_kept"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("key"), F.size(words(text_col)).cast("long").alias("size"))
    else:
        docs = docs.withColumn("_kept", F.lit(None))
    out = _rated(docs, state, n_sources, cap, "_kept", "trial").withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(_copies(F.coalesce(F.col("trial"), F.lit(0)), cap)))
    made = out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "_kept")
    return made if keep else made.drop("_kept")


def _rated(docs: DataFrame, state: DataFrame, n_sources: int, cap: int, *more: str) -> DataFrame:
    """docs (_id, key, size) with their source's numbers and their rate."""
    full = F.col("s.target") >= cap * F.col("s.source_size") * (1 - 1e-9)
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(cap)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap))
    return docs.alias("d").join(small(state, n_sources).alias("s"), F.col("d.key").eqNullSafe(F.col("s.key"))).select("_id", F.col("s.key").alias("key"), "size", "source_size", "target", rate.alias("rate"), *more)


def _copies(trial: Column, cap: int) -> Column:
    """The rate rounded down or up, by a number in [0, 1) that id and trial fix."""
    u = F.xxhash64(F.col("_id"), trial).bitwiseAND(F.lit(2**52 - 1)) / float(2**52)
    return F.least(F.lit(cap), F.floor(F.col("rate") + u).cast("int"))
