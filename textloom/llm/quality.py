"""Quality rules: counts per document, then robust multivariate outliers.

Base rules drop documents with too few words or too many repeated ones. What
passes them is judged by the minimum covariance determinant: per language and
source (where these are few: per language, else over all rows), concentration
steps look for the part of the documents (``support``, half of them) whose
covariance has the smallest determinant. They start from three estimates
(medians and deviations; covariance of clipped scores; of spatial signs), go on
until the determinant stops falling, and the smallest is kept. The estimate is
made anew over all documents within its 97.5 % ellipsoid, and a document is
rejected if its squared Mahalanobis distance exceeds ``cutoff``, by default the
chi-square quantile that one in 100,000 normal documents exceeds. Everything is
DataFrame expressions: counts are made inside the row, without a shuffle; each
step is one aggregation of five statistics to a row per group.

Sums are taken over fixed-point integers, so that reruns agree to the bit.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, held, let, small, some, words

STATS = ("length", "mean_word", "symbols", "dup_lines", "repeats")
#: Grid of the statistics: 1/GRID. Spread that every group is given at least, by statistic: rates of clean text are often all zero.
GRID = 1024
FLOOR = (0.35, 0.35, 0.05, 0.22, 0.2)
#: Share of normal documents beyond the cutoff; steps that a start may take at most (determinants only fall, so they end sooner).
TAIL, MOST_STEPS = 1e-5, 40


def chi_square(tail: float) -> float:
    """What a chi-square variable of five degrees of freedom exceeds with probability tail."""
    beyond = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > tail else (low, mid)
    return low


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, keep columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of each row.

    Null texts count as empty. A 3-word window is known by the 64-bit hash of its words' hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.length(text) - F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    # Two plain replacements do for almost every text; the other blanks are looked for once.
    solid = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    base = df.select(
        F.col(id_col), *keep,
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("_w"),
        F.length(F.when(solid.rlike(r"[\x09-\x0D]"), F.translate(solid, BLANKS, "")).otherwise(solid)).cast("long").alias("word_chars"),
        (F.length(text) - chars).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    return base.select(
        id_col, *keep,
        F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") < 4, F.lit(0)).otherwise(let(F.col("_w"), _repeated)).cast("long").alias("n_repeat_words"),
    )


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort windows by hash, keep those with an equal neighbour, sort their places, add what each covers anew."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def _covered(windows: Column) -> Column:
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    flagged = let(F.sort_array(pairs), lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"])))
    return F.aggregate(
        F.sort_array(F.transform(flagged, lambda x: x["p"])), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])


def statistics(c: DataFrame) -> list[Column]:
    """The five transformed statistics on the grid, as integers s0..s4."""
    n, chars, lines = (F.greatest(F.col(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    values = (F.log(n.cast("double")), F.log(F.col("word_chars") / n + 1) * 4, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n))
    return [F.round(v * GRID).cast("int").alias(f"s{k}") for k, v in enumerate(values)]


# Estimates are written as SQL text: each name may use those before it, which keeps the expressions short.
_PARTS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
#: Squared Mahalanobis distance of s0..s4 from m0..m4 by the inverse factor a00..a44, and its logarithm on a grid.
DISTANCE = " + ".join("power(" + " + ".join(f"a{i}{k} * (s{k} / {GRID}D - m{k})" for k in range(i + 1)) + ", 2)" for i in range(len(STATS)))
LEVEL = f"greatest(cast(round(log2({DISTANCE} + 1e-9D) * 32) AS int), -512)"


def _factored(g: DataFrame, keys: list[str], mean: list[str], cov: dict[tuple[int, int], str], *more: str) -> DataFrame:
    """keys, more, m0..m4, the Cholesky factor l00..l44 of cov, its inverse a00..a44 and the logarithm of the determinant."""
    p, named = range(len(STATS)), [f"{m} AS m{i}" for i, m in enumerate(mean)] + [f"{c} AS c{i}{j}" for (i, j), c in cov.items()]
    for i, j in _PARTS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        named.append(f"sqrt({rest}) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    for i, j in _PARTS:
        named.append(f"1 / l{i}{i} AS a{i}{i}" if i == j else "-(" + " + ".join(f"l{i}{k} * a{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS a{i}{j}")
    named.append("2 * (" + " + ".join(f"ln(l{i}{i})" for i in p) + ") AS logdet")
    return g.selectExpr(*keys, *more, *named).drop(*[f"c{i}{j}" for i, j in _PARTS])


def _moments(rows: DataFrame, keys: list[str], names: str = "s") -> tuple[DataFrame, list[str], dict[tuple[int, int], str]]:
    """Aggregates of integer columns, and in terms of them the mean and the covariance, both on the grid."""
    p = range(len(STATS))
    sums = [f"sum(cast({names}{i} AS decimal(20,0))) AS t{i}" for i in p] + [f"sum(cast(cast({names}{i} AS long) * {names}{j} AS decimal(20,0))) AS t{i}{j}" for i, j in _PARTS]
    g = rows.groupBy(*keys).agg(F.expr("count(*) AS n"), *map(F.expr, sums))
    mean = [f"cast(t{i} AS double) / n / {GRID}D" for i in p]
    return g, mean, {(i, j): f"(cast(t{i}{j} AS double) / n - cast(t{i} AS double) / n * (cast(t{j} AS double) / n)) / {GRID**2}D" for i, j in _PARTS}


def _fit(rows: DataFrame, keys: list[str], scale: Column | None = None) -> DataFrame:
    """Mean and factor of each group's rows, the covariance times scale."""
    g, mean, cov = _moments(rows, keys)
    g = g if scale is None else g.withColumn("scale", scale)
    by = "" if scale is None else " * scale"
    return _factored(g, keys, mean, {(i, j): c + by + (f" + {FLOOR[i] ** 2!r}D" if i == j else "") for (i, j), c in cov.items()})


def _starts(good: DataFrame, keys: list[str], small_: Callable, held_: Callable) -> DataFrame:
    """keys and start, each with a mean and factor: medians and deviations; with covariances of scores clipped at 1.5, or of spatial signs."""
    p = range(len(STATS))
    # Percentiles are exact: the grid bounds the distinct values.
    center = good.groupBy(*keys).agg(*[F.expr(f"percentile(s{i}, 0.5) AS m{i}") for i in p])
    off = good.join(small_(held_(center)), keys)
    spread = off.groupBy(*keys).agg(*[F.expr(f"first(m{i}) AS m{i}") for i in p], *[F.expr(f"percentile(cast(abs(round(s{i} - m{i})) AS int), 0.5) AS d{i}") for i in p])
    spread = held_(spread.selectExpr(*keys, *[f"m{i}" for i in p], *[f"sqrt(power(d{i} * 1.4826D / {GRID}D, 2) + {FLOOR[i] ** 2!r}D) AS sd{i}" for i in p]))
    mean = [f"m{i} / {GRID}D" for i in p]
    found = _factored(spread, keys, mean, {(i, j): f"power(sd{i}, 2)" if i == j else "0D" for i, j in _PARTS}).withColumn("start", F.lit(0))
    scored = good.join(small_(spread), keys).selectExpr(*keys, *[f"(s{i} - m{i}) / {GRID}D / sd{i} AS z{i}" for i in p])
    norm = "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in p) + "), 1e-9D)"
    clipped = [f"cast(round(greatest(-1.5D, least(1.5D, z{i})) * {GRID}D) AS int) AS u{i}" for i in p]
    signs = [f"cast(round(z{i} / {norm} * {math.sqrt(len(STATS))!r}D * {GRID}D) AS int) AS u{i}" for i in p]
    for k, columns in ((1, clipped), (2, signs)):
        g, _, cov = _moments(scored.selectExpr(*keys, *columns), keys, "u")
        full = {(i, j): f"{c} * sd{i} * sd{j}" + (f" + {FLOOR[i] ** 2!r}D" if i == j else "") for (i, j), c in cov.items()}
        found = found.unionByName(_factored(g.join(small_(spread), keys), keys, mean, full).withColumn("start", F.lit(k)))
    return held_(found)


def _pools(good: DataFrame, keys: list[str], min_group: int) -> tuple[DataFrame, int]:
    """(keys, pool, into) a group, and their number. pool: the longest beginning of the group's keys that min_group rows share, else none of
    them, which stands for all rows. into: the pools in use that hold the group; at most one more than there are keys.
    """
    prefix = lambda k: F.slice(F.array(*keys).cast("array<string>"), 1, k)
    sizes = cut(good.groupBy(*keys).agg(F.count("*").alias("n")))
    n_groups = sizes.count()
    small_ = functools.partial(small, rows=n_groups * (len(keys) + 1))
    each = sizes.select(*keys, "n", F.posexplode(F.array(*[prefix(k) for k in range(len(keys) + 1)])).alias("depth", "key"))
    shared = each.groupBy("depth", "key").agg(F.sum("n").alias("total")).filter((F.col("total") >= min_group) | (F.col("depth") == 0)).select("key")
    held = each.join(small_(shared), "key").select(*keys, "depth", "key")
    chosen = cut(held.groupBy(*keys).agg(F.max("depth").alias("depth")).select(*keys, F.slice(F.array(*keys).cast("array<string>"), F.lit(1), F.col("depth")).alias("pool")))
    into = each.join(small_(chosen.select(F.col("pool").alias("key")).distinct()), "key").groupBy(*keys).agg(F.collect_set("key").alias("into"))
    return cut(chosen.join(small_(into), keys)), n_groups


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"),
    min_words: int = 50, max_repeat_pct: int = 50, support: float = 0.5, cutoff: float | None = None, min_group: int = 40,
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, distance (double), kept.

    base_failed: n_words < min_words, or 100 * n_repeat_words > max_repeat_pct * n_words. kept: not base_failed and
    distance <= cutoff (chi_square(TAIL), 30.86, if not given); only rows that fail the base rules have a null distance. The estimate of a group covers its
    rows that passed the base rules; a group of fewer than min_group such rows is judged by the estimate over all rows
    with its first group columns (its language in all sources), as many of them as leave min_group rows, or over all
    rows. Null group values form a group of their own; null or empty texts have no words and fail; repeated rows, or
    rows with a null id, are each judged; an empty table gives an empty result; further columns are ignored.
    """
    keys = [f"_g{k}" for k in range(len(group_cols))]
    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")).alias(k) for g, k in zip(group_cols, keys)])
    c = counts(named, "_id", "_text", *keys)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = cut(c.select("*", failed.alias("base_failed"), *statistics(c)))
    p = range(len(STATS))
    good = rows.filter(~F.col("base_failed")).select(*keys, *[f"s{i}" for i in p])
    pool_of, n_keys = _pools(good, keys, min_group)
    # Each row once for every estimate that takes it in: its own group's, and those of the pools above that small groups need.
    good = cut(good.join(small(pool_of, n_keys), keys).select(F.explode("into").alias("pool"), *[f"s{i}" for i in p]))
    keys, of = ["pool"], keys
    small_, held_ = (functools.partial(f, rows=3 * n_keys) for f in (small, held))  # at most a pool a group, three starts a pool
    state, ended, of_each, stats = _starts(good, keys, small_, held_), None, [*keys, "start"], [f"s{i}" for i in p]
    each = [*of_each, "before"]
    for step in range(MOST_STEPS):
        # An estimate's own determinant goes with its rows, so that it needs no join of its own.
        far = good.join(small_(state), keys).selectExpr(*of_each, "logdet AS before", *stats, f"{LEVEL} AS level")
        edge = far.groupBy(*each).agg(F.percentile("level", F.lit(support)).alias("edge"))
        near = far.join(small_(edge), each).filter(F.col("level") <= F.col("edge"))
        # The first estimates are of other kinds than those that follow: they are no end.
        falls = F.lit(True) if step == 0 else F.col("logdet") < F.col("before") - 1e-2
        moved = held_(_fit(near, each).withColumn("falls", falls).drop("before"))
        done = moved.filter(~F.col("falls")).drop("falls")
        ended = done if ended is None else ended.unionByName(done)
        state = moved.filter("falls").drop("falls")
        if not some(state):
            break
    else:
        raise RuntimeError("the determinants did not settle")
    names = [f"{x}{i}{j}" for x in "la" for i, j in _PARTS] + [f"m{i}" for i in p]
    best = held_(ended.groupBy(*keys).agg(F.min(F.struct("logdet", "start", *names)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in names]))

    def widened(fit: DataFrame) -> DataFrame:
        """With wide: distances are divided by it, as the median of five statistics' normal distances is 4.35."""
        middle = good.join(small_(fit), keys).selectExpr(*keys, f"{LEVEL} AS level").groupBy(*keys).agg(F.percentile("level", F.lit(0.5)).alias("mid"))
        return held_(fit.join(small_(middle), keys).withColumn("wide", F.greatest(F.pow(F.lit(2.0), F.col("mid") / 32) / 4.35, F.lit(1.0))))

    inside = good.join(small_(widened(best)), keys).filter(f"({DISTANCE}) / wide <= {chi_square(0.025)!r}D").select(*keys, *stats)
    final = widened(held_(_fit(inside, keys)))
    fits = pool_of.select(*of, "pool").join(small_(final), keys)
    judged = rows.join(small(fits, n_keys), of, "left").withColumn("distance", F.when(~F.col("base_failed"), F.expr(f"({DISTANCE}) / wide")))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= (chi_square(TAIL) if cutoff is None else cutoff), F.lit(False))).alias("kept"))
