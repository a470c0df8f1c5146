"""Benchmark decontamination: a prefix-filtered set join with exact checks.

A window is ``window`` consecutive words of an item (a shorter item is one
window). A document contains a window if its words occur there in a row, so all
of the window's word shingles must occur too. Shingles of ``width`` words are
ordered by rarity in the corpus; a window's prefix is its rarest shingle, and
only documents that hold it, at a place that leaves room for the window on both
sides (length and positional bounds), are compared word by word.

One pass over the texts finds every place of a benchmark shingle. Up to
``set_bound`` shingles are tested inside the row against a hash set; beyond it
places and shingles are joined. Everything later works on those places alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """ASCII-lower-cased words of letters, digits and non-ASCII characters. Pure ASCII texts take the faster lower()."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shingle(w: Column, i: Column, width: int) -> Column:
    """Hash of the words at i..i+width-1; places beyond the end add nothing to it."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(width)])


def windows_of(items: DataFrame, window: int, width: int, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, w, len, k: width of its shingles), and (win, item) of those that hold them."""
    n = F.size("w")
    each = items.select(F.col(item_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("w")).filter(n > 0)
    each = each.select("item", F.explode(F.when(n <= window, F.array("w")).otherwise(
        F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.slice("w", i, window)))).alias("w"))
    each = cut(each.withColumn("win", F.sha2(F.array_join("w", " "), 256)).distinct())
    return each.select("win", "w", n.alias("len"), F.least(n, F.lit(width)).alias("k")).distinct(), each.select("win", "item")


def _places(docs: DataFrame, keys: DataFrame, width: int, window: int, set_bound: int) -> DataFrame:
    """id, row, n_words and places: (p, h, k, near: words around, first: place of the first of them) of each shingle that is one of keys."""
    w = F.col("w")
    span = lambda k: F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    first = lambda p: F.greatest(p - (window - 1), F.lit(0))
    place = lambda p, h, k: F.struct(p.alias("p"), h.alias("h"), k.alias("k"), F.slice(w, first(p) + 1, F.lit(2 * window)).alias("near"), first(p).alias("first"))
    read = docs.select("id", plain_words(F.col("text")).alias("w"))
    known: dict[int, list[int]] = {}  # at most width lengths
    for r in keys.limit(set_bound + 1).collect():
        known.setdefault(r.k, []).append(r.h)
    lengths = sorted(known)
    if sum(map(len, known.values())) <= set_bound:
        at = lambda k: F.transform(F.filter(span(k), lambda i: _shingle(w, i, k).isin(known[k])), lambda i: place(i, _shingle(w, i, k), F.lit(k)))
        spots = [at(k) for k in lengths]
        spots = F.concat(*spots) if spots else F.filter(F.array(place(F.lit(0), F.lit(0).cast("long"), F.lit(0))), lambda x: F.lit(False))
        return cut(read.select("id", F.monotonically_increasing_id().alias("row"), F.size(w).cast("long").alias("n_words"), spots.alias("places")))
    lengths = sorted(r.k for r in keys.select("k").distinct().collect())
    base = cut(read.select("id", F.monotonically_increasing_id().alias("row"), "w"))
    found = None
    for k in lengths:
        hashes = (lambda k: F.transform(span(k), lambda i: _shingle(w, i, k)))(k)
        at = base.select("row", F.posexplode(hashes).alias("p", "h")).withColumn("k", F.lit(k))
        found = at if found is None else found.unionByName(at)
    found = found.join(keys, ["h", "k"]).groupBy("row").agg(F.collect_list(F.struct("p", "h", "k")).alias("spots"))  # a document's own places
    spots = F.transform(F.coalesce("spots", F.filter(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k"))), lambda x: F.lit(False))), lambda x: place(x["p"], x["h"], x["k"]))
    return cut(base.join(found, "row", "left").select("id", "row", F.size(w).cast("long").alias("n_words"), spots.alias("places")))


def _covered(spans: Column) -> Column:
    """Words inside at least one of the [start, end) spans."""
    return F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")),
        lambda a: a["n"])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, width: int = 5, set_bound: int = 200_000,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside an occurrence of a window), n_items (long), items (sorted array of ids as text), contaminated.

    Null or empty texts have no words and hold nothing; null or wordless items have no windows; a null item id is left out of items;
    repeated rows are each judged, repeated items count once by id; an empty table of documents gives an empty result, an empty
    benchmark no hits; further columns are ignored.
    """
    wins, holders = windows_of(items, window, width, item_col, item_text_col)
    spots = wins.select("win", "w", "len", "k", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("at"))
    # get() beyond a short window's end is null, which the hash passes over: its shingle is the whole window.
    spots = cut(spots.withColumn("h", _shingle(F.slice("w", F.col("at") + 1, F.col("k")), F.lit(0), width)))
    rows = _places(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), spots.select("h", "k").distinct(), width, window, set_bound)
    at = rows.filter(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("x")).select("row", "n_words", "x.*")
    seen = cut(at.select("row", "h", "k").distinct().groupBy("h", "k").agg(F.count("*").alias("df")))
    rare = spots.join(seen, ["h", "k"], "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("x"), F.first("w").alias("w"), F.first("len").alias("len"), F.first("k").alias("k"))
    prefix = cut(rare.filter(F.col("x.df") > 0).select("win", "w", "len", "k", F.col("x.h").alias("h"), F.col("x.at").alias("at")))
    tried = at.join(small(prefix), ["h", "k"]).withColumn("start", F.col("p") - F.col("at"))
    hits = tried.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).filter(F.slice("near", F.col("start") - F.col("first") + 1, F.col("len")) == F.col("w"))
    # A document's occurrences: bounded by its own words.
    spans = cut(hits.groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("spans"), F.collect_set("win").alias("wins")))
    held = spans.select("row", F.explode("wins").alias("win")).join(small(holders), "win").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.select("id", "row", "n_words").join(spans.select("row", _covered(F.col("spans")).alias("n_hit")), "row", "left").join(held, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The result with items as the hash of the joined ids."""
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def oracle(window: int = 10) -> str:
    """The digest in SQL, with whole windows as keys."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS ws FROM documents), b AS (SELECT item_id, {words} AS ws FROM benchmark),
    bs AS (SELECT item_id, ws, least(len(ws), {window}) AS k, unnest(range(1, greatest(len(ws) - {window - 1}, 1) + 1)) AS s FROM b WHERE len(ws) > 0),
    bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS t FROM bs),
    ds AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k),
    hit AS MATERIALIZED (SELECT doc_id, s, k, item_id FROM (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS t FROM ds) JOIN bw USING (k, t)),
    cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, s + unnest(range(k)) AS i FROM hit) GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""
