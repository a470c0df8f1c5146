"""Comparing two annotations of the same documents."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def _lengths(got: DataFrame, want: DataFrame) -> DataFrame:
    """(doc_id, got, want): numbers of tokens, as text, of the documents where they differ; 0 where one side has none."""
    sides = got.select("doc_id", F.lit(1).alias("g"), F.lit(0).alias("w")).unionByName(want.select("doc_id", F.lit(0).alias("g"), F.lit(1).alias("w")))
    n = sides.groupBy("doc_id").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).filter("g <> w")
    return n.select("doc_id", C("g").cast("string").alias("got"), C("w").cast("string").alias("want"))


def _differing(both: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The tokens whose sides differ in some field: compared before anything is built of them."""
    return both.filter(reduce(lambda x, y: x | y, [~C(f"a.{f}").eqNullSafe(C(f"b.{f}")) for f in fields]))


def token_diff(got: DataFrame, want: DataFrame) -> DataFrame:
    """(doc_id, kind, i, got, want): documents of different length differ in length alone; else text, idx and ws, token by token."""
    odd = _lengths(got, want).select("doc_id", F.lit("length").alias("kind"), F.lit(-1).alias("i"), "got", "want")
    both = got.alias("a").join(want.alias("b"), ["doc_id", "i"]).join(odd.select("doc_id"), "doc_id", "left_anti")
    return odd.unionByName(token_diff_of(both))


def token_diff_of(both: DataFrame) -> DataFrame:
    """token_diff of tokens that stand side by side already: (doc_id, i, a, b), structs of got's and want's columns."""
    fields = ("text", "idx", "ws")
    each = _differing(both, fields).select("doc_id", "i", F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), C(f"a.{f}").cast("string").alias("got"), C(f"b.{f}").cast("string").alias("want")) for f in fields])).alias("d"))
    return each.filter(~C("d.got").eqNullSafe(C("d.want"))).select("doc_id", "d.kind", "i", "d.got", "d.want")


def classify(got: DataFrame, want: DataFrame) -> DataFrame:
    """(doc_id, verdict): equal, length, whitespace, offset or real, the gravest that applies."""
    d = token_diff(got, want).groupBy("doc_id").agg(F.max(F.when(C("kind") == "length", 4).when(C("kind") == "text", 3).when(C("kind") == "idx", 2).otherwise(1)).alias("g"), F.count_distinct("kind").alias("n"))
    docs = got.select("doc_id").union(want.select("doc_id")).distinct()
    verdict = F.when(C("g").isNull(), "equal").when(C("g") == 4, "length").when(C("g") == 3, "real").when(C("n") > 1, "real").when(C("g") == 2, "offset").otherwise("whitespace")
    return docs.join(d, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


def attr_diff(got: DataFrame, want: DataFrame, attrs: tuple[str, ...] = ("tag", "pos", "morph", "lemma")) -> DataFrame:
    """(doc_id, i, attr, got, want); where the text differs, only that. A document whose numbers of tokens differ has one row: attr length, i -1."""
    odd = _lengths(got, want)
    both = got.alias("a").join(want.alias("b"), ["doc_id", "i"])
    each = attr_diff_of(both.join(odd.select("doc_id"), "doc_id", "left_anti"), attrs)
    return each.unionByName(odd.select("doc_id", F.lit(-1).alias("i"), F.lit("length").alias("attr"), "got", "want"))


def attr_diff_of(both: DataFrame, attrs: tuple[str, ...] = ("tag", "pos", "morph", "lemma")) -> DataFrame:
    """attr_diff of tokens that stand side by side already: (doc_id, i, a, b), structs of got's and want's columns."""
    rows = F.array(*[F.struct(F.lit(f).alias("attr"), C(f"a.{f}").alias("got"), C(f"b.{f}").alias("want")) for f in ("text", *attrs)])
    wrong = F.filter(rows, lambda x: ~x["got"].eqNullSafe(x["want"]))
    wrong = F.when(C("a.text") != C("b.text"), F.filter(rows, lambda x: x["attr"] == "text")).otherwise(wrong)
    return _differing(both, ("text", *attrs)).select("doc_id", "i", F.inline(wrong))


def attachment(got: DataFrame, want: DataFrame) -> DataFrame:
    """(n, uas, las) over all tokens; 0 where there are none. Raises if a document's numbers of tokens differ."""
    odd = _lengths(got, want).agg(F.count("*").alias("odd"))
    both = got.alias("a").join(want.alias("b"), ["doc_id", "i"])
    head = C("a.head") == C("b.head")
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    s = both.agg(F.count("*").alias("n"), rate(head).alias("uas"), rate(head & (C("a.dep") == C("b.dep"))).alias("las")).join(F.broadcast(odd))
    whole = F.when(C("odd") == 0, C("n")).otherwise(F.raise_error(F.lit("documents differ in their numbers of tokens")).cast("long"))
    return s.select(whole.alias("n"), "uas", "las")


def entity_scores(got: DataFrame, want: DataFrame) -> DataFrame:
    """(tp, fp, fn, p, r, f1) of distinct (doc_id, start, end, label)."""
    keys = ["doc_id", "start", "end", "label"]
    both = got.select(*keys).distinct().withColumn("g", F.lit(1)).join(want.select(*keys).distinct().withColumn("w", F.lit(1)), keys, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g, w = C("g").isNotNull(), C("w").isNotNull()
    s = both.agg(n(g & w).alias("tp"), n(g & ~w).alias("fp"), n(w & ~g).alias("fn"))
    s = s.withColumn("p", F.when(C("tp") + C("fp") == 0, 1.0).otherwise(C("tp") / (C("tp") + C("fp")))).withColumn("r", F.when(C("tp") + C("fn") == 0, 1.0).otherwise(C("tp") / (C("tp") + C("fn"))))
    return s.withColumn("f1", F.when(C("p") + C("r") == 0, 0.0).otherwise(2 * C("p") * C("r") / (C("p") + C("r"))))


def float_diff(pairs: DataFrame, absolute: float = 1e-5, relative: float = 1e-5) -> DataFrame:
    """pairs (got, want): n, failed (neither tolerance met, or NaN), max_abs, mean_abs."""
    d = F.abs(C("got") - C("want"))
    bad = F.isnan("got") | F.isnan("want") | ((d > absolute) & (d > relative * F.abs(C("want"))))
    return pairs.agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("failed"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))


def fixtures(spark, path: str, kind: str) -> DataFrame:
    """Rows of a JSON fixture, one a token or entity, with doc_id as a sentence's place and, keyed by case, its case.

    kind: tokens, attrs, arcs or entities for files ``{"sentences": [{"text", kind-list}]}``, or cases for ``{case: [row, ...]}``. A file
    of another shape raises ValueError.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a fixture: one small file
    data = json.loads(text)
    field = "tokens" if kind == "attrs" else kind
    if kind == "cases":
        if not isinstance(data, dict) or not all(isinstance(v, list) for v in data.values()):
            raise ValueError(f"{path}: a map of lists is needed")
        rows = [(k, case, i, r if isinstance(r, dict) else {"value": r}) for k, (case, rs) in enumerate(data.items()) for i, r in enumerate(rs)]
    else:
        if not isinstance(data, dict) or not all(isinstance(s, dict) and field in s for s in data.get("sentences", [None])):
            raise ValueError(f"{path}: sentences with {field} are needed")
        rows = [(k, s.get("text", ""), i, r) for k, s in enumerate(data["sentences"]) for i, r in enumerate(s[field])]
    names = sorted({n for *_, r in rows for n in r})
    kinds = {n: next((type(r[n]) for *_, r in rows if r.get(n) is not None), str) for n in names}
    sql = {bool: "boolean", int: "long", float: "double"}
    flat = [(k, s, i, *(r.get(n) if kinds[n] in sql else None if r.get(n) is None else r[n] if isinstance(r[n], str) else json.dumps(r[n]) for n in names if n != "i")) for k, s, i, r in rows]
    schema = ", ".join(["doc_id long", ("case" if kind == "cases" else "sentence") + " string", "i int", *(f"`{n}` {sql.get(kinds[n], 'string')}" for n in names if n != "i")])
    return spark.createDataFrame(flat, schema)
