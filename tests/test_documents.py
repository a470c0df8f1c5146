"""Operators that take whole documents at a time, against those that join and window tokens."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import annotate, evaluate, rules, structure, workflows
from textloom.operators.matcher import Matcher
from textloom.plans import catalog
from textloom.plans.lineage import shared_folder

BITS = ["The", "cat", "was", "Bob", "NOT", "not", "éa", "İ", "日本", "😀", ".", "!", ",", "\n", " \n ", "42", "7x", "Ann", "walked", "\x0b", "x", "ed", "sing", "Σ", "boxes", "likely"]


def same(a, b):
    key = lambda d: sorted(map(repr, d.select(*a.columns).collect()))
    return a.dtypes == b.select(*a.columns).dtypes and key(a) == key(b)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents: random texts, empty ones, and rows that share an id or have none."""
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) + r.choice(["", " ", "  "]) for _ in range(r.randrange(30))) for _ in range(60)] + [None, "", " \n ", "  x", "x  ", "日"]
    rows = [*enumerate(texts), (90, "Dup. it ran"), (90, "Dup. it ran"), (None, "One saw. Two"), (None, "One saw. Two")]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def graphs(spark):
    """Trees, cycles, gaps in i and heads that are no tokens."""
    r = random.Random(5)
    rows = []
    for d in range(40):
        ids = list(range(r.randrange(1, 30))) if d % 2 else sorted(r.sample(range(100), 20))
        rows += [(d, i, r.choice(ids + [200, -3] * (d % 3 == 0)), r.choice(["conj", "nsubj", "dep", "ROOT", "conj"]), r.choice(["NOUN", "PRON", "VERB"]), f"t{i}", r.choice(["", " "])) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, i int, head int, dep string, pos string, text string, ws string").coalesce(2).cache()


def pairs(t):
    return structure.subtree(t).groupBy("doc_id", "i").agg(F.count("*").alias("n"), F.sum("member").alias("members"), F.min("member").alias("left_edge"))


def written(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_annotated(spark, odd):
    alone, shared = annotate.apart(catalog.docs(spark, odd))
    assert alone.count() == 66 and shared.count() == 4 and annotate.apart(alone)[1] is None
    assert same(annotate.annotate(annotate.simple_tokens(alone)), annotate.annotated(alone))
    assert annotate.annotated(alone.limit(0)).count() == 0


def test_totals(spark, odd, graphs):
    assert same(pairs(graphs), structure.subtree_totals(graphs))
    before = written(spark)
    alone = annotate.apart(catalog.docs(spark, odd))[0]
    got = annotate.annotated(alone, work=structure.SUBTREE_TOTALS)
    assert got.count() and written(spark) == before  # nothing but texts is read, nothing is written
    assert same(pairs(annotate.annotate(annotate.simple_tokens(alone))), got)
    assert same(pairs(catalog.tokens(spark, odd)), catalog.QUERIES["subtree"](spark, odd))
    with pytest.raises(Exception, match="share a document"):
        structure.subtree_totals(graphs.union(graphs)).collect()


def test_chunk_texts(spark, odd, graphs):
    assert same(workflows.noun_chunk_texts(graphs), structure.noun_chunk_texts(graphs))
    assert same(workflows.noun_chunk_texts(catalog.tokens(spark, odd)), catalog.QUERIES["w15_noun_chunks"](spark, odd))
    assert structure.noun_chunk_texts(graphs.limit(0)).count() == 0


def test_side_by_side(spark, odd):
    """without a join, so that nothing is written; as the joined forms on documents of their own, rows of shared ids as in SQL."""
    before = written(spark)
    diff = catalog.QUERIES["token_diff"](spark, odd)
    t = annotate.simple_tokens(catalog.docs(spark, odd))
    want = t.filter("i % 5 = 0").select("doc_id", F.lit("text").alias("kind"), "i", F.concat("text", F.lit("~")).alias("got"), F.col("text").alias("want"))
    assert same(want, diff) and "Join" not in diff._jdf.queryExecution().toString()
    alone = annotate.apart(catalog.docs(spark, odd))[0]
    t = annotate.annotated(alone)
    folder = odd + "/alone"
    alone.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = catalog.QUERIES["attr_diff"](spark, folder)
    assert got.count() and written(spark) == before
    assert same(evaluate.attr_diff(catalog._other(t), t), got)


def test_ruler_window(spark, odd):
    """no join and no aggregate over tokens."""
    got = catalog.QUERIES["ruler_last_wins"](spark, odd)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    t = spark.createDataFrame([(1, i, x, x.lower(), x, "P", "m", "l") for i, x in enumerate("ABCA")], "doc_id long, i int, text string, lower string, tag string, pos string, morph string, lemma string")
    p = [{"patterns": [[{"TAG": "A"}, {"TAG": "B"}]], "attrs": {"POS": "next"}, "index": 2}, {"patterns": [[{"TAG": "C"}]], "attrs": {"POS": "last", "MORPH": "_"}}, {"patterns": [[{"TAG": "B"}]], "attrs": {"LEMMA": "back"}, "index": -1}]
    assert [(r["pos"], r["morph"], r["lemma"]) for r in rules.attribute_ruler(t, p).orderBy("i").collect()] == [("P", "m", "back"), ("P", "m", "l"), ("last", "", "l"), ("P", "m", "l")]


def test_counted_first(spark, tmp_path):
    """tokens are counted once, before they meet vectors."""
    plan = catalog.QUERIES["static_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_one_token_matches(spark):
    """nothing to shuffle or compare where no two matches can overlap."""
    t = spark.createDataFrame([(1, i, x, x.lower(), "P") for i, x in enumerate(["a", "b", "a"])], "doc_id long, i int, text string, lower string, pos string").coalesce(1)
    m = Matcher().add("x", [{"ORTH": "a"}], [{"LOWER": "a"}])
    got = m.matches(t)
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0, 1), (1, "x", 2, 3)]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    both = m.add("y", [{"ORTH": "a"}, {"ORTH": "b"}], [{"POS": "P"}])
    assert sorted(map(tuple, both.matches(t).collect())) == [(1, "x", 0, 1), (1, "x", 2, 3), (1, "y", 0, 2), (1, "y", 2, 3)]
