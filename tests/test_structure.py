import json

import pytest

from textloom.operators import evaluate, rules, structure, workflows
from textloom.operators.matcher import Matcher, PatternError

COLS = "doc_id long, i int, text string, ws string, lower string, tag string, pos string, morph string, lemma string, head int, dep string, sent_start int, ent_iob int, ent_type string"


def table(spark, rows):
    """rows: (text, tag, pos, head, dep, sent_start, iob, type)."""
    return spark.createDataFrame([(1, i, t, " ", t.lower(), tag, pos, "", "", h, dep, s, iob, e) for i, (t, tag, pos, h, dep, s, iob, e) in enumerate(rows)], COLS)


@pytest.fixture(scope="module")
def tok(spark):
    return table(spark, [
        ("The", "DT", "DET", 1, "det", 1, 2, ""), ("cat", "NN", "NOUN", 2, "nsubj", 0, 3, "X"), ("saw", "VBD", "VERB", 2, "ROOT", 0, 1, "X"), ("Ann", "NNP", "PROPN", 2, "dobj", 0, 3, "P"),
        ("and", "CC", "CCONJ", 3, "cc", 0, 2, ""), ("Bob", "NNP", "PROPN", 3, "conj", 0, 1, "P"), ("Who", "WP", "PRON", 7, "nsubj", 1, 3, "P"), ("ran", "VBD", "VERB", 7, "ROOT", 0, 3, "Q"), ("?", ".", "PUNCT", 7, "punct", 0, 2, "")]).cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_trees(tok):
    assert dict(rows(structure.children(tok), "i", "children"))[3] == [4, 5]
    assert sorted(m for i, m in rows(structure.subtree(tok), "i", "member") if i == 2) == [0, 1, 2, 3, 4, 5]
    assert dict(rows(structure.left_edge(tok), "i", "left_edge"))[1] == 0


def test_sentences(tok, spark):
    assert rows(structure.sentences(tok), "start", "end") == [(0, 6), (6, 9)]
    with pytest.raises(Exception, match="sentence boundaries"):
        structure.sentences(tok.withColumn("sent_start", tok.i * 0 - 1)).collect()


def test_spans(tok):
    assert rows(structure.noun_chunks(tok), "start", "end") == [(0, 2), (3, 4), (5, 6), (6, 7)]
    # The I after an O opens nothing; B after B opens anew.
    assert rows(structure.entities(tok), "start", "end", "label") == [(1, 3, "X"), (3, 4, "P"), (6, 7, "P"), (7, 8, "Q")]


def test_deep_trees(spark):
    """Left edges of chains, random trees and cycles against walks over heads; conjunct chains of any length end at one head."""
    import random

    r = random.Random(3)
    docs = {1: [max(i - 1, 0) for i in range(37)], 2: [min(i + 1, 20) for i in range(21)], 3: [r.randrange(30) for _ in range(30)], 4: [1, 2, 0, 2, 3], 5: [0]}
    schema = "doc_id long, i int, head int, dep string, pos string"
    t = spark.createDataFrame([(d, i, h, "x", "X") for d, heads in docs.items() for i, h in enumerate(heads)], schema)
    want = {}
    for d, heads in docs.items():
        for i in range(len(heads)):
            at, seen = i, set()
            while at not in seen:
                seen.add(at)
                want[d, at] = min(want.get((d, at), at), i)
                at = heads[at]
    assert {(a, i): e for a, i, e in rows(structure.left_edge(t), "doc_id", "i", "left_edge")} == want
    assert structure.left_edge(t.limit(0)).count() == 0
    listed = [(d, i, max(i - 1, 0), "conj" if i else top, "NOUN") for d, top in ((1, "nsubj"), (2, "nmod")) for i in range(19)]
    flat = structure._conjunct_ends(spark.createDataFrame(listed, schema))
    assert rows(flat, "doc_id", "at", "end") == [(d, i, 0) for d in (1, 2) for i in range(1, 19)]
    # Only the chain whose first head has a chunk label makes chunks, one a noun.
    assert rows(structure.noun_chunks(spark.createDataFrame(listed, schema)), "doc_id", "start", "end") == [(1, i, i + 1) for i in range(19)]


def test_deprojectivize(spark):
    t = table(spark, [("a", "", "", 0, "ROOT", 1, 2, ""), ("b", "", "", 0, "x", 0, 2, ""), ("c", "", "", 1, "want", 0, 2, ""), ("d", "", "", 0, "own||want", 0, 2, "")])
    assert rows(structure.deprojectivize(t), "i", "head", "dep")[3] == (3, 2, "own")


def test_workflows(tok):
    w = {k: f(tok) for k, f in workflows.WORKFLOWS.items()}
    assert rows(w["w08_svo"], "subj", "verb", "obj") == [("cat", "saw", "Ann")]
    assert rows(w["w16_questions"], "sent", "is_question") == [(0, False), (1, True)]
    assert rows(w["w11_sent_segmentation"], "text") == [("The cat saw Ann and Bob",), ("Who ran ?",)]
    assert rows(w["w18_entities"], "text", "label")[0] == ("Ann", "P")
    assert rows(w["w12_sent_count"], "n") == [(2,)]
    for f in w.values():
        f.collect()


def test_matcher(tok):
    m = Matcher().add("np", [{"POS": "NOUN"}], [{"POS": "DET"}, {"POS": "NOUN"}]).add("any", [{"TAG": ""}, {"LOWER": {"REGEX": "^a"}}])
    assert rows(m.matches(tok), "key", "start", "end") == [("any", 2, 4), ("np", 0, 2)]
    assert rows(Matcher().add("x", [{"TAG": {"NOT_IN": ["", "NN", "DT"]}, "IS_ALPHA": True}]).scan(tok), "start")[0] == (2,)


@pytest.mark.parametrize("spec", [{"OP": "+"}, {"ORTH": {"REGEX": "a"}}, {"LOWER": {"IN": "a"}}, {"IS_STOP": 1}, {"TAG": {"IN": [], "NOT_IN": []}}, {"FUZZY": "a"}, {"LENGTH": 3}])
def test_rejected(spec):
    with pytest.raises(PatternError):
        Matcher().add("k", [spec])
    with pytest.raises(PatternError):
        Matcher().add("", [{}])


def test_ruler(tok):
    p = [{"patterns": [[{"TAG": "NN"}]], "attrs": {"TAG": "ZZ", "MORPH": "_"}}, {"patterns": [[{"TAG": "DT"}, {"TAG": "ZZ"}]], "attrs": {"POS": "HIT", "LEMMA": "l"}, "index": 1}, {"patterns": [[{"SHAPE": "x"}]], "attrs": {"POS": "NO"}}]
    got = {r["i"]: r for r in rules.attribute_ruler(tok, p).collect()}
    assert (got[1]["tag"], got[1]["pos"], got[1]["lemma"], got[0]["pos"]) == ("ZZ", "HIT", "l", "DET")


def test_lemmas(spark):
    t = spark.createDataFrame([(1, k, w, p, "", "") for k, (w, p) in enumerate([("Axes", "NOUN"), ("ran", "VERB"), ("up-ed", "VERB"), ("zzs", "NOUN"), ("Bob", "PROPN"), ("The", "DET"), ("dies", "NOUN")])], "doc_id int, i int, text string, pos string, morph string, lemma string")
    r = spark.createDataFrame([("noun", 0, "es", ""), ("noun", 1, "es", "is"), ("noun", 2, "s", ""), ("verb", 0, "ed", "")], "pos string, ord int, old string, new string")
    x = spark.createDataFrame([("noun", "ax"), ("noun", "axis")], "pos string, lemma string")
    e = spark.createDataFrame([("verb", "ran", 0, "run"), ("noun", "dies", 0, "die"), ("noun", "dies", 1, "dice")], "pos string, text string, ord int, lemma string")
    got = {q["text"]: q["lemma"] for q in rules.rule_lemmas(t, r, x, e).collect()}
    assert got == {"Axes": "axis", "ran": "run", "up-ed": "up-", "zzs": "zz", "Bob": "Bob", "The": "the", "dies": "dice"}
    assert {q["lemma"] for q in rules.lookup_lemmas(t, None).collect()} >= {"axes", "bob"}


def test_scores(tok, spark):
    from pyspark.sql import functions as F

    other = tok.withColumn("head", F.when(F.col("i") == 0, 0).otherwise(F.col("head"))).withColumn("tag", F.lit("NN"))
    s = evaluate.attachment(other, tok).first()
    assert s["n"] == 9 and abs(s["uas"] - 8 / 9) < 1e-9
    assert evaluate.attr_diff(other, tok).count() == 8
    assert evaluate.entity_scores(structure.entities(tok), structure.entities(tok)).first()["f1"] == 1.0
    none = structure.entities(tok).limit(0)
    assert tuple(evaluate.entity_scores(none, none).first())[3:] == (1.0, 1.0, 1.0)
    a = spark.createDataFrame([(1, 0, "a", 0, " "), (2, 0, "b", 0, "")], "doc_id int, i int, text string, idx int, ws string")
    b = spark.createDataFrame([(1, 0, "a", 0, ""), (2, 0, "b", 0, ""), (2, 1, "c", 1, "")], "doc_id int, i int, text string, idx int, ws string")
    assert rows(evaluate.classify(a, b), "doc_id", "verdict") == [(1, "whitespace"), (2, "length")]
    f = evaluate.float_diff(spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0)], "got double, want double")).first()
    assert (f["n"], f["failed"]) == (2, 1)


def test_ruler_index_and_empty_values(spark):
    """index counts from a match's start, to either side; outside the document nothing is written; nor are empty values."""
    t = spark.createDataFrame([(1, i, x, x, "NN", "OLD", "m", "l") for i, x in enumerate(["a", "b", "c"])], "doc_id long, i int, text string, lower string, tag string, pos string, morph string, lemma string")
    p = [{"patterns": [[{"ORTH": "b"}]], "attrs": {"POS": "BEFORE", "LEMMA": ""}, "index": -1}, {"patterns": [[{"ORTH": "c"}]], "attrs": {"POS": "LOST"}, "index": 1}, {"patterns": [[{"ORTH": "a"}]], "attrs": {"MORPH": "_"}, "index": 2}, {"patterns": [[{"ORTH": "a"}]], "attrs": {"POS": "X"}, "index": -1}, {"patterns": [[{"ORTH": "a"}]], "attrs": {}}]
    assert [(r["pos"], r["morph"], r["lemma"]) for r in rules.attribute_ruler(t, p).orderBy("i").collect()] == [("BEFORE", "m", "l"), ("OLD", "m", "l"), ("OLD", "", "l")]


def test_lengths_and_fixtures(spark, tmp_path):
    cols = "doc_id long, i int, text string, tag string, pos string, morph string, lemma string, head int, dep string"
    row = lambda d, i: (d, i, "t", "NN", "N", "", "t", 0, "dep")
    a, b = spark.createDataFrame([row(1, 0), row(1, 1), row(2, 0)], cols), spark.createDataFrame([row(1, 0), row(2, 0), row(3, 0)], cols)
    assert {(r["doc_id"], r["attr"], r["got"], r["want"]) for r in evaluate.attr_diff(a, b).collect()} == {(1, "length", "2", "1"), (3, "length", "0", "1")}
    assert tuple(evaluate.attachment(a, a).first()) == (3, 1.0, 1.0)
    with pytest.raises(Exception, match="numbers of tokens"):
        evaluate.attachment(a, b).collect()
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"sentences": [{"text": "a b", "tokens": [{"orth": "a", "idx": 0, "ws": True}, {"orth": "b", "idx": 2, "ws": False}]}]}))
    assert [(r["doc_id"], r["i"], r["orth"], r["idx"], r["ws"]) for r in evaluate.fixtures(spark, str(path), "tokens").orderBy("i").collect()] == [(0, 0, "a", 0, True), (0, 1, "b", 2, False)]
    with pytest.raises(ValueError):
        evaluate.fixtures(spark, str(path), "arcs")
    path.write_text(json.dumps({"s01": [{"text": "a", "pos": "DET"}], "s02": []}))
    assert [(r["case"], r["i"], r["pos"]) for r in evaluate.fixtures(spark, str(path), "cases").collect()] == [("s01", 0, "DET")]
