import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import hashing, lexical, symbols
from textloom.operators import nn


@pytest.mark.parametrize("text, name, want", [
    ("Hello", "shape", "Xxxxx"), ("ABCDEFgh12345", "shape", "XXXXxxdddd"), ("a1", "shape", "xd"), ("....", "shape", "...."), ("......", "shape", "...."), ("Ää9", "shape", "Xxd"),
])
def test_shape(spark, text, name, want):
    assert spark.createDataFrame([(text,)], "t string").select(lexical.shape(F.col("t"))).first()[0] == want


def test_flags(spark):
    words = ["Hello", "HELLO", "hello", "A-B", "a1", "12", "²", "!?", "$", " ", "", "U.S.", "É", "iPhone"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", *[f(F.col("t")).alias(n) for n, f in lexical.FLAGS.items()], lexical.is_space_or_empty(F.col("t")).alias("soe"), lexical.is_space_feature(F.col("t")).alias("sf")).collect()
    r = {x["t"]: x for x in rows}
    assert [w for w in words if r[w]["is_alpha"]] == ["Hello", "HELLO", "hello", "É", "iPhone"]
    assert [w for w in words if r[w]["is_digit"]] == ["12"] and [w for w in words if r[w]["is_punct"]] == ["!?"]
    assert [w for w in words if r[w]["is_title"]] == ["Hello", "A-B", "U.S.", "É"]
    assert [w for w in words if r[w]["is_upper"]] == ["HELLO", "A-B", "U.S.", "É"] and [w for w in words if r[w]["is_lower"]] == ["hello", "a1"]
    assert [w for w in words if r[w]["is_space"]] == [" "] and [w for w in words if r[w]["soe"]] == [" ", ""] and not any(r[w]["sf"] for w in words)
    assert r[""]["is_ascii"] and not r["É"]["is_ascii"]


def test_like_num(spark):
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(w,) for w in "10 -1,000 3/4 ten Third 21st 1st2 a +x ~7 21ST".split()], "t string").select("t", lexical.like_num(F.col("t")).alias("n")).collect()}
    assert [w for w, n in got.items() if n] == ["10", "-1,000", "3/4", "ten", "Third", "21st", "~7", "21ST"]
    # Commas and points are passed over among digits alone.
    plain = {r["t"]: r["n"] for r in spark.createDataFrame([(w,) for w in "ten. te,n 1,000/2 2.1st 1.5 +1,0.0 1/2/3 /2 -ten ++1 st".split()], "t string").select("t", lexical.like_num(F.col("t")).alias("n")).collect()}
    assert [w for w, n in plain.items() if n] == ["1.5", "+1,0.0", "-ten"]


def test_symbols(spark):
    assert len(symbols.SYMBOLS) == 456 and [symbols.symbol_id(n) for n in ("", "IS_ALPHA", "ID", "X", "PERSON", "det", "mark", "root", "ROOT", "_")] == [0, 1, 64, 101, 380, 415, 423, 449, None, 456]
    assert symbols.symbol_name(100) == "VERB" and symbols.symbol_name(0) == "" and symbols.symbol_name(999) is None
    assert hashing.string_id("mark") == 423 and hashing.string_id("I") == hashing.hash64(b"I")
    f = nn.features({"text": ["I", "mark"], "ws": [" ", ""], "norm": ["i", "mark"], "prefix": ["I", "m"], "suffix": ["I", "ark"], "shape": ["X", "xxxx"]})
    assert f[0, 3] == 101 and f[1, 0] == 423 and f[0, 4] == 1
    table = hashing.string_table(spark.createDataFrame([("coffee",), ("mark",)], "text string"), "text")
    assert [r["text"] for r in table.collect()] == ["coffee"]
    ids = spark.createDataFrame([(0,), (423,), (3197928453018144401,), (5,), (77777,)], "id long")
    assert {r["id"]: r["text"] for r in hashing.lookup(ids, table).collect()} == {0: "", 423: "mark", 3197928453018144401: "coffee", 5: "IS_PUNCT", 77777: None}
    texts = spark.createDataFrame([("",), ("det",), ("coffee",), ("tea",)], "text string")
    assert {r["text"]: r["id"] for r in hashing.get(texts, table).collect()} == {"": 0, "det": 415, "coffee": 3197928453018144401, "tea": None}


def test_murmur3_128():
    text = lambda t: "".join(f"{x:08x}" for x in hashing.murmur3_128(t))
    assert text(b"I will not buy this record, it is scratched.") == "a0a9683b25ac5e40d9af2895890dddf5"
    assert text(b"I will not buy this tobacconist's, it is scratched.") == "9b5b7ba2ef3f7866889adeaf00f3f98e"
    assert hashing.murmur3_128(b"") == (0, 0, 0, 0)


def test_hashes():
    # Published values of MurmurHash64A in this seed, and of an id's 128-bit hash being four words.
    assert hashing.hash64(b"coffee") == 3197928453018144401
    assert hashing.string_id("") == 0 and hashing.string_id("VERB", {"VERB": 100}) == 100
    h = hashing.hash4(np.array([1, 2**63], np.uint64), 8)
    assert h.shape == (2, 4) and h.dtype == np.uint32 and len(set(h.ravel().tolist())) == 8


def test_string_table(spark):
    t = hashing.string_table(spark.createDataFrame([("a",), ("a",), (None,), ("",), ("VERB",)], "text string"), "text", {"VERB": 100})
    assert [(r["text"], r["id"] & (2**64 - 1)) for r in t.collect()] == [("a", hashing.hash64(b"a"))]


def test_morph(spark):
    d = spark.createDataFrame([("Number=Plur|Case=Nom",), ("_",), ("",)], "m string")
    assert [r[0] for r in d.select(lexical.morph_has(F.col("m"), "Number=Plur")).collect()] == [True, False, False]
    assert [r[0] for r in d.select(lexical.morph_map(F.col("m"))).collect()] == [{"Number": "Plur", "Case": "Nom"}, {}, {}]
    assert d.select(lexical.explain_label(F.lit("GPE"))).first()[0] == "Countries, cities, states" and d.select(lexical.explain_label(F.lit("?"))).first()[0] == ""
