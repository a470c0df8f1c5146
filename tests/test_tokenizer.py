import pytest
from pyspark.sql import functions as F

from textloom.operators import rules_en, tokenizer
from textloom.operators.rules_en import special_cases


@pytest.mark.parametrize("text, want", [
    ("", []),
    ("Don't go!", ["Do", "n't", "go", "!"]),
    ("We'll see U.S. troops.", ["We", "'ll", "see", "U.S.", "troops", "."]),
    ("See https://example.com/a?b=1, or mail a.b@mail.example.com.", ["See", "https://example.com/a?b=1", ",", "or", "mail", "a.b@mail.example.com", "."]),
    ("well-known (3km) $5.", ["well", "-", "known", "(", "3", "km", ")", "$", "5", "."]),
    ("of%%% the&&& a$$$", ["of%%%", "the", "&", "&", "&", "a$$$"]),
    ("end.Start a,b", ["end", ".", "Start", "a", ",", "b"]),
    ("10am Mr. I. ok...", ["10", "am", "Mr.", "I.", "ok", "..."]),
    ("cannot gonna C'mon y'all", ["can", "not", "gon", "na", "C'm", "on", "y'", "all"]),
])
def test_pieces(text, want):
    assert tokenizer.tokens_of(text)[0] == want


@pytest.mark.parametrize("text", ["  a  b ", "\t\na b\n\n c", "a b", " ", "é ǅ x y", "(:)) :-)) '''"])
def test_round_trip(text):
    texts, _, at, ws = tokenizer.tokens_of(text)
    assert "".join(t + w for t, w in zip(texts, ws)) == text
    assert all(text[a:a + len(t)] == t for a, t in zip(at, texts))


def test_white_space():
    assert tokenizer.tokens_of("a  b\n c") == (["a", " ", "b", "\n ", "c"], ["a", " ", "b", "\n ", "c"], [0, 2, 3, 4, 6], [" ", "", "", "", ""])


def test_special_cases():
    s = rules_en.special_cases()
    assert all("".join(t for t, _ in v) == k for k, v in s.items())
    assert s["won't"] == (("wo", "will"), ("n't", "not")) and "Well" not in s and s["I'd've"][1][1] == "would"


def test_merge():
    # The stem expands, and its last piece joins the full stop again.
    assert [t for t, _ in tokenizer.split_chunk("Wed.")] == ["We", "d."]


def test_table(spark):
    d = spark.createDataFrame([(1, "A bc."), (2, None), (3, "")], "doc_id long, text string")
    t = tokenizer.tokenize(d)
    assert [tuple(r) for r in t.orderBy("doc_id", "i").collect()] == [(1, 0, "A", " ", 0, "a"), (1, 1, "bc", "", 2, "bc"), (1, 2, ".", "", 4, ".")]
    assert tokenizer.round_trip(t).collect()[0]["text"] == "A bc."
    spans = spark.createDataFrame([(1, 0, 2)], "doc_id long, start int, end int")
    assert tokenizer.span_text(t, spans).collect()[0]["text"] == "A bc"
    assert tokenizer.with_lexemes(t).filter("is_title").count() == 1
    assert d.select(tokenizer.span_at(F.array(*map(F.lit, "abcd")), 1, 3, -1).alias("x")).first()["x"] == "c"


def test_special_case_table():
    cases = special_cases()
    assert len(cases) == 1347 and not {"theses", "those's", "that're", "this've"} & set(cases)
    assert cases["ain't"] == (("ai", ""), ("n't", "not")) and cases["°C."] == (("°", ""), ("C", ""), (".", ""))
    assert cases["How'd'y"] == (("How", "how"), ("'d", ""), ("'y", "you")) and cases["could've"] == (("could", "could"), ("'ve", "")) and cases["im"] == (("i", "i"), ("m", ""))


@pytest.mark.parametrize("text, want", [("theses", ["theses"]), ("those's", ["those", "'s"]), ("ain't", ["ai", "n't"]), ("20°C.", ["20", "°", "C", "."]), ("can't've", ["ca", "n't", "'ve"])])
def test_special_case_tokens(spark, text, want):
    got = tokenizer.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("i").collect()
    assert [r["text"] for r in got] == want
