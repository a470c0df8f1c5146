"""Queries of network layers and architectures, with weights by rule, and of the string store; each has its SQL.

Inputs and weights are eighths of small integers, so that sums are exact in single precision and both sides agree to the bit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, lexical, symbols
from ..operators import evaluate, kernels, nn, tokenizer
from . import registry, sqlparts
from .lineage import cut
from .catalog import CHUNKS, TOK, WORDS, C, _flat, _q, docs, query, tokens, vectors, words


def _grid(rows: int, cols: int, by: int = 5, mod: int = 9) -> np.ndarray:
    k = np.arange(rows * cols).reshape(rows, cols)
    return ((k * by % mod - mod // 2) / 8).astype(np.float32)


def _bias(n: int) -> np.ndarray:
    return ((np.arange(n) % 5 - 2) / 4).astype(np.float32)


def filled(model: nn.Layer) -> nn.Layer:
    """The model with all parameters set by rule."""
    for node in model.walk():
        d = node.dims
        rows = d.get("nO", 1) * d.get("nP", 1) * d.get("nF", 1)
        made = {"W": lambda: _grid(rows, d.get("nM", d.get("nI", 1))), "b": lambda: _bias(rows), "E": lambda: _grid(d["nV"], d["nO"], 7, 11), "G": lambda: 1 - _bias(d["nI"]) / 2, "pad": lambda: _bias(rows)}
        for name in node.params:
            node.params[name] = made[name]()
    return model


def quantised(spark, sf_dir, width: int = 64) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.slice(F.transform("v", lambda x: F.round(x * 8) / 8 + 0.0), 1, width).alias("v"))


def _x(width: int = 64) -> str:
    return f"WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(x::DOUBLE * 8) / 8 + 0.0)[1:{width}] AS v FROM embeddings)"


def _w(name: str, rows: int, cols: int, by: int = 5, mod: int = 9) -> str:
    return f", {name} AS MATERIALIZED (SELECT list_transform(range({rows}), lambda r: list_transform(range({cols}), lambda c: (((r * {cols} + c) * {by} % {mod} - {mod // 2}) / 8.0)::DOUBLE)) AS {name})"


_B = "((r % 5 - 2) / 4.0)::DOUBLE"


def _linear(w: str, rows: int, v: str = "v", bias: bool = True) -> str:
    return f"list_transform(range({rows}), lambda r: list_dot_product({v}, {w}[r + 1]) + {_B if bias else '0'})"


def _maxout(a: str, n: int, pieces: int) -> str:
    return f"list_transform(range({n}), lambda o: list_max({a}[o * {pieces} + 1:o * {pieces} + {pieces}]))"


def _norm(a: str) -> str:
    """Layer norm with G and b by rule."""
    return f"list_transform({a}, lambda x, k: ((x - list_aggregate({a}, 'avg')) / sqrt(list_aggregate({a}, 'var_pop') + 1e-8) * (1 - ((k - 1) % 5 - 2) / 8.0) + ((k - 1) % 5 - 2) / 4.0)::FLOAT)"


_MISH = "lambda x: (CASE WHEN x > 20 THEN x ELSE x * tanh(ln(1 + exp(x))) END)::FLOAT"


def _rows(inner: str, key: str = "vec_id", digits: int = 5) -> str:
    """The rows of inner (key, y) with one value a row."""
    return f", y AS ({inner}) SELECT {key}, unnest(range(len(y)))::INT AS k, round(unnest(y)::FLOAT::DOUBLE, {digits}) + 0.0 AS x FROM y"


def _out(df: DataFrame, *keys: str, digits: int = 5) -> DataFrame:
    return _flat(df.select(*keys, F.transform("y", lambda x: x.cast("double")).alias("v")), *keys, digits=digits)


# --- layers, row by row --------------------------------------------------------------------------------------------------------

_A = _x() + _w("w6", 6, 64)


@query(_A + _rows(f"SELECT vec_id, {_linear('w6', 6)} AS y FROM x, w6"))
def nn_linear(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.linear(6, 64)), "v"), "vec_id")


_SOFTMAX = ", a AS (SELECT vec_id, " + _linear("w6", 6) + " AS a FROM x, w6), z AS (SELECT vec_id, list_transform(a, lambda v: exp(v - list_max(a))) AS z FROM a)"


@query(_A + _SOFTMAX + _rows("SELECT vec_id, list_transform(z, lambda v: v / list_sum(z)) AS y FROM z"))
def nn_softmax(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.softmax_layer(6, 64)), "v"), "vec_id")


@query(_A + _rows(f"SELECT vec_id, list_transform({_linear('w6', 6)}, {_MISH}) AS y FROM x, w6"))
def nn_mish(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.mish_layer(6, 64)), "v"), "vec_id")


@query(_A + f", a AS (SELECT vec_id, {_linear('w6', 6)} AS a FROM x, w6)" + _rows(f"SELECT vec_id, {_maxout('a', 2, 3)} AS y FROM a"))
def nn_maxout(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.maxout(2, 64, 3)), "v"), "vec_id")


@query(_x() + _rows(f"SELECT vec_id, {_norm('v')} AS y FROM x"))
def nn_layernorm(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.layer_norm(64)), "v"), "vec_id")


@query(_x() + _w("w6", 6, 64) + _w("w3", 3, 6) + f", a AS (SELECT vec_id, {_linear('w6', 6)} AS a FROM x, w6)" + _rows(f"SELECT vec_id, {_linear('w3', 3, 'a')} AS y FROM a, w3"))
def nn_chain(spark, sf_dir):
    """Two linear layers with a dropout between, which predicts the identity."""
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.chain(nn.linear(6, 64), nn.dropout(0.2), nn.linear(3, 6))), "v"), "vec_id")


@query(_A + f", a AS (SELECT vec_id, {_linear('w6', 6)} AS a FROM x, w6)" + _rows(f"SELECT vec_id, a || {_maxout('a', 3, 2)} AS y FROM a"))
def nn_concatenate(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.concatenate(nn.linear(6, 64), nn.maxout(3, 64, 2))), "v"), "vec_id")


@query(_x() + _w("w64", 64, 64) + _rows(f"SELECT vec_id, list_transform({_linear('w64', 64)}, lambda y, k: y + v[k]) AS y FROM x, w64"))
def nn_residual(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(nn.residual(nn.linear(64, 64))), "v"), "vec_id")


_EMBED = "list_transform(range(8), lambda c: e[w0 % {n} + 1][c + 1] + e[w1 % {n} + 1][c + 1] + e[w2 % {n} + 1][c + 1] + e[w3 % {n} + 1][c + 1])"


@query("WITH x AS (SELECT vec_id, vec_id::UHUGEINT AS n FROM embeddings)" + _w("e", 50, 8, 7, 11) + ", " + sqlparts.hash4("x", "n", 3, "h") + _rows(f"SELECT vec_id, {_EMBED.format(n=50)} AS y FROM h, e"))
def nn_hash_embed(spark, sf_dir):
    """Of ids in the second of two columns."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(F.lit(7), "vec_id").cast("array<long>").alias("v"))
    model = filled(nn.chain(nn.Layer("ids", lambda m, x: x.astype(np.uint64)), nn.column(1), nn.hash_embed(8, 50, 3)))
    return _out(nn.over_rows(ids, model, "v"), "vec_id")


# --- layers over sequences: label is the sequence, vec_id the order ------------------------------------------------------------------

_SEQ = ", s AS (SELECT *, (row_number() OVER w - 1)::INT AS \"row\", lag(v) OVER w AS before, lead(v) OVER w AS after FROM x WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


def _window(width: int) -> str:
    zeros = f"list_transform(range({width}), lambda z: 0.0::DOUBLE)"
    return _SEQ + f", c AS (SELECT label, \"row\", v AS own, coalesce(before, {zeros}) || v || coalesce(after, {zeros}) AS v FROM s)"


@query(_x(16) + _window(16) + _w("w4", 4, 48) + _rows(f"SELECT label, \"row\", {_linear('w4', 4)} AS y FROM c, w4", 'label, "row"'))
def nn_window(spark, sf_dir):
    """Neighbours on both sides, projected, in a padded holder."""
    model = filled(nn.with_padded(nn.with_array(nn.chain(nn.expand_window(1), nn.linear(4, 48)))))
    return _out(nn.over_sequences(quantised(spark, sf_dir, 16), model, "label", "vec_id"), "label", "row")


_ENCODER = _x(16) + _window(16)


@query(_ENCODER + _w("w32", 32, 48) + f", a AS (SELECT label, \"row\", own, {_linear('w32', 32)} AS a FROM c, w32), m AS (SELECT label, \"row\", own, {_maxout('a', 16, 2)} AS m FROM a)"
       + _rows(f"SELECT label, \"row\", list_transform({_norm('m')}, lambda y, k: y::FLOAT + own[k]::FLOAT) AS y FROM m", 'label, "row"'))
def arch_maxout_window(spark, sf_dir):
    model = filled(registry.build("spacy.MaxoutWindowEncoder.v2", {"width": 16, "depth": 1, "window_size": 1, "maxout_pieces": 2}))
    return _out(nn.over_sequences(quantised(spark, sf_dir, 16), model, "label", "vec_id"), "label", "row")


@query(_ENCODER + _w("w16", 16, 48) + f", m AS (SELECT label, \"row\", own, list_transform({_linear('w16', 16)}, {_MISH}) AS m FROM c, w16)"
       + _rows(f"SELECT label, \"row\", list_transform({_norm('m')}, lambda y, k: y::FLOAT + own[k]::FLOAT) AS y FROM m", 'label, "row"', 4))
def arch_mish_window(spark, sf_dir):
    model = filled(registry.build("spacy.MishWindowEncoder.v2", {"width": 16, "depth": 1, "window_size": 1}))
    return _out(nn.over_sequences(quantised(spark, sf_dir, 16), model, "label", "vec_id"), "label", "row", digits=4)


@query(_x() + _SEQ + _w("w12", 12, 64) + f""", a AS (SELECT label, "row" + 1 AS t, {_linear('w12', 12, bias=False)} AS a FROM s, w12 UNION ALL SELECT DISTINCT label, 0, list_transform(range(12), lambda r: {_B}) FROM x)"""
       + _rows("SELECT label, (t * 3 + unnest(range(3)))::INT AS \"row\", unnest([a[1:4], a[5:8], a[9:12]]) AS y FROM a", 'label, "row"'))
def arch_precomputable_affine(spark, sf_dir):
    model = filled(registry.build("spacy.PrecomputableAffine.v1", {"nO": 2, "nI": 64, "nF": 3, "nP": 2}))
    return _out(nn.over_sequences(quantised(spark, sf_dir), model, "label", "vec_id"), "label", "row")


@query(_A.replace("w6", "w5").replace("range(6)", "range(5)") + f", a AS (SELECT vec_id, {_linear('w5', 5)} AS a FROM x, w5), z AS (SELECT vec_id, list_transform(a, lambda v: exp(v - list_max(a))) AS z FROM a)"
       + _rows("SELECT vec_id, list_transform(z, lambda v: v / list_sum(z)) AS y FROM z"))
def arch_tagger(spark, sf_dir):
    return _out(nn.over_rows(quantised(spark, sf_dir), filled(registry.build("spacy.Tagger.v2", {"width": 64, "nO": 5})), "v"), "vec_id")


@query(_x() + _w("t", 17, 64, 3, 7) + _w("w8", 8, 64) + _rows(f"SELECT vec_id, CASE WHEN vec_id % 40 < 17 THEN {_linear('w8', 8, 't[vec_id % 40 + 1]', bias=False)} ELSE list_transform(range(8), lambda r: 0.0::DOUBLE) END AS y FROM x, t, w8"))
def arch_static_vectors(spark, sf_dir):
    """Rows of a vector table by key, projected; keys outside it give zeros."""
    model = filled(registry.build("spacy.StaticVectors.v2", {"width": 8, "nM": 64}))
    model.attrs |= {"vectors": _grid(17, 64, 3, 7), "rows": {k: k for k in range(17)}}
    keys = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(C("vec_id") % 40).alias("v"))
    return _out(nn.over_rows(keys, nn.chain(nn.Layer("key", lambda m, x: x[:, 0].astype(np.int64)), model), "v"), "vec_id")


# --- features and embeddings of words -----------------------------------------------------------------------------------------------

COLUMNS = {"text": "text", "ws": "ws", "norm": "norm", "prefix": "prefix", "suffix": "suffix", "shape": "shape"}


def lexemes(spark, sf_dir) -> DataFrame:
    """Distinct words with what the feature extractor reads; words of even length are followed by a space."""
    t = C("text")
    return words(spark, sf_dir).select("text", F.when(F.length(t) % 2 == 0, " ").otherwise("").alias("ws"), F.lower(t).alias("norm"), lexical.prefix(t).alias("prefix"), lexical.suffix(t).alias("suffix"), lexical.shape(t).alias("shape"))


_IDS = WORDS + r""", m AS (SELECT text, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', chr(57344), 'g'), '\p{Ll}', chr(57345), 'g'), '\p{Nd}', 'd', 'g'), '') AS cs FROM words),
    n AS (SELECT text, list_transform(cs, lambda c: CASE WHEN c = chr(57344) THEN 'X' WHEN c = chr(57345) THEN 'x' ELSE c END) AS cs FROM m),
    lex AS MATERIALIZED (SELECT text, lower(text) AS norm, left(text, 1) AS prefix, right(text, 3) AS suffix, CASE WHEN length(text) < 4 THEN array_to_string(cs, '') ELSE array_to_string(list_filter(cs, lambda c, i: NOT coalesce(i > 4 AND cs[i-1] = c AND cs[i-2] = c AND cs[i-3] = c AND cs[i-4] = c, false)), '') END AS shape FROM n),
    names AS (SELECT norm AS s FROM lex UNION SELECT prefix FROM lex UNION SELECT suffix FROM lex UNION SELECT shape FROM lex), """ + sqlparts.hash64("names", "s", "hashed") + ", sym(s, k) AS (VALUES " + ",".join(f"({_q(n)}, {k})" for n, k in symbols.SYMBOLS.items()) + """),
    ids AS MATERIALIZED (SELECT s, coalesce(k::UHUGEINT, h) AS h, coalesce(k::BIGINT, id) AS id FROM hashed LEFT JOIN sym USING (s))"""


@query(_IDS + """ SELECT l.text, a.id AS norm_id, b.id AS prefix_id, c.id AS suffix_id, d.id AS shape_id, (length(l.text) % 2 = 0)::BIGINT AS spacy, 0::BIGINT AS is_space
    FROM lex l JOIN ids a ON a.s = l.norm JOIN ids b ON b.s = l.prefix JOIN ids c ON c.s = l.suffix JOIN ids d ON d.s = l.shape""")
def arch_features(spark, sf_dir):
    model = registry.build("spacy.FeatureExtractor.v1", {"columns": list(nn.FEATURES)})
    out = nn.over_rows(lexemes(spark, sf_dir), model, COLUMNS, kind="long")
    return out.select("text", *[C("y")[k].alias(n) for k, n in enumerate(("norm_id", "prefix_id", "suffix_id", "shape_id", "spacy", "is_space"))])


@query(_IDS + ", " + sqlparts.hash4("ids", "h", 8, "h8") + ", " + sqlparts.hash4("ids", "h", 9, "h9") + _w("e50", 50, 8, 7, 11) + _w("e20", 20, 8, 7, 11) + _w("w16", 16, 16)
       + f", n8 AS MATERIALIZED (SELECT s, {_EMBED.format(n=50)} AS v FROM h8, (SELECT e50 AS e FROM e50)), n9 AS MATERIALIZED (SELECT s, {_EMBED.format(n=20)} AS v FROM h9, (SELECT e20 AS e FROM e20)), "
       + f"v AS (SELECT l.text, a.v || b.v AS v FROM lex l JOIN n8 a ON a.s = l.norm JOIN n9 b ON b.s = l.prefix), a AS (SELECT text, {_linear('w16', 16)} AS a FROM v, w16), mx AS (SELECT text, {_maxout('a', 8, 2)} AS m FROM a)"
       + _rows(f"SELECT text, {_norm('m')} AS y FROM mx", "text"))
def arch_multi_hash_embed(spark, sf_dir):
    model = filled(registry.build("spacy.MultiHashEmbed.v2", {"width": 8, "attrs": ["NORM", "PREFIX"], "rows": [50, 20], "maxout_pieces": 2}))
    return _out(nn.over_rows(lexemes(spark, sf_dir), model, COLUMNS), "text")


@query(_IDS + " SELECT l.text, i.id AS id, l.norm AS back, CASE WHEN length(l.text) % 2 = 0 THEN j.id ELSE -1 END AS stored FROM lex l JOIN ids i ON i.s = l.norm JOIN (SELECT * FROM ids) j ON j.s = l.norm WHERE l.norm = l.text")
def string_store(spark, sf_dir):
    """Of lower-case words: their ids, the text that an id gives back, and the id where the store holds the word (those of even length), else -1."""
    w = words(spark, sf_dir).filter(C("text") == F.lower("text"))
    table = hashing.string_table(w, "text")
    back = hashing.lookup(hashing.with_hash64(w, "text", "id").withColumnRenamed("text", "asked"), table)
    stored = hashing.get(w, table.filter(F.length("text") % 2 == 0)).select(C("text").alias("asked"), C("id").alias("stored"))
    symbol = C("id").between(0, len(symbols.SYMBOLS)) & (F.length("asked") % 2 == 1)
    return back.withColumnRenamed("text", "back").join(stored, "asked").select(C("asked").alias("text"), "id", "back", F.when(symbol | C("stored").isNull(), -1).otherwise(C("stored")).alias("stored"))


# --- further operators ---------------------------------------------------------------------------------------------------------------

@query(CHUNKS + r" SELECT DISTINCT chunk AS text, regexp_matches(chunk, '^[ \t\n\r\v\f]+$') AS is_space, regexp_matches(chunk, '^[ \t\n\r\v\f]*$') AS space_or_empty, regexp_matches(chunk, '^[ \t\n\r]+$') AS space_feature FROM c1")
def lex_space(spark, sf_dir):
    """Of all chunks, the blank ones too."""
    t = C("chunk")
    return tokenizer.chunks(docs(spark, sf_dir)).select("chunk").distinct().select(t.alias("text"), lexical.is_space(t).alias("is_space"), lexical.is_space_or_empty(t).alias("space_or_empty"), lexical.is_space_feature(t).alias("space_feature"))


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) + 0.0 AS x FROM embeddings")
def k_padded2list(spark, sf_dir):
    """There and back: the sequences as they were."""
    v = vectors(spark, sf_dir)
    return kernels.padded2list(kernels.list2padded(v, "label", "vec_id"), "label").select("vec_id", "label", (F.round(C("v")[0], 6) + 0.0).alias("x"))


@query(_x() + _w("w6", 6, 64) + _rows(f"SELECT vec_id, {_linear('w6', 6, bias=False)} AS y FROM x, w6"))
def k_gemm(spark, sf_dir):
    """Rows times a matrix given by its columns."""
    return _out(quantised(spark, sf_dir).select("vec_id", kernels.gemm(C("v"), kernels.matrix(_grid(6, 64).tolist())).alias("y")), "vec_id")


@query(TOK + " SELECT DISTINCT doc_id, (['equal', 'whitespace', 'offset', 'real', 'length', 'real'])[doc_id % 6 + 1] AS verdict FROM tok")
def classify(spark, sf_dir):
    """Documents against a copy with, by id, nothing changed, white space, offsets, texts, a token less, or white space and offsets."""
    t = cut(tokens(spark, sf_dir).select("doc_id", "i", "text", C("i").alias("idx"), "ws"))
    kind, first = C("doc_id") % 6, C("i") == 0
    other = t.filter(~((kind == 4) & first)).withColumns({"ws": F.when(kind.isin(1, 5) & first, "~").otherwise(C("ws")), "idx": F.when(kind.isin(2, 5) & first, -1).otherwise(C("idx")), "text": F.when((kind == 3) & first, "~~").otherwise(C("text"))})
    return evaluate.classify(other, t)
