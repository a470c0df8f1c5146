import json

import numpy as np
import pytest

from textloom.operators import decode, kernels, nn
from textloom.plans import pipeline, registry
from textloom.sources import bundle, msgpack
from textloom.sources.config import Config


def test_config():
    c = Config.parse('# c\n[a]\nx = 3\ny = "t"\n[b.c]\nz = ${a.x}\nw = "n${a:x}"\nl = [1, "q"]\nf = 1.5\nn = null\nt = true\n')
    assert (c.get("b.c.z"), c.get("b.c.w"), c.get("b.c.l"), c.get("b.c.f"), c.get("b.c.t")) == (3, "n3", [1, "q"], 1.5, True)
    assert c.section("b") == {"c": {"z": 3, "w": "n3", "l": [1, "q"], "f": 1.5, "n": 0, "t": True}}
    for bad in ("[a", "x", "a = ${b}", "a = ${b}\nb = ${a}", "a = ${b"):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_msgpack():
    for x in (None, True, 5, -7, 1.5, "é", b"\x00", [1, [2]], {"a": {"b": [None]}}):
        assert msgpack.unpack(msgpack.pack(x)) == x
    assert msgpack.unpack(bytes([0x82, 0xA1, 97, 1, 0xA1, 98, 0x92, 0xFF, 0xCC, 200])) == {"a": 1, "b": [-1, 200]}
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert (msgpack.array(msgpack.unpack(msgpack.pack(a))) == a).all()
    with pytest.raises(ValueError):
        msgpack.array(msgpack.unpack(msgpack.pack(a.astype(np.float64))))


def filled(model, seed=0):
    r = np.random.default_rng(seed)
    for n in model.walk():
        d = n.dims
        o, i, p, f = (d.get(k, 1) for k in ("nO", "nI", "nP", "nF"))
        size = {"E": (d.get("nV", 1), o), "W": (o * p * f, d.get("nM", i)), "b": (o * p,), "G": (i,), "pad": (o * p * f,)}
        for k in n.params:
            n.params[k] = r.normal(0, 0.3, size[k]).astype(np.float32)
    return model


def test_layers():
    x = np.random.default_rng(1).normal(size=(5, 4)).astype(np.float32)
    m = filled(nn.maxout(3, 4, 2))
    want = np.einsum("opi,ti->top", m.params["W"].reshape(3, 2, 4), x) + m.params["b"].reshape(3, 2)
    assert np.allclose(m(x), want.max(2), atol=1e-5)
    n = nn.layer_norm(4)
    n.params = {"G": np.ones(4, np.float32), "b": np.zeros(4, np.float32)}
    assert np.allclose(n(x).mean(1), 0, atol=1e-6) and np.allclose(n(x).std(1), 1, atol=1e-4)
    assert np.allclose(nn.seq2col(x, 1)[0, :4], 0) and np.allclose(nn.seq2col(x, 1)[2, 4:8], x[2])
    assert np.allclose(nn.softmax(x).sum(1), 1) and nn.mish(np.array([[30.0]]))[0, 0] == 30
    back = nn.padded2list(*nn.list2padded([x[:2], x, x[:3]]))
    assert [len(b) for b in back] == [2, 5, 3] and (back[1] == x).all()
    with pytest.raises(ValueError):
        nn.concatenate(nn.Layer("a", lambda m, v: v[:1]), nn.Layer("b"))(x)


def test_model_bytes():
    m = nn.chain(nn.linear(2, 3), nn.softmax_layer(2, 2))
    w = np.ones((2, 3), np.float32)
    stored = {"nodes": [{"name": "c", "dims": {}}, {"name": "l", "dims": {"nO": 2, "nI": 3}}, {"name": "s", "dims": {}}], "params": [{}, {"W": w, "b": np.zeros(2, np.float32)}, {"W": np.eye(2, dtype=np.float32), "b": np.zeros(2, np.float32)}], "attrs": [], "shims": []}
    assert np.allclose(m.load(msgpack.pack(stored))(np.ones((1, 3), np.float32)), 0.5)
    with pytest.raises(ValueError, match="nodes"):
        nn.linear(1, 1).load(msgpack.pack(stored))


def test_registry():
    assert len(registry.names()) == 22 and len(list(registry.build("spacy.Tok2Vec.v2").walk())) == 65
    with pytest.raises(registry.UnknownArchitecture):
        registry.build("x")
    with pytest.raises(registry.NotImplementedArchitecture):
        registry.build("spacy-legacy.Tagger.v1")
    with pytest.raises(ValueError):
        registry.register("spacy.Tagger.v2", registry.tagger)


def test_arcs():
    """A scripted parse: the cat sleeps, with both arcs to the left."""
    moves = decode.Moves([(decode.SHIFT, ""), (decode.REDUCE, ""), (decode.LEFT, "det"), (decode.LEFT, "nsubj"), (decode.RIGHT, "dobj"), (decode.BREAK, "")])
    script = iter([0, 2, 0, 3, 0, 1])

    def score(_):
        s = np.zeros(6)
        s[next(script)] = 1
        return s

    s = decode.decode(decode.State(3), moves, score)
    assert decode.parse_columns(s) == ([1, 2, 2], ["det", "nsubj", "ROOT"], [1, 0, 0])
    assert decode.masked_argmax(np.array([1.0, 1.0]), [False, False]) == -1 and decode.masked_argmax(np.array([1.0, 1.0]), [True, True]) == 0


def test_entities():
    moves = decode.Moves([(decode.BEGIN, "P"), (decode.IN, "P"), (decode.LAST, "P"), (decode.LAST, "Q"), (decode.UNIT, "Q"), (decode.OUT, "")])
    script = iter([5, 0, 2, 4])

    def score(_):
        s = np.zeros(6)
        s[next(script)] = 1
        return s

    s = decode.decode(decode.State(4), moves, score, entity=True)
    assert decode.entity_columns(s) == ([2, 3, 1, 3], ["", "P", "P", "Q"])
    # A sentence start ends what an entity may reach; nothing valid leaves O.
    assert not decode.entity_valid(decode.State(2, starts={1}), decode.BEGIN, "P")
    assert decode.decode(decode.State(2), decode.Moves([(decode.IN, "P")]), lambda _: np.zeros(1), entity=True).iob == [2, 2]


def test_moves():
    m = decode.Moves.load(msgpack.pack({"moves": json.dumps({"1": {"": 3}, "0": {"a": 1, "b": 1, "c": 9}})}), 4)
    assert m.moves == [(0, "c"), (0, "b"), (0, "a"), (1, "")] and m.index(0, "a") == 2
    with pytest.raises(ValueError):
        decode.Moves.load(msgpack.pack({"moves": json.dumps({"9": {}})}), 4)


def test_bundle(spark, tmp_path):
    """A small bundle with random weights, from disk to annotated tokens."""
    def put(name, data):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())

    sub = '@architectures = "spacy.Tok2Vec.v2"\nwidth = 8\ndepth = 1\nattrs = ["NORM", "SHAPE"]\nrows = [20, 10]\n'
    put("meta.json", "{}")
    put("config.cfg", (
        '[nlp]\nlang = "en"\npipeline = ["tok2vec", "tagger", "parser", "attribute_ruler", "lemmatizer", "ner", "odd"]\ndisabled = []\n'
        f'[components.tok2vec.model]\n{sub}[components.tagger.model]\n@architectures = "spacy.Tagger.v2"\nnO = 2\nwidth = 8\n'
        '[components.parser.model]\n@architectures = "spacy.TransitionBasedParser.v2"\nstate_type = "parser"\nhidden_width = 4\n[components.parser.model.tok2vec]\n@architectures = "spacy.Tok2VecListener.v1"\nwidth = 8\n'
        f'[components.ner.model]\n@architectures = "spacy.TransitionBasedParser.v2"\nstate_type = "ner"\nhidden_width = 4\n[components.ner.model.tok2vec]\n{sub}[components.odd.model]\n@architectures = "spacy.Tokenizer.v1"\n'))
    put("vocab/strings.json", json.dumps(["the", "cats", "cat"]))
    moves = {"parser": {"0": {"": 1}, "1": {"": 1}, "2": {"det": 1}, "3": {"dobj": 1}}, "ner": {"1": {"P": 1}, "3": {"P": 1}, "4": {"P": 1}, "5": {"": 1}}}
    for name in ("tok2vec", "tagger", "parser", "ner"):
        cfg = Config.parse((tmp_path / "config.cfg").read_text()).section(f"components.{name}.model")
        m = registry.build(cfg["@architectures"], cfg)
        if name in moves:
            f = 3 if name == "ner" else 8
            m.refs["lower"].dims["nF"] = f
            m.refs["upper"].dims["nO"] = sum(map(len, moves[name].values()))
            put(f"{name}/moves", msgpack.pack({"moves": json.dumps(moves[name])}))
        filled(m, 3)
        nodes = list(m.walk())
        put(f"{name}/model", msgpack.pack({"nodes": [{"name": n.name, "dims": n.dims} for n in nodes], "params": [dict(n.params) for n in nodes], "attrs": [], "shims": []}))
    put("tagger/cfg", json.dumps({"labels": ["NN", "DT"]}))
    put("attribute_ruler/patterns", msgpack.pack([{"patterns": [[{"TAG": "NN"}]], "attrs": {"POS": "NOUN"}, "index": 0}]))
    put("lemmatizer/lookups/lookups.bin", msgpack.pack({"lemma_lookup": {"dict": {bundle.string_id("cats"): "cat"}}}))
    b = bundle.Bundle.load(str(tmp_path))
    m = {r["name"]: r for r in b.manifest(spark).collect()}
    assert m["tok2vec"]["loaded"] and m["ner"]["loaded"] and not m["odd"]["loaded"] and "not offered" in m["odd"]["skipped"]
    docs = spark.createDataFrame([(1, "the cats sat"), (2, "")], "doc_id long, text string")
    got = pipeline.annotate(docs, b).orderBy("i").collect()
    assert [r["lemma"] for r in got] == ["the", "cat", "sat"] and {r["tag"] for r in got} <= {"NN", "DT"} and all(r["ent_iob"] in (1, 2, 3) and r["sent_start"] >= 0 for r in got)
    assert all(r["pos"] == "NOUN" for r in got if r["tag"] == "NN")
    assert {r["ent_iob"] for r in pipeline.annotate(docs, b, frozenset({"ner", "lemmatizer"})).collect()} == {0}
    with pytest.raises(FileNotFoundError):
        bundle.Bundle.load(str(tmp_path / "vocab"))


def test_vectors(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "vectors.npy", np.eye(2, dtype=np.float32))
    (tmp_path / "v" / "vectors.npy").rename(tmp_path / "v" / "vectors")
    (tmp_path / "v" / "key2row").write_bytes(msgpack.pack({bundle.string_id("a"): 0, bundle.string_id("b"): 1}))
    v = bundle.Vectors.load(str(tmp_path / "v")).frame(spark, ["a", "b", "c"])
    assert {r["key"]: list(r["v"]) for r in v.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    t = spark.createDataFrame([(1, "a"), (1, "zz")], "doc_id long, text string")
    assert sorted(list(r["v"]) for r in kernels.static_vectors(t, v, 2).collect()) == [[0.0, 0.0], [1.0, 0.0]]
    d = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    valid = F.array(F.lit(True), F.lit(False), F.lit(True))
    assert tuple(d.select(kernels.argmax(F.col("v")), kernels.masked_argmax(F.col("v"), valid)).first()) == (1, 2)


def test_stream(spark, tmp_path):
    from textloom.streaming import tokens

    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = tokens.write_tokens(tokens.token_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
