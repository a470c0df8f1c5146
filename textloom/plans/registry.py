"""Architectures by name, built from configuration."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import nn

_built: dict[str, Callable[[dict], nn.Layer]] = {}


class UnknownArchitecture(KeyError):
    """No architecture has the name."""


class NotImplementedArchitecture(NotImplementedError):
    """The name is known, but what it stands for is not offered."""


def register(name: str, build: Callable[[dict], nn.Layer]) -> None:
    if name in _built:
        raise ValueError(f"{name} is registered already")
    _built[name] = build


def build(name: str, cfg: dict | None = None) -> nn.Layer:
    if name not in _built:
        raise UnknownArchitecture(name)
    return _built[name](cfg or {})


def names() -> list[str]:
    return sorted(_built)


def _number(cfg: dict, key: str, default: int) -> int:
    v = cfg.get(key)
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


def _flag(cfg: dict, key: str, default: bool) -> bool:
    v = cfg.get(key)
    return v if isinstance(v, bool) else default


def _strings(cfg: dict, key: str) -> list[str]:
    v = cfg.get(key)
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise ValueError(f"{key} must be a list of strings")
    return v


def _reduce(width: int, n_in: int, pieces: int) -> nn.Layer:
    return nn.chain(nn.chain(nn.maxout(width, n_in, pieces), nn.layer_norm(width)), nn.dropout())


def multi_hash_embed(cfg: dict) -> nn.Layer:
    """One hash table a feature, seeds from 8 on in their order, concatenated and reduced."""
    width, pieces = _number(cfg, "width", 96), _number(cfg, "maxout_pieces", 3)
    attrs, rows = _strings(cfg, "attrs"), cfg.get("rows")
    if not isinstance(rows, list) or len(rows) != len(attrs):
        raise ValueError("rows must be a list as long as attrs")
    tables = [nn.chain(nn.column(k), nn.hash_embed(width, int(r), 8 + k)) for k, r in enumerate(rows)]
    hashed = nn.chain(nn.feature_extractor(tuple(attrs)), nn.passing("list2ragged"), nn.with_array(nn.concatenate(*tables)))
    if _flag(cfg, "include_static_vectors", False):
        embed = nn.concatenate(hashed, nn.static_vectors(width))
        return nn.chain(embed, nn.with_array(_reduce(width, width * (len(attrs) + 1), pieces)), nn.passing("ragged2list"))
    return nn.chain(*hashed.layers, nn.with_array(_reduce(width, width * len(attrs), pieces)), nn.passing("ragged2list"))


def window_encoder(cfg: dict, mish: bool = False, nested: bool = False) -> nn.Layer:
    width, depth, window = _number(cfg, "width", 96), _number(cfg, "depth", 4), _number(cfg, "window_size", 1)
    if depth <= 0:
        raise ValueError("depth must be above zero")
    inner, pieces = (2 * window + 1) * width, _number(cfg, "maxout_pieces", 3)

    def step() -> nn.Layer:
        if mish:
            return nn.chain(nn.expand_window(window), nn.mish_layer(width, inner), nn.layer_norm(width), nn.dropout())
        if nested:
            return nn.chain(nn.expand_window(window), _reduce(width, inner, pieces))
        return nn.chain(nn.expand_window(window), nn.maxout(width, inner, pieces), nn.layer_norm(width), nn.dropout())

    out = nn.with_array(nn.chain(*[nn.residual(step()) for _ in range(depth)]))
    out.attrs["pad"] = window * depth
    return out


def tok2vec(cfg: dict) -> nn.Layer:
    """Embedding and encoder. The encoder's size comes from this level of the configuration, not from its own section."""
    part = cfg.get("embed")
    if isinstance(part, dict):
        embed = build(part.get("@architectures") or "spacy.MultiHashEmbed.v2", part)
    else:
        embed = multi_hash_embed({"attrs": list(nn.FEATURES), "rows": [5000, 1000, 2500, 2500, 50, 50]} | cfg)
    return nn.chain(embed, window_encoder(cfg, nested=True))


def hash_embed_cnn(cfg: dict) -> nn.Layer:
    width, rows = _number(cfg, "width", 96), _number(cfg, "embed_size", 2000)
    tables = [nn.chain(nn.column(k), nn.hash_embed(width, rows, k)) for k in range(4)]
    embed = nn.chain(nn.feature_extractor(nn.FEATURES[:4]), nn.passing("list2ragged"), nn.with_array(nn.concatenate(*tables)), nn.with_array(_reduce(width, 4 * width, _number(cfg, "maxout_pieces", 3))), nn.passing("ragged2list"))
    return nn.chain(embed, window_encoder(cfg))


def listener(cfg: dict) -> nn.Layer:
    return nn.Layer("tok2vec_listener", dims={"nO": _number(cfg, "width", 96)}, attrs={"upstream": cfg.get("upstream", "tok2vec")})


def tagger(cfg: dict) -> nn.Layer:
    width = _number(cfg, "width", 96)
    return nn.chain(listener({"width": width}), nn.with_array(nn.softmax_layer(max(1, _number(cfg, "nO", 50) or 50), width)))


def transition_model(tok2vec_: nn.Layer, lower: nn.Layer, upper: nn.Layer) -> nn.Layer:
    return nn.Layer("parser_model", layers=[tok2vec_, lower, upper], refs={"tok2vec": tok2vec_, "lower": lower, "upper": upper})


def transition_parser(cfg: dict) -> nn.Layer:
    if cfg.get("state_type") not in ("parser", "ner"):
        raise NotImplementedArchitecture(f"state_type {cfg.get('state_type')!r}")
    if not _flag(cfg, "use_upper", True):
        raise ValueError("use_upper = false is not supported")
    hidden, pieces = _number(cfg, "hidden_width", 64), _number(cfg, "maxout_pieces", 2)
    part = cfg["tok2vec"] if isinstance(cfg.get("tok2vec"), dict) else {"@architectures": "spacy.Tok2VecListener.v1", "width": 96}
    source = nn.chain(build(part.get("@architectures") or "spacy.Tok2VecListener.v1", part), nn.passing("list2array"), nn.linear(hidden, _number(part, "width", 96)))
    features = 13 if _flag(cfg, "extra_state_tokens", False) else 8
    return transition_model(source, nn.precomputable_affine(hidden, hidden, features, pieces), nn.linear(1, hidden))


def _absent(name: str) -> Callable[[dict], nn.Layer]:
    def fail(cfg: dict) -> nn.Layer:
        raise NotImplementedArchitecture(name)

    return fail


# The names under which configurations ask for an architecture.
for _name, _build in {
    "spacy.Tok2Vec.v2": tok2vec, "spacy.MultiHashEmbed.v2": multi_hash_embed, "spacy.HashEmbedCNN.v2": hash_embed_cnn, "spacy.MaxoutWindowEncoder.v2": window_encoder,
    "spacy.MishWindowEncoder.v2": lambda cfg: window_encoder(cfg, mish=True), "spacy.StaticVectors.v2": lambda cfg: nn.static_vectors(_number(cfg, "width", 96), _number(cfg, "nM", 300)),
    "spacy.Tagger.v2": tagger, "spacy.TransitionBasedParser.v2": transition_parser,
    "spacy.TransitionModel.v1": lambda cfg: transition_model(listener(cfg), nn.precomputable_affine(64, 64, 8, 2), nn.linear(1, 64)),
    "spacy.PrecomputableAffine.v1": lambda cfg: nn.precomputable_affine(*(_number(cfg, k, d) for k, d in (("nO", 64), ("nI", 64), ("nF", 8), ("nP", 2)))),
    "spacy.Tok2VecListener.v1": listener, "spacy.FeatureExtractor.v1": lambda cfg: nn.feature_extractor(tuple(_strings(cfg, "columns"))),
    "spacy.CharacterEmbed.v2": lambda cfg: nn.Layer("character_embed", dims={"nO": _number(cfg, "width", 96)}), "spacy.Tokenizer.v1": _absent("spacy.Tokenizer.v1"),
}.items():
    register(_name, _build)
for _name in ("Tok2Vec", "HashEmbedCNN", "MultiHashEmbed", "CharacterEmbed", "MaxoutWindowEncoder", "MishWindowEncoder", "TransitionBasedParser", "Tagger"):
    register(f"spacy-legacy.{_name}.v1", _absent(f"spacy-legacy.{_name}.v1"))
