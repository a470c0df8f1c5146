"""Reading a model bundle: a folder with configuration, strings, vectors, tables and a part for each component."""

from __future__ import annotations

import ast
import json
import logging
import os
import struct
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import string_id
from ..operators import rules
from ..operators.decode import BREAK, OUT, Moves
from ..operators.nn import Layer
from ..plans import registry
from . import msgpack
from .config import Config

log = logging.getLogger(__name__)


def read(*parts: str) -> bytes:
    with open(os.path.join(*parts), "rb") as f:
        return f.read()


def strings(data: bytes) -> list[str]:
    return json.loads(data)


def npy(data: bytes) -> np.ndarray:
    """A float32 matrix of an .npy file, version 1; an empty shape is allowed."""
    if data[:6] != b"\x93NUMPY" or data[6] != 1:
        raise ValueError("an .npy file of version 1 is needed")
    n = struct.unpack_from("<H", data, 8)[0]
    shape = ast.literal_eval(data[10:10 + n].decode("latin-1").strip())["shape"]
    rows, cols = (*shape, 1, 1)[:2] if shape else (0, 0)
    return np.frombuffer(data, "<f4", rows * cols, 10 + n).reshape(rows, cols).copy()


@dataclass
class Vectors:
    table: np.ndarray
    rows: dict[int, int]

    @classmethod
    def load(cls, folder: str) -> Vectors:
        return cls(npy(read(folder, "vectors")), {k & (2**64 - 1): r for k, r in msgpack.unpack(read(folder, "key2row")).items()})

    def frame(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """(key, row, v) of the names that have a vector."""
        found = [(n, self.rows[h], self.table[self.rows[h]].tolist()) for n in names if (h := string_id(n)) in self.rows]
        return spark.createDataFrame(found, "key string, row int, v array<float>")


def tables(data: bytes) -> dict[str, dict[int, Any]]:
    """Lookup tables by name, keyed by string id: each a map of ids, or a map with such a one under dict."""
    out = {}
    for name, t in msgpack.unpack(data).items():
        t = msgpack.unpack(t) if isinstance(t, bytes) else t
        if not all(isinstance(k, int) for k in t):
            if "dict" not in t:
                raise ValueError(f"table {name} has no dict")
            t = t["dict"]
        if not all(isinstance(k, int) for k in t):
            raise ValueError(f"table {name} is not keyed by ids")
        out[name] = {k & (2**64 - 1): v for k, v in t.items()}
    return out


def ruler_patterns(data: bytes) -> list[dict]:
    """Entries of a ruler; of those that are not supported the first is reported."""
    out = msgpack.unpack(data)
    odd = [p for p in out if p.get("patterns") and not rules.supported(p["patterns"][0])]
    if odd:
        log.warning("%d ruler patterns are passed over, the first being %s", len(odd), odd[0]["patterns"][0])
    return out


@dataclass
class Pipe:
    name: str
    architecture: str | None = None
    model: Layer | None = None
    skipped: str = ""
    parts: dict[str, Any] = field(default_factory=dict)


@dataclass
class Bundle:
    config: Config
    strings: list[str]
    vectors: Vectors | None
    pipes: dict[str, Pipe]

    @classmethod
    def load(cls, folder: str) -> Bundle:
        """A component that can't be offered is marked with the reason; a broken folder or another language is an error."""
        if not os.path.exists(os.path.join(folder, "meta.json")):
            raise FileNotFoundError(f"{folder} has no meta.json")
        config = Config.parse(read(folder, "config.cfg").decode())
        if config.get("nlp.lang") != "en":
            raise ValueError(f"language {config.get('nlp.lang')!r} is not supported")
        here = lambda *p: os.path.exists(os.path.join(folder, *p))
        words = strings(read(folder, "vocab", "strings.json")) if here("vocab", "strings.json") else []
        vectors = Vectors.load(os.path.join(folder, "vocab")) if here("vocab", "vectors") else None
        off = set(config.get("nlp.disabled") or [])
        pipes = {n: cls._pipe(config, folder, n, n in off, vectors) for n in config.get("nlp.pipeline") or []}
        return cls(config, words, vectors, pipes)

    @staticmethod
    def _pipe(config: Config, folder: str, name: str, off: bool, vectors: Vectors | None) -> Pipe:
        pipe = Pipe(name)
        cfg = config.section(f"components.{name}.model")
        there = lambda f: os.path.exists(os.path.join(folder, name, f))
        if off:
            pipe.skipped = "disabled"
            return pipe
        if there("cfg"):
            pipe.parts["cfg"] = own = json.loads(read(folder, name, "cfg"))
            if (own.get("beam_width") or 1) > 1 or own.get("learn_tokens"):
                raise ValueError(f"{name}: beam search and learned tokens are not supported")
        if there("moves"):
            pipe.parts["moves"] = Moves.load(read(folder, name, "moves"), OUT if name == "ner" else BREAK)
        if there("patterns"):
            pipe.parts["patterns"] = ruler_patterns(read(folder, name, "patterns"))
        for f in ("lookups/lookups.bin", "lookups.bin"):
            if there(f):
                pipe.parts["tables"] = tables(read(folder, name, f))
        pipe.architecture = cfg.get("@architectures") or None
        if not pipe.architecture:
            pipe.skipped = "no model section"
            return pipe
        try:
            model = registry.build(pipe.architecture, cfg)
        except (registry.NotImplementedArchitecture, registry.UnknownArchitecture) as e:
            pipe.skipped = f"architecture is not offered: {e}"
            return pipe
        if there("model"):
            try:
                model.load(read(folder, name, "model"))
            except ValueError as e:
                pipe.skipped = f"the stored model does not fit: {e}"
                return pipe
        for node in model.walk():
            if node.name == "static_vectors":
                node.attrs |= {"vectors": vectors.table if vectors else np.zeros((0, node.dims["nM"]), np.float32), "rows": vectors.rows if vectors else {}}
        pipe.model = model
        return pipe

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, p.architecture, bool(p.model), p.skipped) for p in self.pipes.values()], "name string, architecture string, loaded boolean, skipped string")
