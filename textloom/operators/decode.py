"""Tagging, and greedy transition decoding of dependencies and entities.

A document is decoded by itself; its state lives in the function that decodes
it. Over a token table each document is a group.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from ..sources import msgpack
from .nn import Layer

SHIFT, REDUCE, LEFT, RIGHT, BREAK = range(5)
MISSING, BEGIN, IN, LAST, UNIT, OUT = range(6)


@dataclass
class Moves:
    """Classes in the order of the model's outputs: actions ascending, then labels by frequency and name, both descending."""

    moves: list[tuple[int, str]]

    @classmethod
    def load(cls, data: bytes, last_action: int) -> Moves:
        counts = json.loads(msgpack.unpack(data).get("moves") or "null")
        if counts is None:
            raise ValueError("there are no moves")
        if any(not a.isdigit() or int(a) > last_action for a in counts):
            raise ValueError("an action is unknown")
        return cls([(a, label) for a in sorted(map(int, counts)) for _, label in sorted(((n, x) for x, n in counts[str(a)].items()), reverse=True)])

    def index(self, move: int, label: str) -> int | None:
        return self.moves.index((move, label)) if (move, label) in self.moves else None


@dataclass
class State:
    """Stack, buffer, arcs and entities of one document."""

    n: int
    stack: list[int] = field(default_factory=list)
    back: list[int] = field(default_factory=list)  # put back before the buffer, last first
    next: int = 0
    starts: set[int] = field(default_factory=set)
    shifted: set[int] = field(default_factory=set)  # may not be shifted again
    iob: list[int] = field(default_factory=list)
    spans: list[tuple[int, int, str]] = field(default_factory=list)
    open: tuple[int, str] | None = None

    def __post_init__(self):
        self.head: dict[int, int] = {}
        self.label: dict[int, str] = {}
        # Children by head in the order of their arcs, left ones and right ones.
        self.kids: dict[bool, dict[int, list[int]]] = {True: defaultdict(list), False: defaultdict(list)}
        self.iob = self.iob or [0] * self.n
        self.starts |= {0} if self.n else set()

    def S(self, k: int) -> int:  # noqa: N802
        return self.stack[-1 - k] if k < len(self.stack) else -1

    def B(self, k: int) -> int:  # noqa: N802
        if k < len(self.back):
            return self.back[-1 - k]
        at = self.next + k - len(self.back)
        return at if at < self.n else -1

    def child(self, head: int, left: bool) -> int:
        """The child that was attached last on a side."""
        kids = self.kids[left].get(head)
        return kids[-1] if kids else -1

    @property
    def left_over(self) -> int:
        return self.n - self.next + len(self.back)

    @property
    def final(self) -> bool:
        return not self.stack and not self.left_over

    def push(self) -> None:
        if self.back:
            self.stack.append(self.back.pop())
        else:
            self.stack.append(self.next)
            self.next += 1

    def skip(self) -> None:
        self.push()
        self.stack.pop()

    def attach(self, head: int, child: int, label: str) -> None:
        if child in self.head:
            old = self.head[child]
            self.kids[old > child][old].remove(child)
        self.head[child], self.label[child] = head, label
        self.kids[head > child][head].append(child)

    def end(self) -> None:
        self.stack, self.back, self.next = [], [], self.n

    def parser_features(self) -> list[int]:
        b, s = self.B(0), self.S(0)
        return [b, self.B(1), s, self.S(1), self.S(2), self.child(b, True), self.child(s, True), self.child(s, False)]

    def entity_features(self) -> list[int]:
        b, e = self.B(0), self.open[0] if self.open else -1
        return [b, e, b - 1 if b >= 0 and e >= 0 else -1]


def arc_valid(s: State, move: int, label: str = "") -> bool:
    b = s.B(0)
    if move == SHIFT:
        return s.left_over > 0 if not s.stack else s.left_over > 1 and b not in s.starts and b not in s.shifted
    if move == REDUCE:
        return bool(s.stack)
    if move in (LEFT, RIGHT):
        return bool(s.stack) and s.left_over > 0 and b not in s.starts and not (label == "subtok" and s.S(0) != b - 1)
    return move == BREAK and s.left_over > 1 and s.B(1) == b + 1 and s.B(1) not in s.starts


def arc_apply(s: State, move: int, label: str) -> None:
    if move == SHIFT:
        s.push()
    elif move == REDUCE:
        top = s.stack.pop()
        if top not in s.head and s.stack:
            s.shifted.add(top)
            s.back.append(top)
    elif move == LEFT:
        s.attach(s.B(0), s.S(0), label)
        s.shifted.discard(s.B(0))
        s.stack.pop()
    elif move == RIGHT:
        s.attach(s.S(0), s.B(0), label)
        s.push()
    elif move == BREAK:
        s.starts.add(s.B(1))


def entity_valid(s: State, move: int, label: str) -> bool:
    inside = s.open is not None
    if move in (BEGIN, IN):
        fits = inside and label == s.open[1] if move == IN else not inside
        return fits and bool(label) and s.left_over > 1 and s.B(1) not in s.starts
    if move == LAST:
        return inside and bool(label) and label == s.open[1]
    return not inside and s.left_over > 0 and (move == OUT or move == UNIT and bool(label))


def entity_apply(s: State, move: int, label: str) -> None:
    b = s.B(0)
    if b >= 0:
        s.iob[b] = 2 if move == OUT else 3 if move in (BEGIN, UNIT) else 1
        if move == BEGIN:
            s.open = (b, label)
        elif move == UNIT:
            s.spans.append((b, b + 1, label))
    if move == LAST:
        if s.open and b >= 0:
            s.spans.append((s.open[0], b + 1, s.open[1]))
        s.open = None
    s.skip()


def masked_argmax(scores: np.ndarray, valid: list[bool]) -> int:
    """First of the best valid classes, or -1."""
    return int(np.where(valid, scores, -np.inf).argmax()) if any(valid) else -1


@dataclass
class Scorer:
    """Scores of a state from the cached rows of its feature tokens."""

    cache: np.ndarray
    lower: Layer
    upper: Layer

    @classmethod
    def of(cls, model: Layer, x: np.ndarray, features: int) -> Scorer:
        lower = model.refs["lower"]
        if lower.dims["nF"] != features:
            raise ValueError(f"the model has {lower.dims['nF']} features, not {features}")
        return cls(lower(x).reshape(len(x) + 1, features, -1), lower, model.refs["upper"])

    def __call__(self, tokens: list[int]) -> np.ndarray:
        d = self.lower.dims
        rows = self.cache[np.maximum(np.array(tokens) + 1, 0), np.arange(len(tokens))].sum(0) + self.lower.weight("b", d["nO"] * d["nP"])
        hidden = rows.reshape(d["nO"], d["nP"]).max(1)
        u = self.upper
        return u.weight("W", u.dims["nO"], u.dims["nI"]) @ hidden + u.weight("b", u.dims["nO"])


def decode(s: State, moves: Moves, score: Callable[[list[int]], np.ndarray], entity: bool = False) -> State:
    """Greedy: the best valid move, until the state is final or none is valid."""
    valid, apply, look = (entity_valid, entity_apply, s.entity_features) if entity else (arc_valid, arc_apply, s.parser_features)
    while not s.final:
        k = masked_argmax(score(look()), [valid(s, m, label) for m, label in moves.moves])
        if k < 0:
            if entity:
                s.iob = [x or 2 for x in s.iob]
            s.end()
            break
        apply(s, *moves.moves[k])
    return s


def parse_columns(s: State) -> tuple[list[int], list[str], list[int]]:
    """head, dep and sent_start of each token; a token without a head is its own, a ROOT."""
    r = range(s.n)
    return [s.head.get(i, i) for i in r], [s.label.get(i, "ROOT") for i in r], [int(i in s.starts) for i in r]


def entity_columns(s: State) -> tuple[list[int], list[str]]:
    types = [""] * s.n
    for a, z, label in s.spans:
        types[a:z] = [label] * (z - a)
    return s.iob, types


def tags(scores: np.ndarray, labels: list[str]) -> list[str]:
    """The label of each row's first greatest score; softmax would not change it."""
    return [labels[k] for k in scores.argmax(1)] if len(scores) else []


def per_document(tokens: DataFrame, run: Callable[[pd.DataFrame], dict[str, list]], schema: str) -> DataFrame:
    """tokens with the columns that run makes of each document's rows in order; those of schema are new or replaced."""
    ship(tokens.sparkSession)
    added = [p.strip().split(" ")[0] for p in schema.split(",")]
    kept = [f for f in tokens.schema.fields if f.name not in added]
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + schema

    def each(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i", ignore_index=True)
        return d[[f.name for f in kept]].assign(**run(d))

    return tokens.groupBy("doc_id").applyInPandas(each, full)


def stub_parse(tokens: DataFrame) -> DataFrame:
    """Every token a root of its own sentence: head and dep without a model."""
    from pyspark.sql import functions as F

    return tokens.withColumn("head", F.col("i")).withColumn("dep", F.lit("ROOT")).withColumn("sent_start", (F.col("i") == 0).cast("int"))


def stub_entities(tokens: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return tokens.withColumn("ent_iob", F.lit(2)).withColumn("ent_type", F.lit(""))
