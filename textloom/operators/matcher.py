"""Token-pattern matching: pattern dicts to Column predicates, one pass over the tokens."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical as lex

#: Column and forms of each attribute.
ATTRIBUTES = {
    "ORTH": ("text", {"value", "IN"}), "LOWER": ("lower", {"value", "IN", "REGEX"}), "TAG": ("tag", {"value", "IN", "NOT_IN"}), "POS": ("pos", {"value", "IN"}),
    "DEP": ("dep", {"value", "IN", "NOT_IN"}), "LEMMA": ("lemma", {"value", "IN"}), "ENT_TYPE": ("ent_type", {"value", "IN"})}
FLAGS = {
    "IS_SPACE": lex.is_space_or_empty, "IS_STOP": lex.is_stop, "IS_ALPHA": lex.is_alpha, "IS_PUNCT": lex.is_punct, "IS_DIGIT": lex.is_digit, "LIKE_NUM": lex.like_num}


class PatternError(ValueError):
    """A pattern that is not supported."""


def parse(spec: dict) -> list:
    """Tests, from nothing to a Column each, of one token spec. Empty strings and lists constrain nothing; anything unknown is an error."""
    if not isinstance(spec, dict):
        raise PatternError("a token spec is a dict")
    tests: list = []
    for key, value in spec.items():
        if key in FLAGS:
            if not isinstance(value, bool):
                raise PatternError(f"{key} takes true or false")
            tests.append(lambda f=FLAGS[key], on=value: f(F.col("text")) if on else ~f(F.col("text")))
            continue
        if key not in ATTRIBUTES:
            raise PatternError(f"{key} is not supported")
        name, forms = ATTRIBUTES[key]
        column = lambda name=name: F.coalesce(F.col(name), F.lit(""))
        if isinstance(value, str):
            tests += [lambda c=column, v=value: c() == v] if value else []
            continue
        if not isinstance(value, dict) or len(value) != 1:
            raise PatternError(f"{key} takes a string or a dict with one key")
        (form, arg), = value.items()
        if form not in forms:
            raise PatternError(f"{key} does not take {form}")
        if form == "REGEX":
            if not isinstance(arg, str):
                raise PatternError("REGEX takes a string")
            tests += [lambda c=column, v=arg: c().rlike(v)] if arg else []
        else:
            if not isinstance(arg, (list, tuple)) or not all(isinstance(x, str) for x in arg):
                raise PatternError(f"{form} takes a list of strings")
            if arg:
                # Among NOT_IN, the empty string stands for a value that is not set.
                tests.append(lambda c=column, v=tuple(arg), no=form == "NOT_IN": ~c().isin(*v) if no else c().isin(*v))
    return tests


def predicate(spec: dict) -> Column:
    """Whether a token meets one token spec."""
    return reduce(lambda a, b: a & b, [t() for t in parse(spec)], F.lit(True))


@dataclass
class Matcher:
    """Named alternatives of token patterns."""

    patterns: dict[str, list[list[dict]]] = field(default_factory=dict)

    def add(self, key: str, *alternatives: list[dict]) -> Matcher:
        if not key or not alternatives or not all(alternatives):
            raise PatternError("a key and patterns of at least one token are needed")
        for p in alternatives:
            for spec in p:
                parse(spec)
        self.patterns.setdefault(key, []).extend(alternatives)
        return self

    def remove(self, key: str) -> Matcher:
        self.patterns.pop(key, None)
        return self

    def scan(self, tokens: DataFrame) -> DataFrame:
        """(doc_id, key, start, end) of every alternative's matches, overlapping ones too. One window for all; each spec is tested once."""
        specs: list[dict] = []
        for p in (p for ps in self.patterns.values() for p in ps):
            specs += [s for s in p if s not in specs]
        tested = tokens.select("doc_id", "i", *[predicate(s).alias(f"m{k}") for k, s in enumerate(specs)])
        w = Window.partitionBy("doc_id").orderBy("i")
        found = []
        for key, ps in self.patterns.items():
            for p in ps:
                hits = [F.col(f"m{specs.index(s)}") if k == 0 else F.coalesce(F.lead(f"m{specs.index(s)}", k).over(w), F.lit(False)) for k, s in enumerate(p)]
                found.append(F.when(reduce(lambda a, b: a & b, hits), F.struct(F.lit(key).alias("key"), F.col("i").alias("start"), (F.col("i") + len(p)).alias("end"))))
        # Equal matches of several alternatives begin at the same token.
        marked = tested.select("doc_id", F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
        return marked.filter(F.size("x") > 0).select("doc_id", F.inline("x"))

    def matches(self, tokens: DataFrame) -> DataFrame:
        """scan without overlaps within a key: longest first, then leftmost. Matches of one token cannot overlap and stay as they are found."""
        short = {k: ps for k, ps in self.patterns.items() if all(len(p) == 1 for p in ps)}
        if short:
            rest = {k: ps for k, ps in self.patterns.items() if k not in short}
            found = Matcher(short).scan(tokens)
            return found.unionByName(Matcher(rest).matches(tokens)) if rest else found
        g = self.scan(tokens).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("rank"), "start", "end"))).alias("c"))
        empty = F.array().cast("array<struct<start:int,end:int>>")
        kept = F.aggregate("c", empty, lambda a, x: F.when(F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), a).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
        return g.select("doc_id", "key", F.inline(kept))


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("doc_id", "start", "end", "key")
