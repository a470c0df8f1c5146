"""Annotating documents: tokenizer, networks, ruler, lemmatizer, in a fixed order; stages that are not asked for are not planned."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import string_id
from ..operators import decode, rules, structure, tokenizer
from ..sources.bundle import Bundle

log = logging.getLogger(__name__)
_NETWORK = "tag string, head int, dep string, sent_start int"


def network(tokens: DataFrame, bundle: Bundle) -> DataFrame:
    """tag, head, dep, sent_start: the shared vectors are computed once and feed tagger and parser in one pass per document."""
    t2v, tagger, parser = (bundle.pipes[n] for n in ("tok2vec", "tagger", "parser"))
    labels = tagger.parts.get("cfg", {}).get("labels", [])
    moves = parser.parts["moves"]

    def run(d: pd.DataFrame) -> dict[str, list]:
        x = t2v.model({c: d[c].tolist() for c in ("text", "ws", "norm", "prefix", "suffix", "shape")})
        projected = parser.model.refs["tok2vec"](x)
        s = decode.decode(decode.State(len(d)), moves, decode.Scorer.of(parser.model, projected, 8))
        head, dep, start = decode.parse_columns(s)
        return {"tag": decode.tags(tagger.model(x), labels), "head": head, "dep": dep, "sent_start": start}

    return structure.deprojectivize(decode.per_document(tokens, run, _NETWORK))


def entities(tokens: DataFrame, bundle: Bundle) -> DataFrame:
    """ent_iob, ent_type, by the component's own vectors; sentence starts bound entities."""
    ner = bundle.pipes["ner"]
    moves = ner.parts["moves"]

    def run(d: pd.DataFrame) -> dict[str, list]:
        x = ner.model.refs["tok2vec"]({c: d[c].tolist() for c in ("text", "ws", "norm", "prefix", "suffix", "shape")})
        s = decode.State(len(d), starts=set(np.nonzero(d["sent_start"].to_numpy() == 1)[0].tolist()))
        iob, kind = decode.entity_columns(decode.decode(s, moves, decode.Scorer.of(ner.model, x, 3), entity=True))
        return {"ent_iob": iob, "ent_type": kind}

    return decode.per_document(tokens, run, "ent_iob int, ent_type string")


def lemma_tables(bundle: Bundle, spark) -> dict[str, DataFrame] | None:
    """The lemmatizer's tables as rows; words by their ids among the bundle's strings."""
    found = bundle.pipes["lemmatizer"].parts.get("tables")
    if found is None:
        return None
    word = {string_id(s): s for s in bundle.strings}
    pos = {string_id(p): p for p in ("noun", "verb", "adj", "adv", "propn", "pron", "aux", "det", "adp", "num", "punct", "sym", "x", "intj", "cconj", "sconj", "part")}
    kinds = {n: {p: v for k, v in found.get(n, {}).items() if (p := pos.get(k) or word.get(k))} for n in ("lemma_rules", "lemma_index", "lemma_exc")}
    text = lambda k: word.get(k & (2**64 - 1), "") if isinstance(k, int) else k
    rows = [(p, i, old, new) for p, rs in kinds["lemma_rules"].items() for i, (old, new) in enumerate(rs)]
    index = [(p, text(w)) for p, ws in kinds["lemma_index"].items() for w in ws]
    exc = [(p, text(k), i, v) for p, ws in kinds["lemma_exc"].items() for k, vs in ws.items() for i, v in enumerate(vs)]
    make = lambda r, s: spark.createDataFrame(r, s)
    return {
        "rules": make(rows, "pos string, ord int, old string, new string"), "index": make(index, "pos string, lemma string"), "exceptions": make(exc, "pos string, text string, ord int, lemma string"),
        "lookup": make([(text(k), v if isinstance(v, str) else text(v) if isinstance(v, int) else v[0]) for k, v in found.get("lemma_lookup", {}).items()], "text string, lemma string")}


def annotate(docs: DataFrame, bundle: Bundle, skip: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a token with all columns. skip: any of attribute_ruler, lemmatizer, ner. Missing components but the lemmatizer only warn."""
    t = tokenizer.with_lexemes(tokenizer.tokenize(docs, id_col, text_col))
    empty = {"tag": "", "pos": "", "morph": "", "lemma": "", "dep": "", "ent_type": ""}
    t = t.withColumns({c: F.lit(v) for c, v in empty.items()} | {"head": F.lit(0), "ent_iob": F.lit(0)})
    ready = lambda n: n in bundle.pipes and not bundle.pipes[n].skipped
    if all(map(ready, ("tok2vec", "tagger", "parser"))):
        t = network(t, bundle)
    else:
        log.warning("tagger and parser are missing")
    if "attribute_ruler" not in skip:
        patterns = bundle.pipes["attribute_ruler"].parts.get("patterns") if "attribute_ruler" in bundle.pipes else None
        if patterns is None:
            log.warning("the attribute ruler is missing")
        else:
            t = rules.attribute_ruler(t, patterns)
    if "lemmatizer" not in skip:
        found = lemma_tables(bundle, docs.sparkSession) if "lemmatizer" in bundle.pipes else None
        if found is None:
            raise ValueError("the lemmatizer is missing")
        rule = bundle.config.get("components.lemmatizer.mode") == "rule"
        t = rules.rule_lemmas(t, found["rules"], found["index"], found["exceptions"]) if rule else rules.lookup_lemmas(t, found["lookup"])
    if "ner" not in skip:
        if ready("ner"):
            t = entities(t, bundle)
        else:
            log.warning("the entity recogniser is missing")
    return t
