"""A rule annotator: fills the annotation columns of a token table from word forms alone.

It makes input for the operators on annotated tokens where no model is at hand,
in plain SQL expressions. It claims no accuracy. Every window runs over one
document, so one exchange by document serves them all.

``annotated`` makes the same table from texts, whole documents at a time in
numpy: no exchange and no sort, and only the columns asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .structure import Whole

SIMPLE = r"(?:[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9])\s*"
WORD_TAGS = {
    "DT": ("the", "a", "an"), "CC": ("and", "or", "but"), "IN": ("in", "of", "on", "by", "with", "at", "from", "for", "to", "as"),
    "PRP": ("it", "he", "she", "they", "you", "we"), "WP": ("what", "who", "which"), "RB": ("not", "here"), "VBZ": ("is", "was", "are", "be")}
SUFFIX_TAGS = (("ly", "RB"), ("er", "JJR"), ("est", "JJS"), ("ing", "VBG"), ("ed", "VBD"), ("ble", "JJ"), ("s", "NNS"))
POS = {
    "DT": "DET", "CC": "CCONJ", "IN": "ADP", "PRP": "PRON", "WP": "PRON", "RB": "ADV", "VBZ": "AUX", "JJR": "ADJ", "JJS": "ADJ", "JJ": "ADJ", "VBG": "VERB", "VBD": "VERB",
    "NNS": "NOUN", "NNP": "PROPN", "NN": "NOUN", "CD": "NUM", ".": "PUNCT", ",": "PUNCT", "SYM": "SYM"}
MORPH = {"NNS": "Number=Plur", "NN": "Number=Sing", "NNP": "Number=Sing", "VBD": "Tense=Past|VerbForm=Fin", "VBG": "Tense=Pres|VerbForm=Part", "JJR": "Degree=Cmp", "JJS": "Degree=Sup", "JJ": "Degree=Pos"}


def simple_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i, text, ws): runs of ASCII letters or digits and single other characters, ws being the white space after each."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SIMPLE), F.lit(0))).alias("i", "piece"))
    text = F.rtrim("piece", F.lit(" \t\n\x0b\x0c\r"))
    return t.select("doc_id", "i", text.alias("text"), F.substring("piece", F.length(text) + 1, F.length("piece")).alias("ws"))


def _mapped(mapping: dict[str, str], value):
    """The value a key maps to, '' for others; the key is computed once, which a CASE would do at each branch."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[value], F.lit(""))


def annotate(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, i, text, ws) with lower, tag, pos, morph, lemma, head, dep, sent_start, ent_iob, ent_type."""
    w = Window.partitionBy("doc_id").orderBy("i")
    t = tokens.withColumn("lower", F.lower("text"))
    low, text = F.col("lower"), F.col("text")
    start = F.when((F.col("i") == 0) | F.lag("text").over(w).isin(".", "!", "?") | F.lag("ws").over(w).contains("\n"), 1).otherwise(0)
    t = t.withColumn("sent_start", start)
    begins = lambda a, z: (text >= a) & (text < chr(ord(z) + 1))
    tag = F.when(text.isin(".", "!", "?"), ".").when(text == ",", ",").when(begins("0", "9"), "CD").when(~(begins("A", "Z") | begins("a", "z")), "SYM")
    for name, ws in WORD_TAGS.items():
        tag = tag.when(low.isin(*ws), name)
    tag = tag.when(begins("A", "Z") & (F.col("sent_start") == 0), "NNP")
    for end, name in SUFFIX_TAGS:
        tag = tag.when((F.length(low) > len(end) + 1) & low.endswith(end), name)
    t = t.withColumn("tag", tag.otherwise("NN"))
    t = t.withColumn("pos", _mapped(POS, F.col("tag"))).withColumn("morph", _mapped(MORPH, F.col("tag")))
    cutoff = F.when(F.col("tag") == "NNS", 1).when(F.col("tag") == "VBG", 3).when(F.col("tag") == "VBD", 2).otherwise(0)
    t = t.withColumn("lemma", F.substring(low, F.lit(1), F.length(low) - cutoff))
    t = t.withColumn("sent", F.sum("sent_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("doc_id", "sent")
    verb = F.when(F.col("pos") == "VERB", F.col("i"))
    t = t.withColumn("root", F.coalesce(F.min(verb).over(s), F.min("i").over(s)))
    t = t.withColumn("last_verb", F.max(verb).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.col("i") > F.col("root")
    t = t.withColumn("head", F.when(F.col("i") == F.col("root"), F.col("i")).when(after, F.greatest(F.col("root"), F.coalesce("last_verb", F.col("root")))).otherwise(F.col("root")))
    noun, pos = F.col("pos").isin("NOUN", "PROPN", "PRON"), F.col("pos")
    past = F.max(F.when((F.col("i") == F.col("root")) & (F.col("tag") == "VBD"), 1).otherwise(0)).over(s)
    dep = (
        F.when(F.col("i") == F.col("root"), "ROOT").when(pos == "VERB", "conj").when(low == "not", "neg").when(noun & ~after & (past == 1) & (F.col("i") % 2 == 0), "nsubjpass")
        .when(noun & ~after, "nsubj").when(noun, "dobj").when(pos == "DET", "det").when(pos == "ADJ", "amod").when(pos == "PUNCT", "punct").otherwise("dep"))
    t = t.withColumn("dep", dep)
    name = F.col("tag") == "NNP"
    t = t.withColumn("ent_iob", F.when(~name, 2).when(F.lag("tag").over(w) == "NNP", 1).otherwise(3))
    t = t.withColumn("ent_type", F.when(~name, "").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE")]), F.length("text") % 3 + 1)))
    return t.select("doc_id", "i", "text", "ws", "lower", "tag", "pos", "morph", "lemma", "head", "dep", "sent_start", "ent_iob", "ent_type")


COLUMNS = {
    "doc_id": None, "i": "int", "text": "string", "ws": "string", "lower": "string", "tag": "string", "pos": "string", "morph": "string", "lemma": "string", "head": "int", "dep": "string",
    "sent_start": "int", "ent_iob": "int", "ent_type": "string"}
#: Bytes of texts that are worked on at a time, and distinct words that a worker remembers.
SLICE, KEPT_WORDS = 1 << 20, 300_000
_TAGS = ["NN", ".", ",", "CD", "SYM", *WORD_TAGS, "NNP", *[t for _, t in SUFFIX_TAGS]]
_CUTOFF = {"NNS": 1, "VBG": 3, "VBD": 2}
_DEPS = ["ROOT", "conj", "neg", "nsubjpass", "nsubj", "dobj", "det", "amod", "punct", "dep"]
_TYPES = ["PERSON", "ORG", "GPE", ""]
# Kinds of bytes: white space, inside a character, letters, digits, the rest.
_KIND = np.full(256, 4, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")], _KIND[0x80:0xC0], _KIND[ord("0"):ord("9") + 1] = 0, 1, 3
_KIND[ord("A"):ord("Z") + 1] = _KIND[ord("a"):ord("z") + 1] = 2


def _tag(text: str, low: str, starts: bool) -> str:
    """The tag of a word, at the start of a sentence or not, as annotate's."""
    if text in (".", "!", "?"):
        return "."
    if text == ",":
        return ","
    if "0" <= text[0] <= "9":
        return "CD"
    if not ("A" <= text[0] <= "Z" or "a" <= text[0] <= "z"):
        return "SYM"
    found = next((t for t, ws in WORD_TAGS.items() if low in ws), None)
    if found is None and not starts and "A" <= text[0] <= "Z":
        found = "NNP"
    return found or next((t for end, t in SUFFIX_TAGS if len(low) > len(end) + 1 and low.endswith(end)), "NN")


class _Words:
    """What depends on a word alone, remembered: its lower case, its type, and its tags and lemmas inside and at the start of a sentence."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def of(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """By word: lower case and type; by word and place (two rows a word): tag and lemma."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = []
        for text in words:
            x = self.known.get(text)
            if x is None:
                low = text.lower()
                tags = [_tag(text, low, starts) for starts in (False, True)]
                x = self.known[text] = (low, len(text) % 3, *[_TAGS.index(t) for t in tags], *[low[:len(low) - _CUTOFF.get(t, 0)] for t in tags])
            found.append(x)
        return [x[0] for x in found], np.array([x[1] for x in found], np.int8), np.array([y for x in found for y in x[2:4]], np.int8), [y for x in found for y in x[4:6]]


_words = _Words()


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _annotate(ids: pa.Array, texts: pa.Array, columns: tuple[str, ...]) -> pa.RecordBatch:
    """The tokens of some whole documents."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if texts.buffers()[2] is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[data]
    blank = kind == 0
    first = kind > 1
    first[1:] &= ~((kind[1:] == kind[:-1]) & (kind[1:] < 4))
    heads = ends[:-1][ends[:-1] < ends[1:]]  # a document's first byte starts anew
    first[heads] = kind[heads] > 1
    at = np.flatnonzero(first)
    n = len(at)
    doc = np.searchsorted(ends, at, "right") - 1
    begin = np.searchsorted(at, ends[:-1])  # of each document its first token
    i = np.arange(n) - begin[doc]
    stop = np.minimum(np.append(at[1:], len(data)), ends[doc + 1])
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~blank, out=solid[1:])
    size = solid[stop] - solid[at]
    text = _strings(data[~blank], size)
    coded = text.dictionary_encode()
    low, kinds, tags, lemmas = _words.of(coded.dictionary.to_pylist())
    word = coded.indices.to_numpy().astype(np.int64)
    opens = i == 0
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=breaks[1:])
    closes = (breaks[stop] > breaks[at]) | (tags[2 * word] == _TAGS.index("."))
    starts = opens.copy()
    starts[1:] |= closes[:-1]
    row = 2 * word + starts
    tag = tags[row]
    out: dict[str, pa.Array] = {}
    named = lambda names, codes: pa.array(names, pa.string()).take(pa.array(codes))
    if "ws" in columns:
        inner = blank.copy()
        for d in np.flatnonzero(ends[:-1] < ends[1:]):
            if inner[ends[d]]:  # blanks before a document's first token are nobody's
                inner[ends[d]:at[begin[d]] if begin[d] < n and doc[begin[d]] == d else ends[d + 1]] = False
        out["ws"] = _strings(data[inner], stop - at - size)
    if "head" in columns or "dep" in columns:
        place = np.arange(n)
        pos = np.array([POS[t] for t in _TAGS])
        verb = (pos == "VERB")[tag]
        first_of = np.flatnonzero(starts)
        sent = np.cumsum(starts) - 1
        root = np.minimum.reduceat(np.where(verb, place, n), first_of) if n else place
        root = np.where(root == n, first_of, root) if n else place
        past = (tag[root] == _TAGS.index("VBD"))[sent] if n else place > 0
        root = root[sent]
        last = np.full(n, -1)
        last[1:] = np.maximum.accumulate(np.where(verb, place, -1))[:-1]
        after = place > root
        out["head"] = pa.array((np.where(after, np.maximum(root, last), root) - begin[doc]).astype(np.int32))
        noun = np.isin(pos, ("NOUN", "PROPN", "PRON"))[tag]
        neg = np.array([x == "not" for x in low], bool)[word]
        dep = np.select(
            [place == root, verb, neg, noun & ~after & past & (i % 2 == 0), noun & ~after, noun, (pos == "DET")[tag], (pos == "ADJ")[tag], (pos == "PUNCT")[tag]], np.arange(9, dtype=np.int8), np.int8(9))
        out["dep"] = named(_DEPS, dep)
    if "ent_iob" in columns or "ent_type" in columns:
        name = tag == _TAGS.index("NNP")
        follows = np.zeros(n, bool)
        follows[1:] = name[:-1]
        out["ent_iob"] = pa.array(np.where(~name, 2, np.where(follows & ~opens, 1, 3)).astype(np.int32))
        out["ent_type"] = named(_TYPES, np.where(name, kinds[word], 3).astype(np.int8)) if n else pa.array([], pa.string())
    make = {
        "doc_id": lambda: ids.take(pa.array(doc)), "i": lambda: pa.array(i.astype(np.int32)), "text": lambda: text, "lower": lambda: named(low, word), "tag": lambda: named(_TAGS, tag),
        "pos": lambda: named([POS[t] for t in _TAGS], tag), "morph": lambda: named([MORPH.get(t, "") for t in _TAGS], tag), "lemma": lambda: named(lemmas, row), "sent_start": lambda: pa.array(starts.astype(np.int32))}
    return pa.RecordBatch.from_arrays([out[c] if c in out else make[c]() for c in columns], list(columns))


def apart(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and those that share one or have none, if there are any: windows see these together, joins pass over null ids."""
    key = F.col(id_col)
    shared = docs.groupBy(key.alias("_id")).count().filter("count > 1 OR _id IS NULL").select("_id")
    if shared.limit(1).count() == 0:
        return docs, None
    return docs.join(shared, key.eqNullSafe(F.col("_id")), "left_anti"), docs.join(shared, key.eqNullSafe(F.col("_id")), "left_semi")


def annotated(docs: DataFrame, *columns: str, work: Whole | None = None) -> DataFrame:
    """These columns (all, if none are named) of annotate(simple_tokens(docs)), docs being rows (doc_id, text) that share no ids; or what work makes of the columns it takes, without a way through the JVM."""
    ship(docs.sparkSession)
    columns = ("doc_id", *work.columns) if work else columns or tuple(COLUMNS)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.operators.annotate import SLICE, _annotate

        for b in batches:
            a = 0
            ends = np.frombuffer(b.column(1).buffers()[1], np.int32, len(b) + 1, 4 * b.column(1).offset)
            while a < len(b):
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
                part = b.slice(a, z - a)
                t = _annotate(part.column(0), part.column(1), columns)
                if not work:
                    yield t
                elif len(t):
                    yield work.body(t, np.flatnonzero(t.column("i").to_numpy() == 0))
                a = z

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, {work.schema}" if work else ", ".join(f"{c} {COLUMNS[c] or kind}" for c in columns))


def oracle_cte(source: str = "documents", where: str = "lang = 'en'") -> str:
    """The same table as a DuckDB CTE named tok."""
    quoted = lambda xs: ",".join(f"'{x}'" for x in xs)
    words = " ".join(f"WHEN low IN ({quoted(ws)}) THEN '{n}'" for n, ws in WORD_TAGS.items())
    ends = " ".join(f"WHEN length(low) > {len(e) + 1} AND suffix(low, '{e}') THEN '{n}'" for e, n in SUFFIX_TAGS)
    case = lambda m: "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " ELSE '' END"
    pattern = SIMPLE.replace("\\s", "[ \\t\\n\\f\\r\\v]").replace("[^[ \\t\\n\\f\\r\\v]A-Z", "[^ \\t\\n\\f\\r\\vA-Z")
    return rf"""WITH RECURSIVE p0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ps FROM {source} WHERE {where}),
    p1 AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS piece FROM p0),
    p2 AS (SELECT doc_id, i, regexp_replace(piece, '[ \t\n\f\r\v]+$', '') AS text, piece FROM p1),
    p3 AS (SELECT doc_id, i, text, substr(piece, length(text) + 1) AS ws, lower(text) AS low FROM p2),
    p4 AS (SELECT *, CASE WHEN i = 0 OR lag(text) OVER w IN ('.', '!', '?') OR contains(lag(ws) OVER w, chr(10)) THEN 1 ELSE 0 END AS sent_start FROM p3 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    p5 AS (SELECT *, CASE WHEN text IN ('.', '!', '?') THEN '.' WHEN text = ',' THEN ',' WHEN regexp_matches(text, '^[0-9]') THEN 'CD' WHEN NOT regexp_matches(text, '^[A-Za-z]') THEN 'SYM'
        {words} WHEN regexp_matches(text, '^[A-Z]') AND sent_start = 0 THEN 'NNP' {ends} ELSE 'NN' END AS tag FROM p4),
    p6 AS (SELECT *, {case(POS)} AS pos, {case(MORPH)} AS morph, substr(low, 1, length(low) - CASE tag WHEN 'NNS' THEN 1 WHEN 'VBG' THEN 3 WHEN 'VBD' THEN 2 ELSE 0 END) AS lemma,
        sum(sent_start) OVER (PARTITION BY doc_id ORDER BY i) AS sent FROM p5),
    p7 AS (SELECT *, coalesce(min(CASE WHEN pos = 'VERB' THEN i END) OVER s, min(i) OVER s) AS root, max(CASE WHEN pos = 'VERB' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_verb
        FROM p6 WINDOW s AS (PARTITION BY doc_id, sent)),
    p8 AS (SELECT *, CASE WHEN i <= root THEN root ELSE greatest(root, coalesce(last_verb, root)) END AS head, max(CASE WHEN i = root AND tag = 'VBD' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent) AS past FROM p7),
    tok AS MATERIALIZED (SELECT doc_id, i::INT AS i, text, ws, low AS lower, tag, pos, morph, lemma, head::INT AS head,
        CASE WHEN i = root THEN 'ROOT' WHEN pos = 'VERB' THEN 'conj' WHEN low = 'not' THEN 'neg' WHEN pos IN ('NOUN','PROPN','PRON') AND i <= root AND past = 1 AND i % 2 = 0 THEN 'nsubjpass' WHEN pos IN ('NOUN','PROPN','PRON') AND i <= root THEN 'nsubj'
            WHEN pos IN ('NOUN','PROPN','PRON') THEN 'dobj' WHEN pos = 'DET' THEN 'det' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'PUNCT' THEN 'punct' ELSE 'dep' END AS dep, sent_start,
        CASE WHEN tag <> 'NNP' THEN 2 WHEN lag(tag) OVER w = 'NNP' THEN 1 ELSE 3 END AS ent_iob,
        CASE WHEN tag <> 'NNP' THEN '' ELSE (['PERSON','ORG','GPE'])[length(text) % 3 + 1] END AS ent_type
        FROM p8 WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
