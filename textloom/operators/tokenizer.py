"""Rule-based tokenization: texts to one row a token, with exact character offsets.

White space splits a text into chunks, and a chunk's tokens depend on nothing
outside it. So a worker splits each distinct chunk once and remembers it; texts
stay where they are, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..session import ship
from . import rules_en as en

CHUNK = r"[^ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+"
KEPT_CHUNKS = 500_000
_chunks = re.compile(r"([^ \t\n\r\x0b\x0c]+)|[ \t\n\r\x0b\x0c]+").finditer


def _prefix(s: str) -> int:
    """Length of the longest prefix to strip."""
    n = next((k for k in (3, 2, 1) if s[:k] in en.PREFIX_LITERALS), 0)
    return max([n, *(m.end() for p in en.PREFIX_PATTERNS if (m := p.match(s)))])


def _suffix(s: str) -> int:
    """Length of the suffix that starts first."""
    return len(s) - min([len(s), *(m.start() for p in en.SUFFIX_PATTERNS if (m := p.search(s)))])


def _infixes(s: str) -> list[str]:
    """A chunk's middle cut at its infixes; of overlapping ones the first counts."""
    found = sorted({m.span() for p in en.INFIX_PATTERNS for m in p.finditer(s)})
    out, at = [], 0
    for a, b in found:
        if a >= at and b > a:
            out += [s[at:a], s[a:b]]
            at = b
    return [x for x in [*out, s[at:]] if x]


def split_chunk(chunk: str) -> list[tuple[str, str]]:
    """(text, norm) of a chunk's tokens."""
    special = en.special_cases()
    before: list[str] = []
    after: list[str] = []
    s, size = chunk, -1
    while s and len(s) != size and s not in special:
        size = len(s)
        if n := _prefix(s):
            before.append(s[:n])
            s = s[n:]
        if s and (n := _suffix(s)):
            after.append(s[-n:])
            s = s[:-n]
    plain = lambda xs: [(x, x.lower()) for x in xs]
    named = lambda xs: [(t, n or t.lower()) for t, n in xs]
    if not s:
        middle = []
    elif s in special:
        middle = named(special[s])
    elif en.URL.fullmatch(s):
        middle = plain([s])
    else:
        middle = plain(_infixes(s))
    return _rejoin(plain(before) + middle + plain(after[::-1]), special, named)


def _rejoin(tokens: list, special: dict, named) -> list[tuple[str, str]]:
    """Neighbours that spell a special case together become its pieces: three before two; if nothing changes, on to the next."""
    out, k = [], 0
    while k < len(tokens):
        for width in (3, 2):
            part = tokens[k:k + width]
            found = special.get("".join(t for t, _ in part)) if len(part) == width else None
            if found:
                if [t for t, _ in found] == [t for t, _ in part]:
                    found = None
                    break
                out += named(found)
                k += width
                break
        else:
            found = None
        if not found:
            out.append(tokens[k])
            k += 1
    return out


_known: dict[str, tuple] = {}


def _pieces(chunk: str) -> tuple:
    """Texts, norms and offsets of a chunk's tokens, remembered."""
    got = _known.get(chunk)
    if got is None:
        if len(_known) >= KEPT_CHUNKS:
            _known.clear()
        tokens = split_chunk(chunk)
        at, offsets = 0, []
        for t, _ in tokens:
            offsets.append(at)
            at += len(t)
        got = _known[chunk] = ([t for t, _ in tokens], [n for _, n in tokens], offsets)
    return got


def tokens_of(text: str) -> tuple[list[str], list[str], list[int], list[str]]:
    """Texts, norms, character offsets and the blank after each, of one text's tokens. Text and blanks together are the text."""
    texts: list[str] = []
    norms: list[str] = []
    at: list[int] = []
    ws: list[str] = []
    for m in _chunks(text):
        start = m.start()
        if m[1] is not None:
            t, n, o = _pieces(m[0])
            texts += t
            norms += n
            at += [start + x for x in o]
            ws += [""] * len(t)
            continue
        blank = m[0]
        if start and blank[0] == " ":
            ws[-1] = " "
            blank, start = blank[1:], start + 1
        if blank:
            texts.append(blank)
            norms.append(blank)
            at.append(start)
            ws.append("")
    return texts, norms, at, ws


SCHEMA = "doc_id {id}, i int, text string, ws string, idx int, norm string"


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 50_000) -> DataFrame:
    """(doc_id, i, text, ws, idx, norm), one row a token. Null and empty texts have none."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.operators.tokenizer import tokens_of

        kind = None
        out: tuple = ([], [], [], [], [], [])

        def made() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()))], ["doc_id", "i", "text", "ws", "idx", "norm"])
            for c in out:
                c.clear()
            return b

        for b in batches:
            kind = b.column(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts, norms, at, ws = tokens_of(t or "")
                out[0].extend([key] * len(texts))
                out[1].extend(range(len(texts)))
                for c, x in zip(out[2:], (texts, ws, at, norms)):
                    c.extend(x)
                if len(out[0]) >= rows:
                    yield made()
        if out[0]:
            yield made()

    return docs.mapInArrow(run, SCHEMA.format(id=dict(docs.dtypes)["doc_id"]))


def with_lexemes(tokens: DataFrame) -> DataFrame:
    """Adds the context-free columns and the initial annotations of a token."""
    return tokens.select("*", *lexical.lexeme(F.col("text")), F.lit(-1).alias("sent_start"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k, chunk, is_space): runs of white space and of anything else, in SQL alone."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CHUNK), F.lit(0))).alias("k", "chunk")).withColumn("is_space", F.col("chunk").rlike(r"\A[ \t\n\r\x0B\f]"))


def joined(i: Column | str = "i") -> Column:
    """Text of a group of tokens in order, blanks between them as they were."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, "text", "ws"))), lambda x: F.concat(x["text"], x["ws"])), "")


def round_trip(tokens: DataFrame) -> DataFrame:
    """(doc_id, text) put together again."""
    return tokens.groupBy("doc_id").agg(joined().alias("text"))


def span_text(tokens: DataFrame, spans: DataFrame, *keep: str) -> DataFrame:
    """spans (doc_id, start, end, keep columns) with their text; the blank after the last token is left out."""
    t = tokens.select("doc_id", "i", "text", "ws").alias("t")
    s = spans.alias("s")
    inside = s.join(t, (F.col("s.doc_id") == F.col("t.doc_id")) & (F.col("t.i") >= F.col("s.start")) & (F.col("t.i") < F.col("s.end")))
    piece = F.struct(F.col("t.i"), F.col("t.text"), F.when(F.col("t.i") == F.col("s.end") - 1, "").otherwise(F.col("t.ws")).alias("ws"))
    return inside.groupBy("s.doc_id", "s.start", "s.end", *[f"s.{k}" for k in keep]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: F.concat(x["text"], x["ws"])), "").alias("text"))


def span_at(array: Column, start: int, end: int, k: int) -> Column:
    """k-th element of [start, end) of an array, from the end where k is negative; null outside."""
    return F.try_element_at(F.slice(array, start + 1, end - start), F.lit(k + 1 if k >= 0 else k))
