"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are strings of the vocabulary. Which of those the
library encodes as one token, whole, is proved once, on the driver, before any
text is read, by encoding each; a pre-token among them counts one. Only the rest are merged by
the library. Space-separated pieces are independent (the tokenizer drops white
space and no pre-token crosses it), so a piece's count is kept for the next time,
in a table of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KEPT_PIECES = 1_000_000
#: What splits words in word_bpe_49k.json, after its normalizer (fixed values).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

blank = regex.compile(r"\s").search


class Counter:
    """Token counts of texts for a JSON tokenizer with word ends; one for each Python worker. whole: what was proved before, if it was."""

    def __init__(self, path: str, whole: frozenset[str] | None = None, pretoken: str = PRETOKEN, word_end: str = "</w>"):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.split = regex.compile(pretoken).findall
        assert all(t.content.startswith("<|") for t in self.lib.get_added_tokens_decoder().values())
        self.whole = self._proved(word_end) if whole is None else whole
        self.word_end = word_end
        self.known: dict[str, int] = {"": 0}
        self.words = dict.fromkeys(self.whole, 1)

    def _proved(self, word_end: str) -> frozenset[str]:
        """Vocabulary strings that, as a text, are one pre-token, unchanged by the normalizer, and one token."""
        from tokenizers.decoders import ByteLevel

        back = ByteLevel()
        words = sorted({back.decode([v[: -len(word_end)]]) for v in self.lib.get_vocab() if v.endswith(word_end)})
        words = [w for w in words if w and self.split(w) == [w] and self.lib.normalizer.normalize_str(w) == w]
        return frozenset(w for w, e in zip(words, self.lib.encode_batch(words, add_special_tokens=False)) if len(e.ids) == 1)

    def _count_new(self, pieces: list[str]) -> None:
        """Counts of pieces not met before. The library merges the words left over in one text; a token that ends a word says so."""
        plain = [p for p in pieces if "<|" not in p and not blank(p)]
        ascii_, other = [p for p in plain if p.isascii()], [p for p in plain if not p.isascii()]
        low = " ".join(ascii_).lower().split(" ") if ascii_ else []
        changed = self.lib.normalizer.normalize_str(" ".join(other)).split(" ") if other else []
        parts = dict(zip(ascii_, map(self.split, low)))
        if len(changed) == len(other):
            parts.update(zip(other, map(self.split, changed)))
        words = self.words
        self._merge([w for w in set(itertools.chain.from_iterable(parts.values())) if w not in words])
        known, get = self.known, words.__getitem__
        for p, pre in parts.items():
            try:
                known[p] = words[pre[0]] if len(pre) == 1 else sum(map(get, pre))
            except KeyError:
                pass
        odd = [p for p in pieces if p not in known]
        for p, e in zip(odd, self.lib.encode_batch_fast(odd, add_special_tokens=False)):
            known[p] = len(e.ids)

    def _merge(self, todo: list[str]) -> None:
        """Tokens of pre-tokens that are not whole tokens, merged by the library as one text."""
        for some in (todo[k:k + 20_000] for k in range(0, len(todo), 20_000)):
            line = " ".join(some)
            if not line.isascii() and self.lib.normalizer.normalize_str(line) != line:
                continue
            counts, last = [], -1
            tokens = self.lib.encode_batch_fast([line], add_special_tokens=False)[0].tokens
            for k in [k for k, t in enumerate(tokens) if t.endswith(self.word_end)]:
                counts.append(k - last)
                last = k
            if len(counts) == len(some):
                self.words.update(zip(some, counts))

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [t.split(" ") for t in texts]
        new = set().union(*pieces).difference(self.known) if pieces else set()
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known, self.words = {"": 0}, dict.fromkeys(self.whole, 1)
            new = set().union(*pieces) - {""}
        if new:
            self._count_new(sorted(new))
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in pieces]


_counters: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about most characters."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The tokenizer at path is used as the library has it by default, without special tokens added; special strings inside a text
    are single tokens. Null texts count as empty; repeated rows, null ids and further columns change nothing; an empty table gives
    an empty result.
    """
    ship(df.sparkSession)
    # Proved once, on the driver: at most the vocabulary's strings, whatever the input.
    proved = df.sparkSession.sparkContext.broadcast(counter(path).whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.llm.tokens import counter, slices

        count = counter(path, proved.value).counts
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [x for i, j in slices([len(t) for t in texts], 2_000_000) for x in count(texts[i:j])]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
