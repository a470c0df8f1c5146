"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base: e-mail addresses, IPv4 addresses, card and phone numbers as written down
in ``base_spans``. The field looks at the windows around digits, ``@``,
``[at]`` and the words ``at`` and ``dot``; its segments are runs of pieces (letters, digits, single characters)
of bounded length, its features those of whole segments (digit counts, check
digit, shape, separators, neighbours), and dynamic programming over the pieces
chooses boundaries and kinds together. It finds what the patterns miss: written
out or defanged addresses, phone numbers without a plus, odd separators. Spans
that touch a base span are dropped; base spans always stay.

It is trained here, on ``TRAINING`` sentences made from templates (a bounded
sample; the bound is that parameter), by gradient steps on the log-likelihood.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KINDS = ("email", "ip", "card", "phone")
TRAINING, EPOCHS, MAX_PIECES = 600, 4, 24
#: Chunks on both sides of a trigger: a segment has blanks between its chunks, so at most this many, and the one behind it is its neighbour.
CONTEXT = (MAX_PIECES + 1) // 2

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
# A run of digits starts after no digit and is taken whole: the same matches as without these marks, in linear time.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[^0-9]").sub


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL)) if at > end else at
        if start < at and (m := _domain(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)  # no local part reaches over an @
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind: leftmost, non-overlapping matches of each kind; those that fail its check are dropped."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _ip(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _card(text):
        if m.end() - m.start() >= 14:
            d = _digits("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _phone(text) if 10 <= len(_digits("", m[0])) <= 15]
    return sorted(out)


# --- the field -----------------------------------------------------------------------------------------------------------

_piece = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S).finditer
_chunk = re.compile(r"\S+").finditer
_trigger = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I).search
#: at or dot as a word between two others, as in an address spelled out.
_spelled = re.compile(r"(?<=[\w.+-])\s+(at|dot)(?=\s+\w)", re.I).finditer
_mail_shape = re.compile(r"[\w.+-]+\s?[(\[]?(?:@|\bat\b)[)\]]?\s?[\w-]+(?:(?:\.|\s?[(\[]\.[)\]]\s?|\s?[(\[]?\bdot\b[)\]]?\s?)[\w-]+)+", re.I).fullmatch
_DIGITS = frozenset("0123456789")
_letters_at = re.compile("at", re.I).search
_quad_shape = re.compile(r"\d{1,3}(?:\s?[(\[]?(?:\.|\bdot\b)[)\]]?\s?\d{1,3}){3}", re.I).fullmatch
_phone_shape = re.compile(r"(?:00\d{1,2}[ .-])?\(?\d{3}\)?[ .-]{1,2}\d{3}[ .-]\d{4}").fullmatch
_card_shape = re.compile(r"\d{4}(?:[ ._/-]{1,2}\d{4}){2}[ ._/-]{1,2}\d{2,7}").fullmatch


def windows(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) around the chunks that may hold something, with CONTEXT chunks on both sides; overlapping ones are one."""
    spelled = {m.start(1) for m in _spelled(text)}
    if not spelled and not _trigger(text):
        return
    before: list[tuple[int, int]] = []
    start = end = None
    left = 0
    for m in _chunk(text):
        if m.start() in spelled or _trigger(m[0]):
            if start is None:
                start = before[0][0] if before else m.start()
            end, left = m.end(), CONTEXT
        elif start is not None:
            if left:
                end, left = m.end(), left - 1
            else:
                yield start, end
                start = None
        before = (before + [m.span()])[-CONTEXT:]
    if start is not None:
        yield start, end


def _bucket(n: int) -> str:
    return next((str(b) for b in (0, 1, 3, 6, 9, 10, 11, 13, 16, 19) if n <= b), "more")


def _char(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in "@.-+()[]" else "o"


def candidates(text: str) -> tuple[list[int], Iterator[tuple[int, int, tuple]]]:
    """Piece bounds of a window; candidate (first, last + 1) pieces by first, then last, each with what its features depend on."""
    bounds = [m.start() for m in _piece(text)] + [len(text)]
    n = len(bounds) - 1
    kind = [_char(text[b]) for b in bounds[:-1]]

    def run() -> Iterator[tuple[int, int, tuple]]:
        at = -1
        for i in range(n):
            yield i, i + 1, (kind[i],)
            if kind[i] not in "da+([":
                continue
            if at < bounds[i] and (m := _letters_at(text, bounds[i])):
                at = m.start()
            elif at < bounds[i]:
                at = len(text)
            left = _char(text[bounds[i] - 1]) if bounds[i] else "^"
            digits = numbers = letters = blanks = odd = round_ = square = 0
            marks, mail, dot = "", False, False
            for j in range(i, min(n, i + MAX_PIECES)):
                c = kind[j]
                if c == "d":
                    size = bounds[j + 1] - bounds[j]
                    numbers += size
                    digits += size if text[bounds[j]] in _DIGITS else 0
                elif c == "a":
                    letters += 1
                    low = text[bounds[j]:bounds[j + 1]].lower() if bounds[j + 1] - bounds[j] in (2, 3) else ""
                    mail, dot = mail or low == "at", dot or low == "dot"
                elif c == "s":
                    blanks += 1
                elif c == "o":
                    odd += 1
                else:
                    marks += "" if c in marks else c
                    round_ += (c == "(") - (c == ")")
                    square += (c == "[") - (c == "]")
                if c not in "da" or digits < 4 and "@" not in marks and at + 2 > bounds[j + 1]:
                    continue
                s = text[bounds[i]:bounds[j + 1]]
                # A shape is tried where what it needs is there.
                shapes = ""
                if (mail or "@" in marks) and (dot or "." in marks) and _mail_shape(s):
                    shapes += "m"
                if 4 <= numbers <= 12 and (dot or "." in marks) and _quad_shape(s):
                    shapes += "q" if all(int(x) <= 255 for x in re.findall(r"\d+", s)) else "Q"
                if 10 <= numbers <= 14 and _phone_shape(s):
                    shapes += "p"
                if 14 <= numbers <= 19 and _card_shape(s):
                    shapes += "c"
                check = luhn(_digits("", s)) if 14 <= digits <= 19 else None
                right = _char(text[bounds[j + 1]]) if bounds[j + 1] < len(text) else "$"
                yield i, j + 1, (min(20, digits), kind[i], c, left, right, min(3, letters), min(4, blanks), min(2, odd), round_ == square == 0, marks, shapes, check)

    return bounds, run()


def features(key: tuple) -> list[str]:
    if len(key) == 1:
        return ["out", "out:" + key[0]]
    digits, first, last, left, right, letters, blanks, odd, paired, marks, shapes, check = key
    f = ["bias", "digits:" + _bucket(digits), "first:" + first, "last:" + last, "left:" + left, "right:" + right, f"letters:{letters}", f"spaces:{blanks}", f"odd:{odd}", f"paired:{paired}"]
    f += ["has:" + c for c in "@.-+()[]" if c in marks]
    f += ["shape:" + name for name in ("mail", "quad", "phone", "card") if name[0] in shapes.lower()]
    if "shape:quad" in f:
        f.append(f"quad:{'q' in shapes}")
    return f if check is None else [*f, f"luhn:{check}"]


def segments(text: str) -> tuple[list[int], list[tuple[int, int]], list[list[str]]]:
    """Piece bounds of a window; candidate (first, last + 1) pieces; features of each. A single piece may be outside all spans."""
    bounds, each = candidates(text)
    each = list(each)
    return bounds, [(i, j) for i, j, _ in each], [features(key) for *_, key in each]


class Field:
    """Weights by feature and label (0 outside, then KINDS)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights
        self._best: dict[tuple, tuple[int, float]] = {}

    def rows(self, feats: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        known = [[k for x in f if (k := self.names.get(x)) is not None] or [len(self.names)] for f in feats]
        return np.array([k for f in known for k in f], np.int64), np.cumsum([0] + [len(f) for f in known[:-1]])

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        """Score of each segment with each label; outside only single pieces, inside only real segments."""
        flat, at = self.rows(feats)
        s = np.add.reduceat(self.weights[flat], at)
        out = np.array([f[0] == "out" for f in feats])
        s[out, 1:] = -1e9
        s[~out, 0] = -1e9
        return s

    def best(self, key: tuple) -> tuple[int, float]:
        """Label and score of a segment; remembered, as few keys make up most segments."""
        if key not in self._best:
            if len(self._best) >= 200_000:
                self._best.clear()
            s = self.scores([features(key)])[0]
            self._best[key] = int(s.argmax()), float(s.max())
        return self._best[key]

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the best segmentation of a window of any length: segments come by their first piece, whose best is then settled."""
        bounds, each = candidates(text)
        n = len(bounds) - 1
        score, back = [0.0] + [-1e18] * n, [(0, 0)] * (n + 1)
        for i, j, key in each:
            label, top = self.best(key)
            if score[i] + top > score[j]:
                score[j], back[j] = score[i] + top, (i, label)
        found, j = [], n
        while j:
            i, label = back[j]
            if label:
                found.append((bounds[i], bounds[j], label - 1))
            j = i
        return found[::-1]


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows made from templates with their spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdfghlmnprstvw") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14, 15)))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def made(kind: int) -> str:
        if kind == 0:
            at = r.choice(("@", "@", " at ", "[at]", " [at] ", "(at)", " (at) "))
            dot = "." if at == "@" else r.choice((" dot ", "[dot]", "(dot)", ".")) if "[" in at or "(" in at else " dot "
            return word() + r.choice((".", "_", "")) + r.choice((word(), num(2))) + at + word() + dot + r.choice(("com", "org", "net", "co"))
        if kind == 1:
            return r.choice((".", ".", "[.]", "(.)", " dot ")).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            c, sep = card(), r.choice(("", "-", " ", ".", "/", "  "))
            return sep.join(c[k:k + 4] for k in range(0, len(c), 4))
        a, b, c, sep = num(3), num(3), num(4), r.choice("-. ")
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"001 {a} {b} {c}"))

    def other() -> str:
        bad = num(16)
        return r.choice((
            num(4), num(2) + ":" + num(2), f"${num(2)}.{num(2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"20{num(2)}-0{num(1)}-1{num(1)}", "Version 2.0",
            f'"{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', num(r.choice((5, 6, 7, 8, 12))), word() + num(2), "@" + word(), f"{num(3)}.{num(3)}.999.{num(3)}9", bad if not luhn(bad) else bad + "#", f"{num(3)} {word()} {num(4)}", f"look at {word()}{num(1)}", f"{num(4)} {num(4)}", f"v{num(1)}.{num(1)}.{num(1)}.{num(1)}b"))

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 2)):
            text += " ".join(word() for _ in range(r.randint(0, 3))) + r.choice((" ", " ", ": ", ", ", " (", '"'))
            if r.random() < 0.55:
                k = r.randrange(4)
                m = made(k)
                spans.append((len(text), len(text) + len(m), k))
            else:
                m = other()
            text += m + r.choice((" ", ". ", ", ", ") ", "### ", " | "))
        out.append((text + word(), spans))
    return out


@functools.cache
def field(n: int = TRAINING, epochs: int = EPOCHS, seed: int = 7) -> Field:
    """The trained field; the same for the same arguments."""
    data = []
    names: dict[str, int] = {}
    for text, spans in examples(n, seed):
        bounds, segs, feats = segments(text)
        gold = {(a, b): k + 1 for a, b, k in spans}
        inside = [any(a <= bounds[i] and bounds[j] <= b for a, b in gold) for i, j in segs]
        want = np.zeros((len(segs), 1 + len(KINDS)))
        for k, ((i, j), f) in enumerate(zip(segs, feats)):
            y = gold.get((bounds[i], bounds[j])) if f[0] != "out" else None
            if y:
                want[k, y] = 1
            elif f[0] == "out" and not inside[k]:
                want[k, 0] = 1
            for x in f:
                names.setdefault(x, len(names))
        if want[:, 1:].sum() == len(gold):
            data.append((len(bounds) - 1, segs, feats, want))
    model = Field(names, np.zeros((len(names) + 1, 1 + len(KINDS))))
    data = [(m, np.array(s), f, w, *model.rows(f)) for m, s, f, w in data]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in rng.permutation(len(data)):
            m, segs, feats, want, flat, at = data[k]
            s = model.scores(feats)
            cell = np.logaddexp.reduce(s, axis=1)
            ahead, behind = np.full(m + 1, -1e18), np.full(m + 1, -1e18)
            ahead[0] = behind[m] = 0.0
            for q in np.argsort(segs[:, 1], kind="stable"):
                i, j = segs[q]
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + cell[q])
            for q in np.argsort(-segs[:, 0], kind="stable"):
                i, j = segs[q]
                behind[i] = np.logaddexp(behind[i], behind[j] + cell[q])
            expected = np.exp(ahead[segs[:, 0], None] + s + behind[segs[:, 1], None] - ahead[m])
            step = np.repeat(want - expected, np.diff(np.append(at, len(flat))), axis=0)
            np.add.at(model.weights, flat, (0.3 / (1 + epoch)) * step)
    model.weights[-1] = 0
    return model


def spans_of(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans in their order."""
    base = base_spans(text)
    more = []
    for a, b in windows(text):
        more += [(a + i, a + j, k) for i, j, k in model.decode(text[a:b])]
    if base and more:
        taken = np.array(sorted(base))
        more = [x for x in more if not np.any((taken[:, 0] < x[1]) & (taken[:, 1] > x[0]))]
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: int = TRAINING) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (long, of the base spans), base, spans (kind:start:end, comma-joined, code points).

    Null texts count as empty and hold nothing; repeated rows, null ids and further columns change nothing; an empty table gives an
    empty result.
    """
    ship(df.sparkSession)
    model = field(training)
    names, weights = model.names, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = Field(names, weights)
        for b in batches:
            rows = [spans_of(t.as_py() or "", field_) for t in b.column(1)]
            n = [pa.array([sum(x[2] == k for x in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array([written(x) for x, _ in rows], pa.string()), pa.array([written(x) for _, x in rows], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """The result with the base spans as their hash."""
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")
