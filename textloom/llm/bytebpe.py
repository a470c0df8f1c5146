"""Byte-level BPE of many texts at once, with the vocabulary and merges of a tokenizers file.

Texts are cut into pre-tokens by the classes of their bytes, in numpy. Short ones
are looked up among those that were merged before; equal ones of a batch that are
new are merged once, those of similar length side by side, the pair of lowest
rank first. Texts with characters or strings outside the classes
below, and very long pre-tokens, go to the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER, _DIGIT, _OTHER, _SPACE, _BLANK, _ODD = range(6)
#: Longest pre-token, in bytes, that is known by its bytes, and longest that is merged here.
_KEYED, _LONGEST = 15, 64
#: Places of the table of merged pre-tokens, a power of two.
_PLACES = 21
#: Pre-tokens are merged side by side up to each of these lengths; shorter ones are filled up with _NONE, which no pair has.
_WIDTHS = (4, 6, 8, 11, _KEYED, 24, _LONGEST)
_NONE = np.int32(2**31 - 1)
_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    return _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _ODD if kind[0] == "Z" or c == "\x85" else _OTHER


#: Of ASCII; of U+0080 to U+024F (lead bytes C2 to C9); of U+2000 to U+203F (E2 80). All else is odd.
_ONE = np.full(256, _ODD, np.uint8)
_ONE[:128] = [_SPACE if c == " " else _BLANK if c in "\t\n\x0b\x0c\r" else _ODD if "\x1c" <= c <= "\x1f" else _class(c) for c in map(chr, range(128))]
_TWO = np.array([_class(chr(k)) for k in range(0x80, 0x280)], np.uint8)
_TWO[0x250 - 0x80:] = _ODD
_THREE = np.array([_class(chr(k)) for k in range(0x2000, 0x2040)], np.uint8)


class _Pairs:
    """Ranks of pairs of ids: a hash table with open places."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        todo, at = np.arange(len(keys)), self._place(keys)
        self.tries = 0
        while len(todo):
            self.tries += 1
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        at = self._place(keys)
        for _ in range(self.tries):
            wrong = self.keys[at] != keys
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
        self.ranks[at] = np.arange(len(keys), dtype=np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32 | b).reshape(-1)
        at = self._place(keys)
        found = self.keys.take(at, mode="clip")
        out = np.where(found == keys, self.ranks.take(at, mode="clip"), _NONE)
        on = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.tries):
            if not len(on):
                break
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[on]]
            hit = found == keys[on]
            out[on[hit]] = self.ranks[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out.reshape(a.shape)


def _mixed(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    return (w0 ^ (w0 >> _U(29))) * _U(0x9E3779B97F4A7C15) + (w1 ^ (w1 >> _U(31))) * _U(0xBF58476D1CE4E5B9)


def _distinct(w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each pair of numbers, and for each row the number of the one that equals it."""
    order = np.argsort(_mixed(w0, w1))
    a, b = w0[order], w1[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


class _Known:
    """Ids of short pre-tokens by their two numbers (the second is never 0): a hash table with open places, emptied when half of them are taken."""

    def __init__(self, bits: int = _PLACES):
        self.bits = bits
        self.empty()

    def empty(self) -> None:
        self.w0, self.w1, self.value = (np.zeros(1 << self.bits, t) for t in (_U, _U, np.int64))
        self.ids, self.used, self.n = np.empty(1 << 16, np.int32), 0, 0

    def _place(self, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        return (_mixed(w0, w1) >> _U(64 - self.bits)).view(np.int64)

    def find(self, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16 times where each row's ids begin plus how many they are, and the rows that are not known."""
        at = self._place(w0, w1)
        on = np.flatnonzero((self.w1.take(at, mode="clip") != w1) | (self.w0.take(at, mode="clip") != w0))
        new = []
        while len(on):
            here = at[on]
            there = self.w1[here]
            free = there == 0
            new.append(on[free])
            more = ~free & ((there != w1[on]) | (self.w0[here] != w0[on]))
            on = on[more]
            at[on] = (here[more] + 1) & ((1 << self.bits) - 1)
        return self.value.take(at, mode="clip"), np.concatenate(new) if new else on

    def add(self, w0: np.ndarray, w1: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, counts[k] of the k-th each, of these rows and of others behind them that are not to be kept -> all ids, and where each one's begin."""
        need, k = self.used + len(ids), len(w0)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(need, np.int32)])
        table, begin = self.ids, self.used + np.cumsum(counts) - counts
        table[self.used:need] = ids
        self.n += k
        if self.n > 1 << self.bits - 1 or need > 16 << self.bits - 1:
            self.empty()
            return table, begin
        self.used += int(counts[:k].sum())
        value, todo, at = begin[:k] << 4 | counts[:k], np.arange(k), self._place(w0, w1)
        while len(todo):
            free = todo[self.w1[at[todo]] == 0]
            self.value[at[free]] = free
            free = free[self.value[at[free]] == free]
            for column, new in ((self.w0, w0), (self.w1, w1), (self.value, value)):
                column[at[free]] = new[free]
            todo = todo[(self.w1[at[todo]] != w1[todo]) | (self.w0[at[todo]] != w0[todo])]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return table, begin


class ByteBPE:
    """ids(texts) as the tokenizers library gives them for the file at path (byte-level, without a space added in front)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        made = json.loads(self.lib.to_str())
        if made["pre_tokenizer"].get("add_prefix_space") or made["normalizer"] or made["model"].get("ignore_merges"):
            raise ValueError("only byte-level files without normalizer and prefix space")
        vocab = made["model"]["vocab"]
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        # Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in shown]
        self.byte_id = np.array([vocab[chr(b) if b in shown else chr(256 + rest.index(b))] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        self.pairs = _Pairs([(vocab[a], vocab[b]) for a, b in merges])
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        # Of each two bytes, the first times 256.
        self.byte_rank = self.pairs.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        self.known = _Known()

    def _merge(self, s: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids, all of one length, and the ranks of their pairs -> the same rows merged, and their lengths."""
        out, size, on = s.copy(), np.full(len(s), s.shape[1]), np.arange(len(s))
        while len(on):
            k = ranks.argmin(1)
            best = ranks[np.arange(len(on)), k]
            go = best < _NONE
            if not go.all():
                done = on[~go]
                out[done, : s.shape[1]] = s[~go]
                size[done] = s.shape[1]
                on, s, ranks, k, best = on[go], s[go], ranks[go], k[go], best[go]
                if not len(on):
                    break
            row, width = np.arange(len(on)), s.shape[1]
            s[row, k] = self.merged[best]
            stay = np.ones(s.shape, bool)
            stay[row, k + 1] = False
            s = s[stay].reshape(len(on), width - 1)
            if width == 2:
                out[on, :1], size[on] = s, 1
                break
            stay = np.ones(ranks.shape, bool)
            stay[row, k] = False
            ranks = ranks[stay].reshape(len(on), width - 2)
            left, right = np.flatnonzero(k > 0), np.flatnonzero(k < width - 2)
            ranks[left, k[left] - 1] = self.pairs.rank(s[left, k[left] - 1], s[left, k[left]])
            ranks[right, k[right]] = self.pairs.rank(s[right, k[right]], s[right, k[right] + 1])
        return out, size

    def _classes(self, data: np.ndarray) -> np.ndarray:
        kind = _ONE.take(data)
        high = np.flatnonzero(data >= 0xC2)
        if len(high):
            padded = np.append(data, np.zeros(2, np.uint8))
            lead, second = data[high], padded[high + 1]
            two = (lead <= 0xC9) & (second >= 0x80)
            at = high[two]
            c = _TWO[(lead[two].astype(np.int64) - 0xC2) * 64 + (second[two] & 63)]
            kind[at], kind[at + 1] = c, c
            three = (lead == 0xE2) & (second == 0x80)
            at = high[three]
            c = _THREE[padded[at + 2] & 63]
            for k in range(3):
                kind[at + k] = c
        return kind

    def _starts(self, data: np.ndarray, kind: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Places where a pre-token starts: a run of letters, digits or others, with one space before it; contractions; blanks up to the last of a run."""
        blank = (kind == _SPACE) | (kind == _BLANK)
        start = np.ones(len(data), bool)
        np.logical_and(kind[1:] != kind[:-1], kind[:-1] != _SPACE, out=start[1:])
        follows = np.zeros(len(data), bool)
        follows[:-1] = ~blank[1:]
        first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
        follows[last] = False
        at = np.flatnonzero(blank)
        start[at] = follows[at] | ~blank[at - 1]
        start[first] = True
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            padded = np.append(data, np.zeros(2, np.uint8))
            a, b = padded[quote + 1], padded[quote + 2]
            end = off[np.searchsorted(off, quote, "right")]
            one = np.isin(a, list(b"stmd")) & (quote + 1 < end)
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (quote + 2 < end)
            for on, size in ((quote[one], 2), (quote[two], 3)):
                for k in range(1, size):
                    start[on + k] = False
                behind = on + size
                start[behind[behind < len(data)]] = True
        return np.flatnonzero(start)

    def _numbers(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short pre-tokens as two numbers each: their bytes, and in the last one their length."""
        words = np.ndarray((len(data) + 8,), "<u8", np.append(data, np.zeros(24, np.uint8)), strides=(1,))
        w0, w1 = words[at] & _MASK.take(np.minimum(size, 8)), size.astype(_U) << _U(56)
        more = np.flatnonzero(size > 8)
        w1[more] |= words[at[more] + 8] & _MASK.take(size[more] - 8)
        return w0, w1

    def _spell(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all their ids in order."""
        counts, parts = np.zeros(len(at), np.int64), []
        for low, n in zip((0, *_WIDTHS), _WIDTHS):
            rows = np.flatnonzero((size > low) & (size <= n))
            if len(rows):
                place, m = np.arange(n), size[rows]
                found = data.take(at[rows, None] + place, mode="clip")
                ranks = self.byte_rank.take(found[:, :-1].astype(np.int32) << 8 | found[:, 1:])
                inside = place < m[:, None]
                made, left = self._merge(np.where(inside, self.byte_id.take(found), _NONE), np.where(inside[:, 1:], ranks, _NONE))
                counts[rows] = left - (n - m)
                parts.append((rows, made[place < counts[rows, None]]))
        rows = np.flatnonzero(size > _LONGEST)
        if len(rows):
            some = self.lib.encode_batch_fast([data[a:a + n].tobytes().decode() for a, n in zip(at[rows].tolist(), size[rows].tolist())], add_special_tokens=False)
            each = [np.array(e.ids, np.int32) for e in some]
            counts[rows] = [len(e) for e in each]
            parts.append((rows, np.concatenate(each)))
        begin, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        for rows, ids in parts:
            out[_ranges(begin[rows], counts[rows])] = ids
        return counts, out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (int32) of each text; null texts have none."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[off[0]:off[-1]]
        off = off - off[0]
        if not len(data):
            return [np.zeros(0, np.int32)] * len(texts)
        kind = self._classes(data)
        odd = set((np.searchsorted(off, np.flatnonzero(kind == _ODD), "right") - 1).tolist())
        whole = data.tobytes()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(off, at, "right")) - 1)
                at = whole.find(s, at + 1)
        at = self._starts(data, kind, off)
        size = np.diff(np.append(at, len(data)))
        text = np.searchsorted(off, at, "right") - 1
        if odd:
            keep = ~np.isin(text, list(odd))
            at, size, text = at[keep], size[keep], text[keep]
        # The ids of each pre-token that is not known, then every pre-token's ids in order.
        short, long = np.flatnonzero(size <= _KEYED), np.flatnonzero(size > _KEYED)
        w0, w1 = self._numbers(data, at[short], size[short])
        value, new = self.known.find(w0, w1)
        chosen, number = _distinct(w0[new], w1[new])
        chosen, k = new[chosen], len(chosen)
        spelled = np.concatenate([short[chosen], long])
        counts, some = self._spell(data, at[spelled], size[spelled])
        table, first = self.known.add(w0[chosen], w1[chosen], counts, some)
        value[new] = (first[:k] << 4 | counts[:k])[number]
        begin, c = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[short], c[short] = value >> 4, value & 15
        begin[long], c[long] = first[k:], counts[k:]
        flat = table.take(_ranges(begin, c), mode="clip")
        per_text = np.bincount(text, weights=c, minlength=len(texts)).astype(np.int64)
        out = np.split(flat, np.cumsum(per_text)[:-1])
        if odd:
            which = sorted(odd)
            for k, e in zip(which, self.lib.encode_batch_fast([whole[off[k]:off[k + 1]].decode() for k in which], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.int32)
        return out
