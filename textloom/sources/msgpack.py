"""Reading (and, for tests, writing) MessagePack, with numpy arrays as maps or extensions."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

_FIXED = {0xC0: None, 0xC2: False, 0xC3: True}
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"), 0xC7: ("ext", ">B"), 0xC8: ("ext", ">H"), 0xC9: ("ext", ">I")}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("MessagePack data end too early")
        self.at += n
        return bytes(self.data[self.at - n:self.at])

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def value(self) -> Any:
        c = self.take(1)[0]
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c in _FIXED:
            return _FIXED[c]
        if c in _NUMBERS:
            return self.number(_NUMBERS[c])
        if c in _SIZED:
            kind, form = _SIZED[c]
            n = self.number(form)
        elif 0xD4 <= c <= 0xD8:
            kind, n = "ext", 1 << (c - 0xD4)
        elif c < 0x90:
            kind, n = "map", c & 15
        elif c < 0xA0:
            kind, n = "list", c & 15
        elif c < 0xC0:
            kind, n = "str", c & 31
        else:
            raise ValueError(f"unknown MessagePack byte {c:#x}")
        if kind == "bin":
            return self.take(n)
        if kind == "str":
            return self.take(n).decode()
        if kind == "list":
            return [self.value() for _ in range(n)]
        if kind == "ext":
            self.take(1)
            body = self.take(n)
            try:
                return unpack(body)
            except (ValueError, UnicodeDecodeError):
                return body
        return {self.value(): self.value() for _ in range(n)}


def unpack(data: bytes) -> Any:
    r = _Reader(data)
    out = r.value()
    if r.at != len(r.data):
        raise ValueError("bytes are left after the MessagePack value")
    return out


def pack(x: Any) -> bytes:
    """Enough of the format to write fixtures."""
    if isinstance(x, np.ndarray):
        return pack({"nd": True, "type": x.dtype.str, "kind": "", "shape": list(x.shape), "data": x.tobytes()})
    if x is None or isinstance(x, bool):
        return bytes([0xC0 if x is None else 0xC3 if x else 0xC2])
    if isinstance(x, int):
        return struct.pack(">BQ", 0xCF, x) if x >= 0 else struct.pack(">Bq", 0xD3, x)
    if isinstance(x, float):
        return struct.pack(">Bd", 0xCB, x)
    if isinstance(x, str):
        return struct.pack(">BI", 0xDB, len(x.encode())) + x.encode()
    if isinstance(x, bytes):
        return struct.pack(">BI", 0xC6, len(x)) + x
    if isinstance(x, (list, tuple)):
        return struct.pack(">BI", 0xDD, len(x)) + b"".join(map(pack, x))
    return struct.pack(">BI", 0xDF, len(x)) + b"".join(pack(k) + pack(v) for k, v in x.items())


def array(m: Any) -> np.ndarray:
    """The float32 array of a decoded map; any other element type is an error."""
    if not isinstance(m, dict):
        raise ValueError("not an array")
    get = lambda k: m.get(k, m.get(k.encode()))
    text = lambda v: v.decode() if isinstance(v, bytes) else v
    if get("shape") is None or get("data") is None:
        raise ValueError("an array needs shape and data")
    kind = next((text(get(k)) for k in ("type", "dtype", "kind") if get(k)), "")
    if kind not in ("float32", "<f4", "f4", "=f4"):
        raise ValueError(f"float32 is needed, not {kind!r}")
    data = get("data")
    return np.frombuffer(data.encode("latin-1") if isinstance(data, str) else data, "<f4").reshape(get("shape")).copy()
