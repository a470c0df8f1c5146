"""Sectioned configuration files with references between values."""

from __future__ import annotations

import json
import re
from typing import Any

PASSES = 16
_ref = re.compile(r"\$\{([^}]*)\}")


def value(raw: str) -> Any:
    """A JSON string or list, a boolean, null, a number; anything else is text as it stands."""
    if raw[:1] == '"' and raw[-1:] == '"' or raw[:1] == "[" and raw[-1:] == "]":
        return json.loads(raw)
    low = raw.lower()
    if low in ("true", "false", "null", "none"):
        return {"true": True, "false": False}.get(low)
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


class Config:
    """Dotted path to value."""

    def __init__(self, flat: dict[str, Any]):
        self.flat = flat

    @classmethod
    def parse(cls, text: str) -> Config:
        flat: dict[str, Any] = {}
        section = ""
        for n, line in enumerate(map(str.strip, text.splitlines()), 1):
            if not line or line[0] in "#;":
                continue
            if line[0] == "[":
                if line[-1] != "]":
                    raise ValueError(f"line {n}: a section header does not end: {line!r}")
                section = line[1:-1].strip()
                continue
            key, eq, raw = line.partition("=")
            if not eq or not key.strip():
                raise ValueError(f"line {n}: key = value expected, not {line!r}")
            try:
                flat[f"{section}.{key.strip()}" if section else key.strip()] = value(raw.strip())
            except json.JSONDecodeError as e:
                raise ValueError(f"line {n}: {e}") from e
        return cls(_resolved(flat))

    def get(self, path: str, default: Any = None, kind: type | None = None) -> Any:
        """The value at a path; the default where there is none or it is of another kind."""
        v = self.flat.get(path, default)
        if kind is float and isinstance(v, int) and not isinstance(v, bool):
            return float(v)
        if kind is int and isinstance(v, float) and v == int(v):
            return int(v)
        return v if kind is None or isinstance(v, kind) and not (kind is int and isinstance(v, bool)) else default

    def has(self, path: str) -> bool:
        return path in self.flat

    def below(self, path: str) -> list[str]:
        return sorted(k for k in self.flat if k.startswith(path + "."))

    def section(self, path: str) -> dict[str, Any]:
        """The values below a path as nested dicts. False, null, zero and the empty string come as 0."""
        out: dict[str, Any] = {}
        for k in self.below(path):
            *names, last = k[len(path) + 1:].split(".")
            at = out
            for n in names:
                at = at.setdefault(n, {})
            v = self.flat[k]
            at[last] = v if v or isinstance(v, list) else 0
        return out


def _resolved(flat: dict[str, Any]) -> dict[str, Any]:
    """flat with ${a.b} and ${a:b} replaced; a value that is one reference takes the other's type."""
    def find(m: re.Match) -> Any:
        key = m[1].replace(":", ".")
        if key not in flat:
            raise ValueError(f"{m[0]} refers to nothing")
        return flat[key]

    def text(v: Any) -> str:
        return "" if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else f"{v:g}" if isinstance(v, float) else str(v)

    for _ in range(PASSES):
        open_ = [k for k, v in flat.items() if isinstance(v, str) and "${" in v]
        if not open_:
            return flat
        for k in open_:
            v = flat[k]
            if "${" in _ref.sub("", v):
                raise ValueError(f"a reference does not end: {v!r}")
            whole = _ref.fullmatch(v)
            flat[k] = find(whole) if whole else _ref.sub(lambda m: text(find(m)), v)
    raise ValueError(f"references are not resolved after {PASSES} passes; is there a cycle?")
