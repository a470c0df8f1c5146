"""Pieces of SQL for the oracles: 64-bit hashes in 128-bit arithmetic."""

from __future__ import annotations

_TWO64 = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: str) -> str:
    return f"((({a}) * ({b})) % {_TWO64})"


def _add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_TWO64})"


def _c(n: int) -> str:
    return f"{n}::UHUGEINT"


def _signed(x: str) -> str:
    """The same 64 bits as a BIGINT."""
    return f"(CASE WHEN ({x}) >= 9223372036854775808::UHUGEINT THEN (({x})::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE ({x})::BIGINT END)"


def hash64(source: str, text: str, out: str) -> str:
    """CTEs ending in out: the rows of source with h, the 64-bit murmur hash (seed 1) of a text column, as UHUGEINT, and id, the same bits as BIGINT."""
    m = _c(0xC6A4A7935BD1E995)
    word = lambda at, n: f"('0x' || array_to_string(list_transform(range({n} - 1, -1, -1), lambda b: substr(hx, (2 * ({at} + b) + 1)::INT, 2)), ''))::UBIGINT::UHUGEINT"
    mix = f"lambda h, k: {_mul(f'xor(h, {_mul("xor(" + _mul("k", m) + ", " + _mul("k", m) + " >> 47)", m)})', m)}"
    return f"""{out}_0 AS (SELECT *, hex(encode({text})) AS hx, octet_length(encode({text})) AS nb FROM {source}),
    {out}_1 AS (SELECT *, list_prepend(xor(1::UHUGEINT, {_mul("nb::UHUGEINT", m)}), list_transform(range(nb // 8), lambda j: {word("8 * j", "8")})) AS ks, CASE WHEN nb % 8 > 0 THEN {word("nb // 8 * 8", "(nb % 8)")} END AS tail FROM {out}_0),
    {out}_2 AS (SELECT *, list_reduce(ks, {mix}) AS h0 FROM {out}_1),
    {out}_3 AS (SELECT *, CASE WHEN tail IS NULL THEN h0 ELSE {_mul("xor(h0, tail)", m)} END AS h1 FROM {out}_2),
    {out}_4 AS (SELECT *, {_mul("xor(h1, h1 >> 47)", m)} AS h2 FROM {out}_3),
    {out} AS (SELECT * EXCLUDE (hx, nb, ks, tail, h0, h1, h2), xor(h2, h2 >> 47) AS h, {_signed("xor(h2, h2 >> 47)")} AS id FROM {out}_4)"""


def hash4(source: str, number: str, seed: int, out: str) -> str:
    """CTEs ending in out: the rows of source with w0 to w3, the words of the 128-bit hash of a 64-bit number (UHUGEINT)."""
    rot = lambda x, r: f"((({x}) * {_c(2**r)}) % {_TWO64} + (({x}) >> {64 - r}))"
    steps = [
        ("a", _mul(number, _c(0x87C37B91114253D5))), ("b", _mul(rot("a", 31), _c(0x4CF5AD432745937F))),
        ("p", f"xor(xor(b, {_c(seed)}), {_c(8)})"), ("q", f"xor({_c(seed)}, {_c(8)})")]
    steps += [("p1", _add("p", "q")), ("q1", _add("q", "p1"))]
    for x in "pq":
        steps += [(f"{x}2", _mul(f"xor({x}1, {x}1 >> 33)", _c(0xFF51AFD7ED558CCD))), (f"{x}3", _mul(f"xor({x}2, {x}2 >> 33)", _c(0xC4CEB9FE1A85EC53))), (f"{x}4", f"xor({x}3, {x}3 >> 33)")]
    steps += [("p5", _add("p4", "q4")), ("q5", _add("q4", "p5"))]
    ctes, last = [], source
    for k, (name, expr) in enumerate(steps):
        ctes.append(f"{out}_{k} AS (SELECT *, {expr} AS {name} FROM {last})")
        last = f"{out}_{k}"
    names = ", ".join(n for n, _ in steps)
    low = _c(2**32)
    return ",\n    ".join([*ctes, f"{out} AS (SELECT * EXCLUDE ({names}), (p5 % {low})::BIGINT AS w0, (p5 >> 32)::BIGINT AS w1, (q5 % {low})::BIGINT AS w2, (q5 >> 32)::BIGINT AS w3 FROM {last})"])
