"""Complex arithmetic on (re, im) column pairs; all stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def mul_conj(a: Pair, b: Pair) -> Pair:
    """a times conjugate b."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def scale(a: Pair, k: float) -> Pair:
    return a[0] * k, a[1] * k


def abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def at(i: int, re: str = "re", im: str | None = "im") -> Pair:
    """Channel i of a PIX row."""
    return F.get(F.col(re), F.lit(i)), F.get(F.col(im), F.lit(i)) if im else F.lit(0.0)


def linear(terms: list[tuple[complex, Pair]]) -> Pair:
    """The sum of literal complex factors times columns; zero parts are left out."""
    re, im = [], []
    for k, (a, b) in terms:
        k = complex(k)
        if k.real:
            re.append(a * k.real)
            im.append(b * k.real)
        if k.imag:
            re.append(b * -k.imag)
            im.append(a * k.imag)

    def total(parts: list[Column]) -> Column:
        out = parts[0] if parts else F.lit(0.0)
        for p in parts[1:]:
            out = out + p
        return out

    return total(re), total(im)
