"""Ranges of values, as regular expression classes name them."""

from __future__ import annotations

from collections.abc import Iterable


def ranges(values: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in sorted(set(values)):
        if out and v == out[-1][1] + 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [(a, b) for a, b in out]
