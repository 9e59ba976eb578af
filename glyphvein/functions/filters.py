"""Character filters: which code points a run may hold. Several are joined by OR."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np

#: Code point ranges (ends inclusive) of each filter.
RANGES: dict[str, tuple[tuple[int, int], ...]] = {
    "ascii": ((0x09, 0x09), (0x20, 0x7E)),
    "latin1": ((0xA0, 0xFF),),
    "cyrillic": ((0x0400, 0x04FF),),
    "kanji": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "kanji-ext-b": ((0x20000, 0x2A6DF),),
    "hiragana": ((0x3041, 0x3096), (0x309B, 0x309F)),
    "katakana": ((0x30A0, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3), (0xFFA0, 0xFFDC)),
    "cjkpunct": ((0x3000, 0x3003), (0x3005, 0x3011), (0x3014, 0x301F), (0x3030, 0x3030), (0x303B, 0x303D), (0xFF01, 0xFF5E), (0xFF61, 0xFF9F), (0xFFE0, 0xFFE5)),
    "cjkpunct-all": ((0x3000, 0x303F), (0xFF00, 0xFFEF)),
}
#: Rows of JIS X 0208: level 1, and both levels.
JIS_ROWS = {"kanji-jis1": range(16, 48), "kanji-jis2": range(16, 85)}
NAMES = (*RANGES, *JIS_ROWS, "printable")
#: Filters that admit single bytes; the others have no byte form.
BYTE_FORMS = {"ascii", "latin1", "printable"}
ASCII = RANGES["ascii"]


def _jis(rows: range) -> np.ndarray:
    """BMP table of the characters in these rows, by the Shift_JIS code of each cell."""
    table = np.zeros(1 << 16, bool)
    for row in rows:
        for cell in range(1, 95):
            pair, odd = divmod(row - 1, 2)
            lead = pair + (0x81 if pair < 31 else 0xC1)
            trail = cell + 0x9E if odd else cell + 0x3F + (cell >= 64)
            try:
                char = bytes([lead, trail]).decode("cp932")
            except UnicodeDecodeError:
                continue
            if len(char) == 1:
                table[ord(char)] = True
    return table


def _printable() -> np.ndarray:
    """Planes 0 to 3 without controls (tab stays), surrogates, private use and noncharacters."""
    table = np.ones(1 << 18, bool)
    for first, last in ((0x00, 0x08), (0x0A, 0x1F), (0x7F, 0x9F), (0xD800, 0xDFFF), (0xE000, 0xF8FF), (0xFDD0, 0xFDEF)):
        table[first : last + 1] = False
    for plane in range(4):
        table[(plane << 16) + 0xFFFE : (plane + 1) << 16] = False
    return table


@functools.lru_cache(maxsize=64)
def table(names: tuple[str, ...]) -> np.ndarray:
    """bool for each code point of planes 0 to 3."""
    admitted = np.zeros(1 << 18, bool)
    for name in names:
        if name == "printable":
            admitted |= _printable()
        elif name in JIS_ROWS:
            admitted[: 1 << 16] |= _jis(JIS_ROWS[name])
        elif name in RANGES:
            for first, last in RANGES[name]:
                admitted[first : last + 1] = True
        else:
            raise ValueError(f"unknown filter: {name}")
    return admitted


def chosen(names: str | Iterable[str] = "ascii") -> tuple[str, ...]:
    flat = tuple(dict.fromkeys(n.strip() for part in ([names] if isinstance(names, str) else names) for n in part.split(",")))
    table(flat)
    return flat


def byte_table(names: tuple[str, ...]) -> np.ndarray:
    """bool for each byte: only filters with a byte form count."""
    return table(tuple(n for n in names if n in BYTE_FORMS))[:256]


def size(name: str) -> int:
    return int(table((name,)).sum())
