"""The eleven encodings, their stable codes and their labels."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Encoding:
    code: int
    name: str
    label: str
    #: Runs can be told apart from any byte on, whatever came before.
    self_synchronizing: bool
    #: Character filters apply.
    filtered: bool


#: Codes, names and labels of the output format. Codes 1 and 2 share a label.
ENCODINGS = (
    Encoding(0, "ascii", "ASCII", True, True),
    Encoding(1, "utf16le-ascii", "UTF16LE", True, True),
    Encoding(2, "utf16le", "UTF16LE", True, True),
    Encoding(3, "utf8", "UTF8", True, False),
    Encoding(4, "iso2022-jp", "ISO2022JP", False, False),
    Encoding(5, "cp932", "CP932", False, False),
    Encoding(6, "gbk", "GBK", False, False),
    Encoding(7, "euc-kr", "EUCKR", False, False),
    Encoding(8, "windows-1251", "CP1251", True, True),
    Encoding(9, "big5", "BIG5", False, False),
    Encoding(10, "gb18030", "GB18030", False, False),
)
BY_NAME = {e.name: e for e in ENCODINGS}
DEFAULT = ("ascii", "utf16le-ascii")


def chosen(names: str | Iterable[str] = DEFAULT) -> list[Encoding]:
    """Encodings by name, from lists or comma-separated strings, each once, by code."""
    flat = [n.strip() for part in ([names] if isinstance(names, str) else names) for n in part.split(",")]
    unknown = sorted({n for n in flat if n not in BY_NAME})
    if unknown or not flat:
        raise ValueError(f"unknown encoding: {', '.join(unknown) or 'none given'}")
    return sorted({BY_NAME[n] for n in flat}, key=lambda e: e.code)
