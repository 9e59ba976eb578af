"""Two- and four-byte code tables: Python's codecs, with the few sequences that the web's tables have otherwise."""

from __future__ import annotations

import functools

import numpy as np

#: Lead and trail ranges of each encoding, and its single bytes beside tab and 0x20-0x7E.
LEADS = {"cp932": ((0x81, 0x9F), (0xE0, 0xFC)), "gbk": ((0x81, 0xFE),), "euc-kr": ((0x81, 0xFD),), "big5": ((0x87, 0xFE),), "gb18030": ((0x81, 0xFE),)}
TRAILS = {
    "cp932": ((0x40, 0x7E), (0x80, 0xFC)),
    "gbk": ((0x40, 0x7E), (0x80, 0xFE)),
    "euc-kr": ((0x41, 0x5A), (0x61, 0x7A), (0x81, 0xFE)),
    "big5": ((0x40, 0x7E), (0xA1, 0xFE)),
    "gb18030": ((0x40, 0x7E), (0x80, 0xFE)),
}
SINGLES = {"cp932": ((0xA1, 0xDF),)}
_CODEC = {"cp932": "cp932", "gbk": "gb18030", "euc-kr": "cp949", "big5": "big5hkscs", "gb18030": "gb18030"}

#: The four Big5 pairs that stand for two code points.
BIG5_DOUBLES = {b"\x88\x62": "Ê̄", b"\x88\x64": "Ê̌", b"\x88\xa3": "ê̄", b"\x88\xa5": "ê̌"}
#: Big5 pairs of the supplement of 2008, 877A to 877E and 87A1 to 87DF in order, and of compatibility.
BIG5_2008 = (
    "㡵𡵓𣚞𦀡㻬𥣞㫵竼龗𤅡𨤍𣇪𠪊𣉞䌊蒄龖鐯䤰蘓墖靊鈘秐稲晠権袝瑌篅枂稬剏遆㓦珄𥶹瓆鿇垳䤯呌䄱𣚎堘穲𧭥讏䚮𦺈䆁𥶙箮𢒼鿈𢓁𢓉𢓌鿉蔄𣖻䂴鿊䓡𪷿拁灮鿋"
)
BIG5_COMPATIBLE = {b"\xc6\xcf": "廴", b"\xc6\xd3": "无", b"\xc6\xd5": "癶", b"\xc6\xd7": "隶", b"\xc6\xde": "〃", b"\xc6\xdf": "仝"}
#: GB18030 pairs by the edition of 2022, and the one of 2005; and the four-byte sequence that took the old place.
GB18030_2022 = {
    b"\xa6\xd9": "︐", b"\xa6\xda": "︒", b"\xa6\xdb": "︑", b"\xa6\xdc": "︓", b"\xa6\xdd": "︔", b"\xa6\xde": "︕", b"\xa6\xdf": "︖", b"\xa6\xec": "︗", b"\xa6\xed": "︘", b"\xa6\xf3": "︙",
    b"\xa8\xbc": "ḿ", b"\xfe\x59": "龴", b"\xfe\x61": "龵", b"\xfe\x66": "龶", b"\xfe\x67": "龷", b"\xfe\x6d": "龸", b"\xfe\x7e": "龹", b"\xfe\x90": "龺", b"\xfe\xa0": "龻",
}
GB18030_FOUR = {b"\x81\x35\xf4\x37": "\ue7c7"}


def spread(ranges: tuple[tuple[int, int], ...]) -> list[int]:
    return [v for a, b in ranges for v in range(a, b + 1)]


def single_bytes(name: str) -> list[int]:
    return [0x09, *range(0x20, 0x7F), *spread(SINGLES.get(name, ()))]


def _decoded(codes, codec: str) -> dict[bytes, str]:
    found = {}
    for code in codes:
        try:
            found[code] = code.decode(codec)
        except UnicodeDecodeError:
            continue
    return found


@functools.lru_cache(maxsize=8)
def pair_table(name: str) -> dict[bytes, str]:
    """The text of each assigned two-byte sequence."""
    found = _decoded((bytes([a, b]) for a in spread(LEADS[name]) for b in spread(TRAILS[name])), _CODEC[name])
    if name == "big5":
        trails = (*range(0x7A, 0x7F), *range(0xA1, 0xE0))
        return found | {bytes([0x87, t]): c for t, c in zip(trails, BIG5_2008, strict=True)} | BIG5_COMPATIBLE | BIG5_DOUBLES
    return found | GB18030_2022 if name in ("gbk", "gb18030") else found


def kanji_pairs() -> dict[bytes, str]:
    """Assigned two-byte cells of ISO-2022-JP: rows and cells 1 to 94, as Shift_JIS has them."""
    shifted = {}
    for row in range(1, 95):
        for cell in range(1, 95):
            pair, odd = divmod(row - 1, 2)
            shifted[bytes([pair + (0x81 if pair < 31 else 0xC1), cell + 0x9E if odd else cell + 0x3F + (cell >= 64)])] = bytes([row + 0x20, cell + 0x20])
    return {shifted[code]: text for code, text in _decoded(shifted, "cp932").items()}


def _points(pairs: dict[bytes, str]) -> np.ndarray:
    """First code point of each 16-bit code, 0 where it is not assigned."""
    table = np.zeros(1 << 16, np.uint32)
    for code, text in pairs.items():
        table[code[0] << 8 | code[1]] = ord(text[0])
    return table


@functools.lru_cache(maxsize=8)
def pair_points(name: str) -> np.ndarray:
    return _points(pair_table(name))


@functools.lru_cache(maxsize=1)
def kanji_points() -> np.ndarray:
    return _points(kanji_pairs())


def linear(a, b, c, d):
    """The place of a four-byte sequence among all."""
    return ((a - 0x81) * 10 + b - 0x30) * 1260 + (c - 0x81) * 10 + d - 0x30


#: Places of the four-byte sequences of GB18030 that stand for code points: below FOUR_BMP, and from FOUR_ASTRAL to FOUR_END (exclusive).
FOUR_BMP, FOUR_ASTRAL, FOUR_END = 39_420, 189_000, 1_237_576


@functools.lru_cache(maxsize=1)
def four_points() -> np.ndarray:
    """Code points of the four-byte sequences below FOUR_BMP."""
    table = np.zeros(FOUR_BMP, np.uint32)
    for n in range(FOUR_BMP):
        code = bytes([0x81 + n // 12600, 0x30 + n // 1260 % 10, 0x81 + n // 10 % 126, 0x30 + n % 10])
        table[n] = ord(GB18030_FOUR.get(code) or code.decode("gb18030"))
    return table


#: What each byte stands for in windows-1251; the hole 0x98 is a control.
CP1251 = np.array([ord(bytes([b]).decode("cp1251", "replace").replace("�", chr(b))) for b in range(256)], np.uint32)
