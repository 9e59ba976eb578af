"""What a task does with bytes: marks the characters of an encoding, and takes maximal runs of them.

A value is classified as a whole, by array operations: which bytes are covered by admitted characters, and
which are followed by more of the same run. No byte is tried twice and nothing recurses, so long runs cost
what short ones do. Long values are worked off in slabs, cut at bytes that cannot belong to any run under any
reading: at such a cut nothing is open, so slabs, chunks and files give the same runs.

Tokenizers that read left to right need no loop: where two-byte codes follow each other without a certain
beginning, every second byte begins one, counted from the last certain one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphvein.encodings import BY_NAME
from glyphvein.functions import codecs, filters

#: Bytes worked off at once, and bytes looked through at once for a cut.
SLAB, LOOK = 1 << 20, 1 << 16


def _flags(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


#: Tab and printable ASCII, which encodings without filters admit.
TEXT = _flags([0x09, *range(0x20, 0x7F)])
DIGIT = _flags(range(0x30, 0x3A))


@dataclass
class Slab:
    """Parts of inputs, one after another: bytes, bounds, where each part begins in its input, and how long that is."""

    data: np.ndarray
    at: np.ndarray
    base: np.ndarray
    total: np.ndarray

    def ends(self, positions: np.ndarray) -> np.ndarray:
        """Where the part of each position ends."""
        return self.at[np.searchsorted(self.at, positions, "right")]

    def last_bytes(self) -> np.ndarray:
        return self.at[1:][self.at[1:] > self.at[:-1]] - 1


@dataclass
class Marks:
    """Of each byte: how many code points the character that begins here has; covered by one; followed, a stride on, by more of the run."""

    chars: np.ndarray
    cover: np.ndarray
    joined: np.ndarray
    stride: int = 1
    #: 16-bit codes that begin at each byte, of double-byte encodings.
    code: np.ndarray | None = None


def _then(mask: np.ndarray, by: int) -> np.ndarray:
    """mask moved so that a position shows what stands `by` after it."""
    out = np.zeros(len(mask), bool)
    if by < len(mask):
        out[: len(mask) - by] = mask[by:]
    return out


def spans(m: Marks, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of at least `least` units begin and end (exclusive), by unit parity, then by place."""
    s, enough, have = m.stride, m.joined, 1
    while have < least - 1:
        step = min(have, least - 1 - have)
        enough = enough & _then(enough, step * s)
        have += step
    first = m.cover.copy()
    first[s:] &= ~m.joined[:-s]
    last = m.cover & ~m.joined
    if least > 1:
        reach = (least - 1) * s
        first &= enough
        begin, end = np.flatnonzero(first), np.flatnonzero(last[reach:] & enough[:-reach]) + reach if reach < len(last) else np.zeros(0, np.int64)
    else:
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
    if s == 2:
        begin, end = (np.concatenate([x[x & 1 == 0], x[x & 1 == 1]]) for x in (begin, end))
    return begin, end + s


def ranks(values: np.ndarray, step: int) -> np.ndarray:
    """The number of each value in its stretch of values that lie `step` apart, from 0."""
    place = np.arange(len(values))
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] - values[:-1] != step
    return place - np.maximum.accumulate(np.where(fresh, place, 0))


# ---------------------------------------------------------------- classification


def _single(table: np.ndarray, slab: Slab) -> Marks:
    cover = table[slab.data]
    joined = cover & _then(cover, 1)
    joined[slab.last_bytes()] = False
    return Marks(cover, cover, joined)


def _utf8(slab: Slab) -> Marks:
    v = np.concatenate([slab.data, np.zeros(3, np.uint8)])
    chars = TEXT[slab.data]
    cover = chars.copy()
    lead = np.flatnonzero(slab.data >= 0xC2)
    room = slab.ends(lead) - lead
    a, b = v[lead], v[lead + 1]
    more = [(v[lead + k] & 0xC0 == 0x80) & (room > k) for k in (1, 2, 3)]
    two = (a < 0xE0) & more[0] & ~((a == 0xC2) & (b < 0xA0))
    three = (a >= 0xE0) & (a < 0xF0) & more[0] & more[1] & ~((a == 0xE0) & (b < 0xA0)) & ~((a == 0xED) & (b >= 0xA0))
    three &= ~((a == 0xE2) & (b == 0x80) & ((v[lead + 2] == 0xA8) | (v[lead + 2] == 0xA9)))  # separators of lines and paragraphs
    four = (a >= 0xF0) & (a < 0xF5) & more[0] & more[1] & more[2] & ~((a == 0xF0) & (b < 0x90)) & ~((a == 0xF4) & (b >= 0x90))
    for size, found in ((2, two), (3, three), (4, four)):
        p = lead[found]
        chars[p] = True
        for k in range(size):
            cover[p + k] = True
    joined = cover & _then(cover, 1)
    joined[slab.last_bytes()] = False
    return Marks(chars, cover, joined)


#: What two bytes may begin: a single character, an assigned pair, a pair of two code points, half of a four-byte sequence.
ONE, PAIR, TWICE, HALF = 1, 2, 4, 8


@functools.lru_cache(maxsize=8)
def pair_classes(name: str) -> np.ndarray:
    """The class of each 16-bit code."""
    out = np.zeros((256, 256), np.uint8)
    out[_flags(codecs.single_bytes(name))] = ONE
    out.reshape(-1)[codecs.pair_points(name) > 0] |= PAIR
    if name == "big5":
        for twice in codecs.BIG5_DOUBLES:
            out[twice[0], twice[1]] |= TWICE
    if name == "gb18030":
        out[np.ix_(_flags(codecs.spread(codecs.LEADS[name])), DIGIT)] |= HALF
    return out.reshape(-1)


@functools.lru_cache(maxsize=8)
def first_points(name: str) -> np.ndarray:
    """The code point of what each 16-bit code begins with: of pairs their first, else that of the single byte."""
    byte = np.arange(256, dtype=np.uint32)
    single = np.where(_flags(codecs.single_bytes(name)), np.where(byte > 0x7F, byte + 0xFEC0, byte), 0)
    return np.where(codecs.pair_points(name) > 0, codecs.pair_points(name), np.repeat(single, 256)).astype(np.uint32)


def _double(name: str, slab: Slab) -> Marks:
    n = len(slab.data)
    code = slab.data.astype(np.uint16) << 8
    code[:-1] |= slab.data[1:]
    kind = pair_classes(name)[code]
    last = slab.last_bytes()
    kind[last] &= ONE  # no pair goes on from one part to the next
    pairs = kind & PAIR != 0
    chars = kind & ONE | pairs
    if name == "big5":
        chars += kind & (TWICE | PAIR) == TWICE | PAIR
    second = np.flatnonzero(pairs) + 1
    inner = second[ranks(second, 1) % 2 == 0]  # bytes that no character begins at
    chars[inner] = 0
    cover = chars > 0
    cover[inner] = True
    if name == "gb18030":
        begins = np.ones(n, bool)
        begins[inner] = False
        half = kind & HALF != 0
        form = np.flatnonzero(half[:-2] & half[2:]) if n > 3 else np.zeros(0, np.int64)
        form = form[slab.ends(form) - form > 3]
        place = codecs.linear(*(slab.data[form + k].astype(np.int64) for k in range(4)))
        form = form[(place < codecs.FOUR_BMP) | (place >= codecs.FOUR_ASTRAL) & (place < codecs.FOUR_END)]
        form = form[begins[form]]  # digits follow no lead of two, so that pairs are in step whatever comes of fours
        form = form[ranks(form, 2) % 2 == 0]
        for k in (1, 2, 3):
            chars[form + k], begins[form + k] = 0, False
        for k in range(4):
            cover[form + k] = True
        chars[form] = 1
        # what a cut four-byte sequence at the end of the input has is no text
        end, left = slab.at[1:], slab.total - slab.base - np.diff(slab.at)
        for size, within in ((3, 0), (2, 1)):
            s = end - size
            some = np.flatnonzero((left <= within) & (s >= slab.at[:-1]))
            s = s[some]
            s = s[begins[s] & half[s]]
            for k in range(size):
                chars[s + k], cover[s + k], begins[s + k] = 0, False, False
    joined = cover & _then(cover, 1)
    joined[last] = False
    return Marks(chars, cover, joined, code=code)


def _wide(table: np.ndarray, astral: np.ndarray | None, slab: Slab) -> Marks:
    """16-bit units at every byte; a run's units are two bytes apart."""
    v = np.concatenate([slab.data, np.zeros(3, np.uint8)])
    n = len(slab.data)
    cover = table[v[:n] | v[1 : n + 1].astype(np.uint16) << 8]
    cover[slab.last_bytes()] = False
    chars = cover
    if astral is not None:
        high = np.flatnonzero(v[1 : n + 1] & 0xFC == 0xD8)
        high = high[(v[high + 3] & 0xFC == 0xDC) & (slab.ends(high) - high > 3)] if len(high) else high
        unit = lambda p: (v[p] | v[p + 1].astype(np.uint32) << 8) & 0x3FF
        point = 0x10000 + (unit(high) << 10) + unit(high + 2)
        high = high[(point < len(astral)) & astral[np.minimum(point, len(astral) - 1)]]
        chars = cover.copy()
        chars[high] = cover[high] = cover[high + 2] = True
    joined = cover & _then(cover, 2)
    for back in (0, 1, 2):
        last = slab.last_bytes() - back
        joined[last[last >= 0]] = False
    return Marks(chars, cover, joined, 2)


# ---------------------------------------------------------------- texts


def strings(points: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Code points, one text after another, as strings of so many each."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _within(begin: np.ndarray, size: np.ndarray, stride: int = 1) -> np.ndarray:
    """All positions of stretches."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(begin - upto[:-1] * stride, size) + np.arange(upto[-1]) * stride


def _double_points(name: str, slab: Slab, p: np.ndarray, m: Marks) -> np.ndarray:
    """Code points of the characters that begin at p."""
    code = m.code[p]
    points = first_points(name)[code]
    if name == "gb18030":
        four = np.flatnonzero((points == 0) | (pair_classes(name)[code] & HALF != 0))
        place = codecs.linear(*(slab.data[p[four] + k].astype(np.int64) for k in range(4)))
        points[four] = np.where(place < codecs.FOUR_BMP, codecs.four_points()[np.minimum(place, codecs.FOUR_BMP - 1)], place - codecs.FOUR_ASTRAL + 0x10000)
    if name == "big5":
        twice = np.flatnonzero(m.chars[p] == 2)
        if len(twice):
            second = {c[0] << 8 | c[1]: ord(t[1]) for c, t in codecs.BIG5_DOUBLES.items()}
            points = np.insert(points, twice + 1, [second[int(x)] for x in code[twice]])
    return points


# ---------------------------------------------------------------- ISO-2022-JP

#: Modes by what follows ESC; fixed values.
ASCII_MODE, ROMAN, KANA, KANJI = 0, 1, 2, 3
_SHIFTS = {b"(B": ASCII_MODE, b"(J": ROMAN, b"(I": KANA, b"$@": KANJI, b"$B": KANJI}
#: Bytes of half-width katakana, and of halves of kanji.
_KANA, _HALVES = _flags(range(0x21, 0x60)), _flags(range(0x21, 0x7F))


@dataclass
class Shifts:
    """Escapes of a slab, in order, and what is valid after each in its mode.

    begin: of the escape; mode; first: of what follows; size: how many bytes of it are characters, without a break; after:
    where the next escape or the end of its part is. What comes after a break, up to the next escape, is ASCII.
    """

    begin: np.ndarray
    mode: np.ndarray
    first: np.ndarray
    size: np.ndarray
    after: np.ndarray
    #: The next escape is in the same part, and nothing breaks before it.
    goes_on: np.ndarray


def _next(positions: np.ndarray, at: np.ndarray, default: np.ndarray) -> np.ndarray:
    """The first of the positions from each place on, default at most."""
    i = np.searchsorted(positions, at)
    return np.minimum(np.append(positions, np.iinfo(np.int64).max)[i], default)


def shifts(slab: Slab) -> Shifts:
    v = slab.data
    escape = np.flatnonzero(v == 0x1B)
    escape = escape[slab.ends(escape) - escape > 2] if len(escape) else escape
    code = v[escape + 1].astype(np.int64) << 8 | v[escape + 2]
    mode = np.full(len(escape), -1)
    for said, m in _SHIFTS.items():
        mode[code == (said[0] << 8 | said[1])] = m
    begin, mode = escape[mode >= 0], mode[mode >= 0]
    end = slab.ends(begin) if len(begin) else begin
    after = np.minimum(np.append(begin[1:], len(v)), end) if len(begin) else begin
    first, size = begin + 3, np.zeros(len(begin), np.int64)
    for modes, table in (((ASCII_MODE, ROMAN), TEXT), ((KANA,), _KANA), ((KANJI,), _HALVES)):
        own = np.flatnonzero(np.isin(mode, modes))
        if len(own):
            size[own] = _next(np.flatnonzero(~table[v]), first[own], after[own]) - first[own]
    own = np.flatnonzero(mode == KANJI)
    if len(own):
        n = size[own] // 2
        at = _within(first[own], n, 2)
        bad = np.flatnonzero(codecs.kanji_points()[v[at].astype(np.int64) << 8 | v[at + 1]] == 0)
        upto = np.cumsum(n) - n
        size[own] = 2 * (_next(bad, upto, upto + n) - upto)
    return Shifts(begin, mode, first, size, after, (first + size == after) & (after < end))


# ---------------------------------------------------------------- scanners


class Scanner:
    """Finds runs of one encoding under character filters."""

    def __init__(self, name: str, names: tuple[str, ...], least: int):
        self.encoding, self.least, self.wide = BY_NAME[name], least, name.startswith("utf16le")
        if name == "ascii":
            self.table = filters.byte_table(names)
        elif name == "windows-1251":
            admitted, point = filters.table(names), codecs.CP1251
            self.table = admitted[point] & ((point == 9) | ~((point < 32) | (point >= 0x7F) & (point < 0xA0)))
        elif self.wide:
            self.table = filters.table(names)[: 1 << 16].copy()
            self.astral = None
            shaped = self.table.copy()
            if name == "utf16le":
                self.table[0xD800:0xE000] = False
                shaped[0xD800:0xE000] = True
                self.astral = filters.table(names) if filters.table(names)[1 << 16 :].any() else None
            self.shaped = shaped
        if name in ("ascii", "windows-1251"):
            self.shaped = self.table
        elif name == "utf8":
            self.shaped = TEXT | _flags([*range(0x80, 0xC0), *range(0xC2, 0xF5)])
        elif name == "iso2022-jp":
            self.shaped = TEXT | _flags([0x1B])
        elif not self.wide:
            self.shaped = _flags([*codecs.single_bytes(name), *codecs.spread(codecs.LEADS[name]), *codecs.spread(codecs.TRAILS[name]), *(range(0x30, 0x3A) if name == "gb18030" else ())])

    def _cuts(self, data: np.ndarray, begin: int, end: int) -> np.ndarray:
        """All cuts from begin to end (exclusive): bytes, of wide encodings units at both alignments, that end every run."""
        if not self.wide:
            return np.flatnonzero(~self.shaped[data[begin:end]]) + begin
        begin, end = max(begin, 1), min(end, len(data) - 1)
        if begin >= end:
            return np.zeros(0, np.int64)
        v = data[begin - 1 : end + 1].astype(np.uint16)
        open_ = self.shaped[v[:-1] | v[1:] << 8]
        return np.flatnonzero(~open_[:-1] & ~open_[1:]) + begin

    def all_cuts(self, data: np.ndarray) -> np.ndarray:
        return self._cuts(data, 0, len(data))

    def next_cut(self, data: np.ndarray, at: int) -> int | None:
        """The first cut from `at` on."""
        for begin in range(at, len(data), LOOK):
            found = self._cuts(data, begin, min(begin + LOOK, len(data)))
            if len(found):
                return int(found[0])
        return None

    def last_cut(self, data: np.ndarray) -> int | None:
        for end in range(len(data), 0, -LOOK):
            found = self._cuts(data, max(end - LOOK, 0), end)
            if len(found):
                return int(found[-1])
        return None

    def slabs(self, data: np.ndarray, base: int, total: int) -> Iterator[Slab]:
        """A long part of an input, in slabs."""
        begin = 0
        while begin < len(data):
            end = self.next_cut(data, begin + SLAB) if begin + SLAB < len(data) else None
            end = len(data) if end is None else end
            yield Slab(data[begin:end], np.array([0, end - begin]), np.array([base + begin]), np.array([total]))
            begin = end

    def marks(self, slab: Slab) -> Marks:
        name = self.encoding.name
        if name in ("ascii", "windows-1251"):
            return _single(self.table, slab)
        if name == "utf8":
            return _utf8(slab)
        return _wide(self.table, self.astral, slab) if self.wide else _double(name, slab)

    def runs(self, slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each run its part, begin in the part, bytes, code points, and text."""
        if self.encoding.name == "iso2022-jp":
            return self._shifted(slab)
        m = self.marks(slab)
        begin, end = spans(m, 1 if self.encoding.name == "utf16le" else self.least)
        if self.wide and self.encoding.name != "utf16le":
            counts = (end - begin) // 2
        elif m.chars is m.cover and not self.wide:
            counts = end - begin
        else:
            upto = np.concatenate([np.zeros((1,), np.int32), np.cumsum(m.chars, dtype=np.int32)])
            counts = upto[end] - upto[begin]
            if self.wide:  # characters of the run's own alignment
                both = np.concatenate([[0, 0], m.chars.astype(np.int32)])
                even, odd = np.cumsum(both[0::2]), np.cumsum(both[1::2])
                per = lambda p: np.where(p & 1 == 0, even[np.minimum(p // 2, len(even) - 1)], odd[np.minimum(p // 2, len(odd) - 1)])
                counts = per(end) - per(begin)
        row = np.searchsorted(slab.at, begin, "right") - 1
        if self.encoding.name == "utf16le":
            keep = self._resolved(slab, row, begin, end, counts)
        else:
            keep = counts >= self.least
        row, begin, end, counts = row[keep], begin[keep], end[keep], counts[keep].astype(np.int64)
        return row, begin - slab.at[row], end - begin, counts, self._texts(slab, m, begin, end, counts)

    def _texts(self, slab: Slab, m: Marks, begin: np.ndarray, end: np.ndarray, counts: np.ndarray) -> pa.Array:
        name = self.encoding.name
        if name == "utf8":
            at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
            return pa.StringArray.from_buffers(len(begin), pa.py_buffer(at.tobytes()), pa.py_buffer(slab.data[_within(begin, end - begin)].tobytes()))
        if name == "utf16le":
            raw = slab.data[_within(begin, end - begin)]
            return strings(np.frombuffer(raw.tobytes().decode("utf-16-le").encode("utf-32-le"), "<u4"), counts)
        if name == "utf16le-ascii":
            return strings(slab.data[_within(begin, counts, 2)], counts)  # the low byte stands for a unit
        inside = _within(begin, end - begin)
        if name in ("ascii", "windows-1251"):
            return strings(slab.data[inside] if name == "ascii" else codecs.CP1251[slab.data[inside]], counts)
        return strings(_double_points(name, slab, inside[m.chars[inside] > 0], m), counts)

    def _resolved(self, slab: Slab, row: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which runs stay: of two at different alignments that overlap, one goes.

        The one that is all ASCII stays, else the longer in bytes, else the one at even offsets. Runs below the
        least length take part at the ends of the input alone.
        """
        offset = begin - slab.at[row] + slab.base[row]
        parity = offset & 1
        edge = (offset == parity) | (offset + end - begin >= slab.total[row])
        able = (counts >= self.least) | edge
        v = slab.data
        other = np.zeros(len(v) + 2, np.int32)
        other[2:-1] = ~(TEXT[v[:-1]] & (v[1:] == 0)) if len(v) else 0
        even, odd = np.cumsum(other[0::2]), np.cumsum(other[1::2])
        upto = lambda p: np.where(p & 1 == 0, even[np.minimum(p // 2, len(even) - 1)], odd[np.minimum(p // 2, len(odd) - 1)])
        plain = upto(end) == upto(begin)
        a, b = np.flatnonzero(able & (parity == 0)), np.flatnonzero(able & (parity == 1))
        a, b = a[np.argsort(begin[a], kind="stable")], b[np.argsort(begin[b], kind="stable")]
        first, last = np.searchsorted(end[b], begin[a], "right"), np.searchsorted(begin[b], end[a], "left")
        size = np.maximum(last - first, 0)
        i, j = np.repeat(a, size), b[_within(first, size)]
        wins = np.where(plain[i] != plain[j], plain[i], end[i] - begin[i] >= end[j] - begin[j])
        stay = counts >= self.least
        stay[np.where(wins, j, i)] = False
        return stay

    def _shifted(self, slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """ISO-2022-JP: runs of ASCII, and chains of escapes with the characters after them that no break parts.

        A chain begins with the ASCII run that ends at its first escape, or at that escape; escapes at its end are no part of it.
        """
        v, found = slab.data, shifts(slab)
        table = TEXT[v]
        # the input's last bytes may begin an escape: they are no text
        end = slab.at[1:][(slab.base + np.diff(slab.at) == slab.total) & (np.diff(slab.at) > 1)] - 1
        table[end[(v[end - 1] == 0x1B) & ((v[end] == 0x28) | (v[end] == 0x24))]] = False
        if len(found.begin):
            table[_within(found.begin, np.minimum(found.first + found.size + 1, found.after) - found.begin)] = False  # and the byte that breaks
        joined = table & _then(table, 1)
        joined[slab.last_bytes()] = False
        begin, stop = spans(Marks(table, table, joined), self.least)
        chain = np.cumsum(np.concatenate([[True], ~found.goes_on[:-1]])) - 1 if len(found.begin) else found.begin
        head = np.flatnonzero(np.concatenate([[True], ~found.goes_on[:-1]])) if len(found.begin) else found.begin
        if len(head):
            where = found.begin[head]
            plain = ~np.isin(stop, where[~np.isin(where, slab.at)])  # what ends where a part begins belongs to the part before
            begin, stop = begin[plain], stop[plain]
        row = np.searchsorted(slab.at, begin, "right") - 1
        counts = stop - begin
        text = strings(v[_within(begin, counts)], counts)
        if not len(head):
            return row, begin - slab.at[row], counts, counts, text
        # what each chain says, stretch by stretch: the ASCII before it, then what follows each escape
        gaps = np.concatenate([[-1], np.flatnonzero(~table)])
        lead = np.maximum(gaps[np.searchsorted(gaps, where) - 1] + 1, slab.at[np.searchsorted(slab.at, where, "right") - 1])
        of = np.concatenate([np.arange(len(head)), chain])
        first, size = np.concatenate([lead, found.first]), np.concatenate([where - lead, found.size])
        mode = np.concatenate([np.full(len(head), ASCII_MODE), found.mode])
        some = np.flatnonzero(size > 0)
        some = some[np.lexsort((first[some], of[some]))]
        of, first, size, mode = of[some], first[some], size[some], mode[some]
        stride = np.where(mode == KANJI, 2, 1)
        chars = size // stride
        total = np.bincount(of, chars, len(head)).astype(np.int64)
        last = np.zeros(len(head), np.int64)
        np.maximum.at(last, of, first + size)
        keep = total >= max(self.least, 1)
        mine = keep[of]
        first, chars, mode, stride = first[mine], chars[mine], mode[mine], stride[mine]
        at = np.repeat(first - (np.cumsum(chars) - chars) * stride, chars) + np.arange(chars.sum()) * np.repeat(stride, chars)
        kind, byte = np.repeat(mode, chars), v[at].astype(np.uint32)
        points = np.where(kind == KANA, byte + 0xFF40, byte)
        points[(kind == ROMAN) & (byte == 0x5C)], points[(kind == ROMAN) & (byte == 0x7E)] = 0xA5, 0x203E
        pair = np.flatnonzero(kind == KANJI)
        points[pair] = codecs.kanji_points()[byte[pair] << 8 | v[at[pair] + 1]]
        start = lead[keep]
        row = np.concatenate([row, np.searchsorted(slab.at, start, "right") - 1])
        begin, size, counts = np.concatenate([begin, start]), np.concatenate([counts, last[keep] - start]), np.concatenate([counts, total[keep]])
        return row, begin - slab.at[row], size, counts, pa.concat_arrays([text, strings(points, total[keep])])


@functools.lru_cache(maxsize=64)
def scanner(name: str, names: tuple[str, ...], least: int) -> Scanner:
    return Scanner(name, names, least)


def grouped(values: pa.Array, base: np.ndarray, total: np.ndarray) -> Iterator[tuple[np.ndarray, Slab]]:
    """Binary values in groups of about SLAB bytes (one at least), with their rows."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.fill_null(b"") if values.null_count else values
    _, offsets, data = values.buffers()
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLAB, "right")) - 1)
        rows = np.arange(begin, end)
        yield rows, Slab(data[at[begin] : at[end]], at[begin : end + 1] - at[begin], base[rows], total[rows])
        begin = end


def one_value(data: np.ndarray, begin: int = 0) -> pa.Array:
    """Bytes from `begin` on as an array of one value, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([begin, len(data)], np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


RUN_FIELDS = ("offset", "encoding_code", "encoding", "cb", "cch", "text")
RUN_SCHEMA = "offset long, encoding_code short, encoding string, cb long, cch long, text string"


def run_batches(scanners: list[Scanner], values: pa.Array, keys: dict[str, pa.Array], base: np.ndarray | None = None, total: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of values, each with the keys of its row. base, total: where a value begins in its input, and how long that is."""
    if base is None:
        base = np.zeros(len(values), np.int64)
        total = np.asarray(pc.binary_length(values).fill_null(0)).astype(np.int64)
    for rows, group in grouped(values, base, total):
        for s in scanners:
            parts = [group] if len(group.data) <= SLAB or len(rows) > 1 else s.slabs(group.data, int(group.base[0]), int(group.total[0]))
            for slab in parts:
                if not len(slab.data):
                    continue
                row, begin, cb, cch, text = s.runs(slab)
                if len(row):
                    where, n = pa.array(rows[row]), len(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(k.take(where) for k in keys.values()), pa.array(slab.base[row] + begin), pa.repeat(pa.scalar(s.encoding.code, pa.int16()), n), pa.repeat(s.encoding.label, n), pa.array(cb.astype(np.int64)), pa.array(cch.astype(np.int64)), text],
                        [*keys, *RUN_FIELDS],
                    )
