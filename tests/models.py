"""Small scanners to hold the patterns against: a step from each byte, no regular expressions."""

import functools

from glyphvein.functions import codecs, filters

kanji_pairs = functools.cache(codecs.kanji_pairs)


def _runs(steps, least):
    """steps: (offset, size, text or None)."""
    out, start, text, end = [], None, "", 0
    for at, size, t in [*steps, (None, 0, None)]:
        if t is not None and start is not None and at == end:
            text, end = text + t, at + size
            continue
        if start is not None and len(text) >= least:
            out.append((start, text))
        start, text, end = (at, t, at + size) if t is not None else (None, "", 0)
    return out


def ascii_runs(data, names, least):
    table = filters.byte_table(names)
    return _runs([(i, 1, chr(b) if table[b] else None) for i, b in enumerate(data)], least)


def utf8_runs(data, least):
    steps, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                c = data[i : i + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and (c == "\t" or " " <= c <= "~" or ord(c) >= 0xA0 and ord(c) not in (0x2028, 0x2029)) and len(data[i : i + n]) == n:
                steps.append((i, n, c))
                i += n
                break
        else:
            steps.append((i, 1, None))
            i += 1
    return _runs(steps, least)


def double_byte_runs(data, name, least):
    table, singles, steps, i = codecs.pair_table(name), set(codecs.single_bytes(name)), [], 0
    leads = set(codecs.spread(codecs.LEADS[name]))
    while i < len(data):
        pair = bytes(data[i : i + 2])
        if data[i] in singles:
            b = data[i]
            steps.append((i, 1, chr(b + 0xFEC0) if b > 0x7F else chr(b)))
            i += 1
        elif name == "gb18030" and data[i] in leads and len(pair) == 2 and 0x30 <= pair[1] <= 0x39:
            if i + 4 > len(data):
                break  # cut at the end of the input
            try:
                c = bytes(data[i : i + 4]).decode("gb18030")
                steps.append((i, 4, c) if len(c) == 1 else (i, 1, None))
                i += 4 if len(c) == 1 else 1
            except UnicodeDecodeError:
                steps.append((i, 1, None))
                i += 1
        elif pair in table:
            steps.append((i, 2, table[pair]))
            i += 2
        else:
            steps.append((i, 1, None))
            i += 1
    return _runs(steps, least)


def utf16_runs(data, names, least):
    """Both parities, before overlaps are resolved: (offset, bytes, text, parity, meets an end)."""
    table, out = filters.table(names), []
    for parity in (0, 1):
        runs, i, steps = [], parity, []
        while i + 1 < len(data):
            u = data[i] | data[i + 1] << 8
            c, size = (u, 2) if not 0xD800 <= u < 0xE000 else (None, 2)
            if 0xD800 <= u < 0xDC00 and i + 3 < len(data):
                v = data[i + 2] | data[i + 3] << 8
                if 0xDC00 <= v < 0xE000:
                    p = 0x10000 + ((u - 0xD800) << 10) + v - 0xDC00
                    if p < len(table) and table[p]:
                        c, size = p, 4
            ok = c is not None and c < len(table) and table[c]
            steps.append((i, size if ok else 2, chr(c) if ok else None))
            i += size if ok else 2
        runs = _runs(steps, 1)
        for at, text in runs:
            size = len(text.encode("utf-16-le"))
            edge = at == parity or at + size >= len(data)
            if len(text) >= least or edge:
                out.append((at, size, text, parity, edge))
    return out


def utf16_resolved(data, names, least):
    runs = utf16_runs(data, names, least)
    plain = lambda t: all(c == "\t" or " " <= c <= "~" for c in t)
    lost = set()
    for a in (r for r in runs if r[3] == 0):
        for b in (r for r in runs if r[3] == 1):
            if a[0] < b[0] + b[1] and b[0] < a[0] + a[1]:
                wins = plain(a[2]) if plain(a[2]) != plain(b[2]) else a[1] >= b[1]
                lost.add((b if wins else a)[:1] + ((b if wins else a)[3],))
    return sorted((r[0], r[2]) for r in runs if (r[0], r[3]) not in lost and len(r[2]) >= least)


def iso2022jp_runs(data, least):
    modes = {b"(B": 0, b"(J": 1, b"(I": 2, b"$@": 3, b"$B": 3}
    pairs = kanji_pairs()
    out, i, mode, start, text, end = [], 0, 0, None, "", 0

    def close():
        if text and len(text) >= least:
            out.append((start, text))

    while i < len(data):
        if data[i] == 0x1B and bytes(data[i + 1 : i + 3]) in modes:
            mode, start, i = modes[bytes(data[i + 1 : i + 3])], i if start is None else start, i + 3
            continue
        c, n = None, 1
        if mode == 3:
            c, n = pairs.get(bytes(data[i : i + 2])), 2
        elif mode == 2:
            c = chr(data[i] + 0xFF40) if 0x21 <= data[i] <= 0x5F else None
        elif data[i] == 9 or 0x20 <= data[i] < 0x7F:
            c = {(1, 0x5C): "\u00a5", (1, 0x7E): "\u203e"}.get((mode, data[i]), chr(data[i]))
        if c is not None:
            start, text, i = i if start is None else start, text + c, i + n
            continue
        close()
        mode, start, text = 0, None, ""
        if bytes(data[i:]) in (b"\x1b", b"\x1b(", b"\x1b$"):
            break
        i += 1
    close()
    return out
