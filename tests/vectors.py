"""Bytes, options and the runs they hold (offset, text)."""

VECTORS = [
    ('ascii_min', 'ascii', 'ascii', 4, '61 62 63 00 58 58 58 58 09 59 20 7a 7a 7a', [(4, 'XXXX\tY zzz')]),
    ('ascii_incl', 'ascii', 'ascii', 3, '41 00 41 42 00 41 42 43 00 41 42 43 44 00', [(5, 'ABC'), (9, 'ABCD')]),
    ('u16a_odd', 'utf16le-ascii', 'ascii', 5, '00 48 00 45 00 4c 00 4c 00 4f 00 20 00 57 00 4f 00 52 00 4c 00 44 00', [(1, 'HELLO WORLD')]),
    ('u16a_parity', 'utf16le-ascii', 'ascii', 3, '41 00 42 00 43 00 00 44 00 45 00 46 00 00 00', [(0, 'ABC'), (7, 'DEF')]),
    ('u16a_edge', 'utf16le-ascii', 'ascii', 4, '00 00 00 00 00 00 00 41 00 42 00 43 00 44 00 00 00', [(7, 'ABCD')]),
    ('u16_kanji', 'utf16le', 'kanji', 1, 'e5 65 2c 67 9e 8a', [(0, '\u65e5\u672c\u8a9e')]),
    ('u16_reject', 'utf16le', 'ascii', 1, 'e5 65 2c 67 9e 8a', []),
    ('u16_split', 'utf16le', 'hiragana', 1, '72 30 89 30 4c 30 6a 30 c6 30 b9 30 c8 30 72 30 89 30 4c 30 6a 30', [(0, '\u3072\u3089\u304c\u306a'), (14, '\u3072\u3089\u304c\u306a')]),
    ('u16_cafe', 'utf16le', 'ascii,latin1', 1, '63 00 61 00 66 00 e9 00', [(0, 'caf\xe9')]),
    ('u16_astral', 'utf16le', 'kanji-ext-b', 1, '40 d8 00 dc', [(0, '\U00020000')]),
    ('u16_astral_rej', 'utf16le', 'kanji', 1, '40 d8 00 dc', []),
    ('u16_lone_hi', 'utf16le', 'kanji', 1, '28 67 00 d8 97 67', [(0, '\u6728'), (4, '\u6797')]),
    ('u16_lone_lo', 'utf16le', 'kanji', 1, '28 67 00 dc 97 67', [(0, '\u6728'), (4, '\u6797')]),
    ('u16_mismatch', 'utf16le', 'kanji', 1, '28 67 00 d8 01 d8 97 67', [(0, '\u6728'), (6, '\u6797')]),
    ('u16_conflict', 'utf16le', 'ascii,kanji', 1, '48 00 45 00 4c 00 4c 00 4f 00 20 00 57 00 4f 00 52 00 4c 00 44 00', [(0, 'HELLO WORLD')]),
    ('u16_both', 'utf16le', 'ascii', 1, '41 00 42 00 00 43 00 44 00', [(0, 'AB'), (5, 'CD')]),
    ('u16_astral_win', 'utf16le', 'printable', 3, '40 d8 0b dc 40 d8 0c dc 40 d8 0d dc 40 d8 0e dc 40 d8 0f dc', [(0, '\U0002000b\U0002000c\U0002000d\U0002000e\U0002000f')]),
    ('utf8_space', 'utf8', 'ascii', 1, '41 c2 a0 42 e3 80 80 43', [(0, 'A\xa0B\u3000C')]),
    ('utf8_sep', 'utf8', 'ascii', 1, '41 42 e2 80 a8 43 44 e2 80 a9 45 46', [(0, 'AB'), (5, 'CD'), (10, 'EF')]),
    ('utf8_invalid', 'utf8', 'ascii', 1, '41 42 80 43 44 c0 af 45 46', [(0, 'AB'), (3, 'CD'), (7, 'EF')]),
    ('utf8_trunc', 'utf8', 'ascii', 1, '41 42 e6', [(0, 'AB')]),
    ('w1251_word', 'windows-1251', 'ascii,cyrillic', 1, 'cf f0 e8 e2 e5 f2 00', [(0, '\u041f\u0440\u0438\u0432\u0435\u0442')]),
    ('w1251_98', 'windows-1251', 'ascii,cyrillic', 1, 'c0 c1 c2 98 c3 c4 c5 00', [(0, '\u0410\u0411\u0412'), (4, '\u0413\u0414\u0415')]),
    ('w1251_default', 'windows-1251', 'ascii', 1, '61 62 63 cf f0 e8 e2 e5 f2 64 65 66 00', [(0, 'abc'), (9, 'def')]),
    ('w1251_off', 'windows-1251', 'ascii,cyrillic', 1, 'cf f0 e8 e2 e5 f2 00 ec e8 f0 00', [(0, '\u041f\u0440\u0438\u0432\u0435\u0442'), (7, '\u043c\u0438\u0440')]),
    ('w1251_min', 'windows-1251', 'ascii,cyrillic', 4, 'c4 e0 00 cf f0 e8 e2 e5 f2', [(3, '\u041f\u0440\u0438\u0432\u0435\u0442')]),
    ('cp932_kana', 'cp932', 'ascii', 1, '48 65 6c 6c 6f 57 6f 72 6c 64 b6 c0 b6 c5 00', [(0, 'HelloWorld\uff76\uff80\uff76\uff85')]),
    ('cp932_kanji', 'cp932', 'ascii', 1, '8c e1 94 79 82 cd 94 4c 82 c5 82 a0 82 e9 00', [(0, '\u543e\u8f29\u306f\u732b\u3067\u3042\u308b')]),
    ('cp932_invalid', 'cp932', 'ascii', 1, '41 42 ff 43 44 fc 80 45 46 00', [(0, 'AB'), (3, 'CD'), (7, 'EF')]),
    ('cp932_trunc', 'cp932', 'ascii', 1, '41 42 82', [(0, 'AB')]),
    ('cp932_ambig', 'cp932', 'ascii', 1, '81 81 82 a0 82 e9 82 e9', [(0, '\uff1d\u3042\u308b\u308b')]),
    ('gbk_off', 'gbk', 'ascii', 1, '00 00 00 d6 d0 ce c4 00', [(3, '\u4e2d\u6587')]),
    ('gbk_min', 'gbk', 'ascii', 3, 'd6 d0 ce c4 00 d6 d0 ce c4 b2 e2 ca d4 00', [(5, '\u4e2d\u6587\u6d4b\u8bd5')]),
    ('euckr', 'euc-kr', 'ascii', 1, 'c7 d1 b1 b9 be ee c5 d7 bd ba c6 ae 00', [(0, '\ud55c\uad6d\uc5b4\ud14c\uc2a4\ud2b8')]),
    ('big5', 'big5', 'ascii', 1, 'c1 63 c5 e9 a4 a4 a4 e5 b4 fa b8 d5', [(0, '\u7e41\u9ad4\u4e2d\u6587\u6e2c\u8a66')]),
    ('gb_four', 'gb18030', 'ascii', 1, '81 30 84 36 81 30 84 36 81 30 84 36 81 30 84 36 00', [(0, '\xa5\xa5\xa5\xa5')]),
    ('gb_astral', 'gb18030', 'ascii', 5, '41 42 43 44 90 30 81 30 00', [(0, 'ABCD\U00010000')]),
    ('gb_last', 'gb18030', 'ascii', 1, '41 41 41 41 e3 32 9a 35 42 42 42 42 00', [(0, 'AAAA\U0010ffffBBBB')]),
    ('gb_off', 'gb18030', 'ascii', 1, '00 00 81 30 84 36 41 42 43 00 57 58 59 5a 00', [(2, '\xa5ABC'), (10, 'WXYZ')]),
    ('gb_trunc', 'gb18030', 'ascii', 1, '41 42 43 44 81 30 84', [(0, 'ABCD')]),
    ('iso_mixed', 'iso2022-jp', 'ascii', 1, '41 42 1b 24 42 46 7c 4b 5c 1b 28 42 43 44', [(0, 'AB\u65e5\u672cCD')]),
    ('iso_lead_esc', 'iso2022-jp', 'ascii', 1, '00 00 1b 24 42 46 7c 4b 5c 00', [(2, '\u65e5\u672c')]),
    ('iso_trail_esc', 'iso2022-jp', 'ascii', 1, '41 42 1b 24 42 46 7c 4b 5c 1b 28 42', [(0, 'AB\u65e5\u672c')]),
    ('iso_leak', 'iso2022-jp', 'ascii', 1, '1b 24 42 46 7c 00 4b 5c', [(0, '\u65e5'), (6, 'K\\')]),
    ('iso_tail', 'iso2022-jp', 'ascii', 1, '1b 24 42 46 7c 4b', [(0, '\u65e5')]),
]
