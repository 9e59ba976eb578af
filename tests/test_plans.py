import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glyphvein.__main__ import main
from glyphvein.encodings import ENCODINGS
from glyphvein.functions import expressions as x
from glyphvein.operators.scan import merged, scan
from glyphvein.plans import queries as core
from glyphvein.plans.extract import Options, chunks, extract, found, scanned, shuffled, told_lines
from glyphvein.sources.chunks import ranged
from glyphvein.sources.lines import write_file
from glyphvein.streaming.scan import binary_files, scan_stream

SF = "/root/testdata/sf0.001"
GIB = 1 << 30


def test_sizes():
    assert [x.parse_size(s) for s in ("12", " 4k ", "3M", "2g", "1T")] == [12, 4096, 3 << 20, 2 << 30, 1 << 40]
    for wrong in ("", "  ", "k", "1X", "-1", "20000000T"):
        with pytest.raises(ValueError):
            x.parse_size(wrong)
    assert [x.auto_chunk_size(int(5.5 * GIB), j) >> 20 for j in (4, 8, 16)] == [128, 64, 32]
    assert [x.auto_chunk_size(n, 8) >> 20 for n in (0, 1 << 20, 10 * GIB, 100 * GIB, 100 << 40)] == [16, 16, 128, 256, 256]
    assert [x.auto_chunk_size(n << 20, j) >> 20 for n, j in ((256, 16), (62, 32), (1, 0))] == [16, 16, 16]
    assert [x.format_bytes(n) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 40)] == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "5.00 MiB", "3072.00 GiB"]


def test_size_columns_agree(spark):
    rows = spark.createDataFrame([(int(n), j) for n in (0, 1 << 20, 62 << 20, 256 << 20, 5.5 * GIB, 100 * GIB, 100 << 40) for j in (0, 1, 7, 16, 32)], "n long, j long")
    for r in rows.select("n", "j", x.auto_chunk_size_column(F.col("n"), F.col("j")).alias("c"), x.format_bytes_column(F.col("n")).alias("f")).collect():
        assert (r.c, r.f) == (x.auto_chunk_size(r.n, r.j), x.format_bytes(r.n))
    said = spark.createDataFrame([(s,) for s in ("12", " 4k ", "3M", "1T", "", "k", "1X")], "s string")
    assert [r[0] for r in said.select(x.parse_size_column(F.col("s")).cast("long")).collect()] == [12, 4096, 3 << 20, 1 << 40, None, None, None]


def test_lines(spark):
    rows = spark.createDataFrame([("18446744073709551615", "ASCII", "hello"), ("12", "UTF8", "x")], "o string, e string, t string")
    got = [r[0] for r in rows.select(x.line(F.col("o").cast("decimal(20,0)"), F.col("e"), F.col("t"))).collect()]
    assert got == ["18446744073709551615\tASCII\thello", "00000000000000000012\tUTF8\tx"]


def test_extract_command_and_errors(spark, tmp_path, capsys):
    file = tmp_path / "in.bin"
    file.write_bytes(b"\x00" * 7 + b"first text\x00" + "wide text".encode("utf-16-le") + b"\xff\xfe" * 40 + b"tail")
    expected = [(7, "first text"), (16, "twide text"), (116, "tail")]
    for size in (None, "2", "16", "1K"):
        rows = extract(spark, str(file), Options(chunk_size=size)).collect()
        assert [(r.offset, r.text) for r in rows] == expected, size
    out = tmp_path / "out.txt"
    assert main([str(file), "-o", str(out), "--stats", "-c", "8"], spark) == 0
    assert out.read_text() == "".join(f"{o:020d}\t{e}\t{t}\n" for (o, t), e in zip(expected, ("ASCII", "UTF16LE", "ASCII"), strict=True))
    assert "ASCII (ascii): found 2" in capsys.readouterr().err
    assert main([str(file), "-d", str(tmp_path / "lines"), "-vv", "-c", "16"], spark) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))) == out.read_text()
    told = capsys.readouterr().err
    assert "found 2, scanned 3" in told and "8 chunks, chunk size 16 B" in told and "input 120 B" in told
    assert not list(tmp_path.glob("lines-*"))
    assert main([str(file), "-s", "-o", str(out), "-m", "5"], spark) == 0
    assert out.read_text() == "first text\ntwide text\n"
    (tmp_path / "empty").write_bytes(b"")
    assert main([str(tmp_path / "empty")], spark) == 1
    assert main([str(file), "-m", "0"], spark) == 1
    assert found(extract(spark, str(file))).count() == 2
    few, many = (shuffled(chunks(spark, str(file), Options(chunk_size=c)), Options()).agg(F.sum("pieces")).first()[0] or 0 for c in ("1K", "4"))
    assert few < many
    few, many = (scanned(chunks(spark, str(file), Options(chunk_size=c)), Options()).agg(F.sum("scanned")).first()[0] for c in ("1K", "4"))
    assert few == 3 < many


def test_command_details(spark, tmp_path, capsysbinary, monkeypatch):
    """Standard output, ends of lines, statistics only where asked for, Ctrl+C, folders and what is no file."""
    import glyphvein.__main__ as command

    file = tmp_path / "in.bin"
    file.write_bytes(b"\x00first text\x00second text\xff")
    assert main([str(file), "-s"], spark) == 0
    told = capsysbinary.readouterr()
    assert told.out == b"first text\nsecond text\n" and not [x for x in told.err.splitlines() if b"found" in x]
    assert main([str(file), "-v"], spark) == 0
    told = capsysbinary.readouterr()
    assert told.out.startswith(b"00000000000000000001\tASCII\tfirst text\n") and b"found 2" in told.err and b"scanned" not in told.err
    texts, counted = told_lines(spark, str(file), Options(), eol="\r\n")
    with open(tmp_path / "out", "wb") as out:
        write_file(texts, out, str(tmp_path / "out"), eol="\r\n")
    assert (tmp_path / "out").read_bytes() == b"00000000000000000001\tASCII\tfirst text\r\n00000000000000000012\tASCII\tsecond text\r\n"
    assert counted().found == {"ascii": 2, "utf16le-ascii": 0} and counted().size == 24 and counted().chunks == 1
    monkeypatch.setattr(command, "told_lines", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert main([str(file)], spark) == 1 and b"cancelled by Ctrl+C" in capsysbinary.readouterr().err
    monkeypatch.undo()
    (tmp_path / "sub" / "inner").mkdir(parents=True)
    assert main([str(tmp_path / "sub")], spark) == 1 and b"not a regular file" in capsysbinary.readouterr().err
    assert main([str(tmp_path / "nothing")], spark) == 1


def test_a_tables_own_files(spark):
    got = core.extract_lineitem_file(spark, SF)
    data = open(f"{SF}/lineitem.parquet", "rb").read()
    whole = spark.createDataFrame([("lineitem.parquet", bytearray(data))], "path string, bytes binary")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in merged(scan(whole, "ascii,utf16le-ascii,utf8")).collect()]


def test_ranges_give_the_runs_of_the_whole(spark, tmp_path):
    """Each encoding, by path and by URI, at sizes that cut characters, escapes and units."""
    parts = [b"abcd", b"\x00", "日本語".encode(), b"\x1b$BF|K\\\x1b(B", b"H\x00i\x00!\x00", b"\x81\x30\x84\x36", b"\x88b", "猫犬".encode("utf-16-le"), b"\xff\xfe\xff"]
    data = b"".join(parts[k] for k in np.random.default_rng(3).integers(0, len(parts), 400))
    file = tmp_path / "in.bin"
    file.write_bytes(data)
    names = tuple(e.name for e in ENCODINGS)
    whole = spark.createDataFrame([("", bytearray(data))], "path string, bytes binary")
    key = lambda rows: sorted((r.encoding_code, r.offset, r.cb, r.text) for r in rows)
    expected = key(scan(whole, names, "ascii,kanji", 2).collect())
    for size, path in (("64", str(file)), ("142", f"file://{file}")):
        runs = extract(spark, path, Options(names, ("ascii", "kanji"), 2, chunk_size=size))
        assert key(runs.collect()) == expected
        rows = runs.collect()
        assert [(r.offset, r.encoding_code) for r in rows] == sorted((r.offset, r.encoding_code) for r in rows)
        assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()


def test_files_come_in_order(spark, tmp_path, monkeypatch):
    """Runs of several files and encodings, by slabs and ranges of a few bytes, in the order of a sort; none is lost or doubled."""
    rng = np.random.default_rng(8)
    parts = [b"abcd", b"some words ", b"\x00", b"\n", "日本語".encode(), "wide text".encode("utf-16-le"), b"\xff\xfe", b"x" * 300, "猫犬".encode("utf-16-le") * 90]
    (tmp_path / "in").mkdir()
    values = {f"f{i}": b"".join(parts[k] for k in rng.integers(0, len(parts), 120)) for i in range(3)}
    for name, data in values.items():
        (tmp_path / "in" / name).write_bytes(data)
    names = ("ascii", "utf16le-ascii", "utf16le", "utf8", "cp932")
    whole = spark.createDataFrame([(f"{tmp_path}/in/{k}", bytearray(v)) for k, v in values.items()], "path string, bytes binary")
    expected = [tuple(r) for r in merged(scan(whole, names, "ascii,kanji", 3)).collect()]
    for size in ("32", "64", "500", "1M"):
        assert [tuple(r) for r in extract(spark, f"{tmp_path}/in", Options(names, ("ascii", "kanji"), 3, chunk_size=size)).collect()] == expected, size
    with pytest.raises(ValueError):
        Options(("utf16le",), chunk_size="3")


def test_ranges_advance_together(tmp_path, monkeypatch):
    """Scanners whose slabs end at different places: what is handed on is in order, and as much as the whole holds."""
    from glyphvein.operators import runs as found
    from glyphvein.sources import chunks as source

    data = b"".join([b"abcdef\x00", b"\x00", "wide".encode("utf-16-le"), b"\xff" * 5, "日本".encode()][k] for k in np.random.default_rng(4).integers(0, 5, 300))
    file = tmp_path / "in"
    file.write_bytes(data)
    own = [found.Scanner(n, ("ascii",), 2) for n in ("ascii", "utf16le-ascii", "utf8")]
    read = lambda lo, n: [(int(o), int(c)) for p in source.range_runs(source._opened(part(lo, n)), part(lo, n), own, source.Counters(3)) for o, c in zip(p.offset, p.code)]
    part = lambda lo, n: source.ByteRange(str(file), lo, n, len(data))
    expected = read(0, len(data))
    assert expected == sorted(expected) and len(expected) > 150
    for slab, beside, size in ((16, 8, 50), (64, 4, 16), (7, 1 << 16, 2)):
        monkeypatch.setattr(found, "SLAB", slab)
        monkeypatch.setattr(source, "BESIDE", beside)
        assert [r for lo in range(0, len(data), size) for r in read(lo, min(size, len(data) - lo))] == expected


def _mounted(spark, folder):
    """A path to a local folder that only Spark's readers open."""
    store = f"store{abs(hash(str(folder)))}"  # file systems are kept by name
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./in", f"file://{folder}")
    path = f"viewfs://{store}/in"
    assert not ranged(path)
    return path


def test_files_of_any_store(spark, tmp_path):
    """Bytes come back from lines at their places: marks, line ends of all kinds, files with and without a last line feed, ranges of a few bytes."""
    rng = np.random.default_rng(6)
    parts = [b"\n", b"\r\n", b"\r", b"some text", b"\x00", "日本語".encode(), "wide\n".encode("utf-16-le"), b"\xef\xbb\xbf", b"\x1b$BF|", bytes(range(256))]
    values = {f"f{i}": b"".join(parts[k] for k in rng.integers(0, len(parts), 150)) for i in range(4)}
    values |= {"mark": b"\xef\xbb\xbfafter a mark\nmore", "mark2": b"\xef\xbb\xbf\n", "only": b"\xef\xbb\xbf", "feed": b"\n", "none": b"no line feed", "wide": "\ufeffwide text\nand more\u0a0a\u0a41 text".encode("utf-16-le")}
    for name, data in values.items():
        (tmp_path / name).write_bytes(data)
    path = _mounted(spark, tmp_path)
    names, filters = tuple(e.name for e in ENCODINGS), ("ascii", "kanji", "printable")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
    try:
        chunks_ = chunks(spark, path, Options(names, filters, 2)).collect()
        runs = [tuple(r) for r in extract(spark, path, Options(names, filters, 2)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = {}
    for r in sorted(chunks_, key=lambda r: (r.path, r.chunk_off)):
        name = r.path.rsplit("/", 1)[1]
        assert r.chunk_off == len(back.get(name, b"")) and r.file_len == len(values[name])
        back[name] = back.get(name, b"") + bytes(r.bytes)
    assert back == values and len(chunks_) > 100
    whole = spark.createDataFrame([(f"{path}/{k}", bytearray(v)) for k, v in values.items()], "path string, bytes binary")
    assert runs == [tuple(r) for r in merged(scan(whole, names, filters, 2)).collect()]
    out = tmp_path.parent / "store.txt"
    assert main([path, "-s", "-m", "9", "-o", str(out)], spark) == 0
    assert out.read_text().split("\n")[:-1] == [r[-1] for r in (tuple(r) for r in merged(scan(whole, min_length=9)).collect())]
    (tmp_path / "x.gz").write_bytes(b"\x1f\x8bnot really packed")
    assert "not really packed" in {r.text for r in extract(spark, path).collect()}
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError):
        extract(spark, path)


def test_a_file_beyond_two_gib(spark, tmp_path):
    """Sparse in the file system, so that it costs no disk: lines of zeros of 4 MiB, with text at their ends."""
    step, n = 4 << 20, 520
    with open(tmp_path / "large", "wb") as file:
        for k in range(n):
            file.seek((k + 1) * step - 9)
            file.write(b"text%03d!\n" % k)
    rows = extract(spark, _mounted(spark, tmp_path), Options(("ascii",))).collect()
    assert [(r.offset, r.text) for r in rows] == [((k + 1) * step - 9, f"text{k:03d}!") for k in range(n)] and n * step > 2 << 30


def test_scans_do_not_shuffle(spark):
    for name in ("scan_ascii_documents", "scan_utf16le_printable", "scan_cp932_documents", "merge_encodings", "scan_utf8_documents"):
        plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1, name
    plan = core.queries()["chunked_ascii_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(path#\d+, encoding_code#\d+, bucket#", plan) and plan.count("Exchange") == plan.count("FileScan") == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"\x00some text\x00more text")
    scan_stream(binary_files(spark, str(tmp_path / "in")), lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r.text for r in spark.read.parquet(f"{tmp_path}/out/0").collect()} == {"some text", "more text"}


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    got = core.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "part", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(core.oracle_sql()[name])
    columns = sorted(d[0] for d in wanted.description)
    assert sorted(got.columns) == columns
    rows = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({core.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.oracle_sql()) <= set(core.queries()) <= set(__spark_entry__.queries())
