"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.encodings import BY_NAME
from glyphvein.functions import codecs, expressions, filters
from glyphvein.functions.regex import ranges
from glyphvein.operators.classes import class_counts
from glyphvein.operators.runs import RUN_FIELDS
from glyphvein.operators.scan import scan
from glyphvein.operators.stitch import scan_chunks
from glyphvein.plans.extract import Options, extract, found
from glyphvein.plans.functions import register
from glyphvein.sources.chunks import charset, charset_values, column_values, cut, texts
from glyphvein.sources.lines import lines, shared_folder
from glyphvein.streaming.chunks import scan_chunk_stream

DOUBLE = ("cp932", "gbk", "euc-kr", "big5", "gb18030")

#: table -> key and text expressions, the same in Spark and in the SQL.
TABLES = {
    "documents": ("CAST(doc_id AS STRING)", "text"),
    "pages": ("CAST(page_id AS STRING)", "html"),
    "conversations": ("concat_ws('/', CAST(conv_id AS STRING), CAST(turn AS STRING))", "text"),
    "part": ("CAST(p_partkey AS STRING)", "p_name"),
    "customer": ("CAST(c_custkey AS STRING)", "c_name"),
}


def _values(spark: SparkSession, sf_dir: str, name: str, charset: str = "UTF-8") -> DataFrame:
    key, text = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(f"{key} AS key", f"{text} AS text")
    return column_values(rows, "key", "text", charset)


def _scan(name: str, encoding: str, filter_: str = "ascii", least: int = 4, charset: str = "UTF-8"):
    return lambda spark, sf_dir: scan(_values(spark, sf_dir, name, charset), encoding, filter_, least)


ASCII = r"\t\x20-\x7E"
LATIN1 = ASCII + r"\x{A0}-\x{FF}"
#: Admitted characters of UTF-8.
TEXT = r"\t\x20-\x7E\x{A0}-\x{2027}\x{202A}-\x{10FFFF}"


def _runs_sql(name: str, encoding: str, cls: str = ASCII, least: int = 4, unit: str = "strlen({})") -> str:
    """Runs of a character class, offsets summed over all tokens before; unit: bytes of a token."""
    key, text = TABLES[name]
    e = BY_NAME[encoding]
    size = unit.format("tok")
    return f"""
        WITH tokens AS (SELECT {key} AS path, regexp_extract_all({text}, '[{cls}]+|[^{cls}]+') AS toks FROM {name}),
        each AS (SELECT path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens),
        placed AS (SELECT path, tok, sum({size}) OVER (PARTITION BY path ORDER BY i) - {size} AS place FROM each)
        SELECT path, CAST(place AS BIGINT) AS "offset", CAST({e.code} AS SMALLINT) AS encoding_code, '{e.label}' AS encoding,
            CAST({size} AS BIGINT) AS cb, CAST(length(tok) AS BIGINT) AS cch, tok AS text
        FROM placed WHERE length(tok) >= {least} AND regexp_matches(tok, '^[{cls}]')"""


def _union(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(scan(_values(spark, sf_dir, "documents"), "ascii")).select("path", "line")


def string_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(scan(_values(spark, sf_dir, "documents"), "ascii", "ascii", 8), string_only=True).select("path", "line")


def merge_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_values(spark, sf_dir, "documents"), "ascii,utf8,iso2022-jp")


def found_by_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(merge_encodings(spark, sf_dir))


def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = scan(_values(spark, sf_dir, "documents"), "utf8")
    return runs.orderBy(F.desc("cb"), "path", "offset").limit(50).select("path", "offset", "cb", "cch")


def _chunked(encoding: str, size: int, name: str = "documents", charset: str = "UTF-8"):
    return lambda spark, sf_dir: scan_chunks(cut(_values(spark, sf_dir, name, charset), size), encoding)


def table_function_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan as SQL calls it."""
    _values(spark, sf_dir, "documents").createOrReplaceTempView("glyphvein_values")
    register(spark, "glyphvein_text_runs")
    return spark.sql("SELECT * FROM glyphvein_text_runs(TABLE(glyphvein_values), 'ascii,utf8', 'ascii', min_length => 6)")


def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, dealt at random to the files of a stream that is read a third at a time: runs over micro-batches."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    chunks = cut(_values(spark, sf_dir, "documents"), 2048).drop("lookahead")
    chunks.repartition(12, F.xxhash64("path", "chunk_off")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    runs = scan_chunk_stream(spark, stream, "utf8")
    runs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(runs.schema).parquet(f"{folder}/out")


def extract_lineitem_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in the bytes of a table's files themselves, by ranges, in output order."""
    runs = extract(spark, f"{sf_dir}/lineitem.parquet", Options(("ascii", "utf16le-ascii", "utf8"), chunk_size="1M"))
    return runs.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), *RUN_FIELDS)


# ---------------------------------------------------------------- text in other charsets

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What the letters of the documents are replaced by, so that their text is one of the charset's own: (codec, characters of two bytes, of four, filter).
OWN = {
    "cp932": ("cp932", "あいうえおカキクケコ吾輩猫名前無表示能能予申ｱｲｳｴ"[:26], "", "ascii"),
    "gbk": ("gb18030", "的一是不了人我在有他这为之大来以个中上们到说国和地也", "", "ascii"),
    "euc-kr": ("cp949", "가나다라마바사아자차카타파하갂갃똠뷁한국어테스트글말", "", "ascii"),
    "big5": ("big5hkscs", "的一是不了人我在有他這為功許蓋之大來以個中上們到說國", "", "ascii"),
    "gb18030": ("gb18030", "的一是不了人我在有他这为之大来以个中上们", "ÀÑ𠀀😀ĀŁ", "ascii"),
    "windows-1251": ("cp1251", "абвгдежзийклмнопрстуфхцчшщ", "", "ascii,cyrillic"),
    "iso2022-jp": ("iso2022_jp", "あいうえおカキクケコ吾輩猫名前無表示能化予申十百千万", "", "ascii"),
}
#: Readings at the other alignment of these are of the same kind.
WIDE = "乏乎乍乐乑亂亃亄亅了于亏五井亖亗亘亙亚些亜亝亞亟云亓"


def kept(encoding: str) -> tuple[str, str]:
    """The Latin letters beyond ASCII that a charset has, by their two and by their four bytes: documents keep these."""
    codec = OWN[encoding][0]
    pairs = codecs.pair_table(encoding) if encoding in DOUBLE else {}
    found: dict[int, list[str]] = {2: [], 4: []}
    for c in map(chr, [*range(0xA1, 0xAD), *range(0xAE, 0x180)]):
        raw = c.encode(codec, "ignore")
        if pairs.get(raw) == c or encoding == "gb18030" and len(raw) == 4:
            found[len(raw)].append(c)
    return "".join(found[2]), "".join(found[4])


def _shown(text: str, letters: str, every: str = "", own: str = "") -> str:
    """Text with its ASCII letters replaced, and of other characters those of its own that stay; every: the flag of a replacement of all matches, which Spark needs not."""
    return f"translate(regexp_replace({text}, '[^\\t\\n -~{own}]', ''{every}), '{LETTERS}', '{letters}')"


def _shown_as(encoding: str) -> tuple[str, str, str, str]:
    codec, two, four, _ = OWN[encoding]
    return codec, LETTERS, two + four, "".join(kept(encoding))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = TABLES["documents"]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{key} AS key", f"{text} AS text")


def _scan_own(encoding: str):
    """Texts are put into the charset and scanned in one pass of the same worker."""
    return lambda spark, sf_dir: scan(texts(_documents(spark, sf_dir), "key", "text"), encoding, OWN[encoding][3], coded=charset(*_shown_as(encoding)))


def _chunked_own(encoding: str, size: int):
    return lambda spark, sf_dir: scan_chunks(cut(charset_values(_documents(spark, sf_dir), "key", "text", *_shown_as(encoding)), size), encoding, OWN[encoding][3])


def _count(token: str, cls: str) -> str:
    return f"length(regexp_replace({token}, '[^{cls}]', '', 'g'))" if cls else "0"


def _own_sql(encoding: str) -> str:
    """Runs of ASCII and the charset's own characters; sizes by how many bytes each has."""
    _, two, four, _ = OWN[encoding]
    key, text = TABLES["documents"]
    e, single = BY_NAME[encoding], encoding == "windows-1251"
    two, four = (a + b for a, b in zip((two, four), kept(encoding), strict=True))
    double = "" if single else "".join(c for c in two if not "｡" <= c <= "ﾟ")
    cls = ASCII + two + four
    size = f"(length(tok) + {_count('tok', double)} + 3 * {_count('tok', four)})"
    cb = size
    if encoding == "iso2022-jp":  # each stretch of two-byte characters stands between escapes, the last of which is no part of a run
        size = f"({size} + 6 * len(regexp_extract_all(tok, '[{double}]+')))"
        cb = f"({size} - CASE WHEN regexp_matches(tok, '[{double}]$') THEN 3 ELSE 0 END)"
    shown = _shown(text, "".join(OWN[encoding][1:3]), ", 'g'", "".join(kept(encoding)))
    return f"""
        WITH tokens AS (SELECT {key} AS path, regexp_extract_all({shown}, '[{cls}]+|[^{cls}]+') AS toks FROM documents),
        each AS (SELECT path, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tokens),
        placed AS (SELECT path, tok, sum({size}) OVER (PARTITION BY path ORDER BY i) - {size} AS place FROM each)
        SELECT path, CAST(place AS BIGINT) AS "offset", CAST({e.code} AS SMALLINT) AS encoding_code, '{e.label}' AS encoding,
            CAST({cb} AS BIGINT) AS cb, CAST(length(tok) AS BIGINT) AS cch, tok AS text
        FROM placed WHERE length(tok) >= 4 AND regexp_matches(tok, '^[{cls}]')"""


def scan_utf16le_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text whose bytes are kanji at either alignment: one reading of each place stays."""
    key, text = TABLES["documents"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{key} AS key", f"{_shown(text, WIDE)} AS text")
    return scan(column_values(rows, "key", "text", "UTF-16LE"), "utf16le", "ascii,kanji")


def _wide_sql(shown: str, admitted: str) -> str:
    """Units at both alignments, islands of admitted ones, and of two that share a byte the one that stays."""
    key = TABLES["documents"][0]
    return f"""
        WITH chars AS (SELECT {key} AS path, regexp_extract_all({shown}, '(?s).') AS cs FROM documents),
        c AS (SELECT path, ord(unnest(cs)) AS u, generate_subscripts(cs, 1) - 1 AS k FROM chars),
        units AS (SELECT path, k, 0 AS parity, u FROM c
            UNION ALL SELECT path, k, 1, (u >> 8) | ((lead(u) OVER (PARTITION BY path ORDER BY k) & 255) << 8) FROM c),
        ok AS (SELECT *, k - row_number() OVER (PARTITION BY path, parity ORDER BY k) AS g FROM units WHERE u = 9 OR u BETWEEN 32 AND 126 OR {admitted}),
        runs AS (SELECT path, parity, g, 2 * min(k) + parity AS place, 2 * count(*) AS cb, count(*) AS cch, string_agg(chr(CAST(u AS INTEGER)), '' ORDER BY k) AS text, bool_and(u < 127) AS plain FROM ok GROUP BY path, parity, g),
        size AS (SELECT path, 2 * len(cs) AS total FROM chars),
        able AS (SELECT r.* FROM runs r JOIN size USING (path) WHERE cch >= 4 OR place = parity OR place + cb >= total),
        shared AS (SELECT DISTINCT path, e.g AS g, o.g AS h FROM ok e JOIN ok o USING (path, k) WHERE e.parity = 0 AND o.parity = 1
            UNION SELECT e.path, e.g, o.g FROM ok e JOIN ok o ON e.path = o.path AND e.k = o.k + 1 WHERE e.parity = 0 AND o.parity = 1),
        met AS (SELECT a.path, CASE WHEN a.plain AND NOT b.plain OR a.plain = b.plain AND a.cb >= b.cb THEN b.place ELSE a.place END AS place
            FROM shared s JOIN able a ON a.path = s.path AND a.parity = 0 AND a.g = s.g JOIN able b ON b.path = s.path AND b.parity = 1 AND b.g = s.h)
        SELECT path, CAST(place AS BIGINT) AS "offset", CAST(2 AS SMALLINT) AS encoding_code, 'UTF16LE' AS encoding, CAST(cb AS BIGINT) AS cb, CAST(cch AS BIGINT) AS cch, text
        FROM runs WHERE cch >= 4 AND NOT EXISTS (SELECT 1 FROM met WHERE met.path = runs.path AND met.place = runs.place)"""


_PRINTABLE = "u BETWEEN 160 AND 55295 OR u BETWEEN 63744 AND 64975 OR u BETWEEN 65008 AND 65533"
_KANJI = "u BETWEEN 13312 AND 19903 OR u BETWEEN 19968 AND 40959"

# ---------------------------------------------------------------- character classes

#: Two letters of each kind: Latin-1, Cyrillic, kanji of three sorts and beyond the BMP, hiragana, katakana, Hangul, punctuation, and what none but the widest admit.
KINDS = "éßжЩ亜弌丂𠀀𪛖あゟカ・한ㄱ、（〄￠αÿ"


def _class(name: str, form: str) -> str:
    admitted = filters.table((name,)).nonzero()[0].tolist()
    return "".join(form.format(a) + "-" + form.format(b) for a, b in ranges(admitted))


def characters_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters each filter admits of each document, some of whose letters are replaced by characters of all kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"translate(coalesce(text, ''), '{LETTERS[: len(KINDS)]}', '{KINDS}') AS text")
    return class_counts(docs, "text")


def _characters_sql() -> str:
    columns = ", ".join(f"CAST(length(regexp_replace(text, '[^{_class(n, '\\x{{{:x}}}')}]', '', 'g')) AS BIGINT) AS {n.replace('-', '_')}" for n in filters.NAMES)
    return f"SELECT doc_id, {columns} FROM (SELECT doc_id, translate(coalesce(text, ''), '{LETTERS[: len(KINDS)]}', '{KINDS}') AS text FROM documents)"


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic chunk size of made-up inputs, one for each order, from its price and key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    length, jobs = (F.col("o_totalprice") * 100000).cast("long"), (F.col("o_orderkey") % 64).cast("long")
    return orders.select("o_orderkey", length.alias("length"), jobs.alias("jobs"), expressions.auto_chunk_size_column(length, jobs).alias("chunk_size"))


_CHUNK_SQL = """
    WITH o AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100000) AS BIGINT) AS length, CAST(o_orderkey % 64 AS BIGINT) AS jobs FROM orders),
    k AS (SELECT *, greatest(jobs, 1) AS j, unnest([24, 25, 26, 27, 28]) AS p FROM o)
    SELECT o_orderkey, any_value(length) AS length, any_value(jobs) AS jobs, CAST(max(CASE WHEN p = 24 OR (length // (j * 8) >= (1 << p) AND ceil(length / (1 << p)) >= j) THEN 1 << p END) AS BIGINT) AS chunk_size
    FROM k GROUP BY o_orderkey"""


def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes parsed from text and written again, one for each line item."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    suffix = F.element_at(F.array(*map(F.lit, ("", "k", "K", "m", "G", "T", "x"))), F.col("l_linenumber") % 7 + 1)
    said = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), suffix)
    rows = items.select("l_orderkey", "l_linenumber", "l_partkey", said.alias("said")).withColumn("parsed", expressions.parse_size_column(F.col("said")).cast("long"))
    rows = rows.withColumn("shown", F.coalesce(expressions.format_bytes_column(F.col("parsed")), F.lit("invalid")))
    return rows.withColumn("parsed", F.coalesce("parsed", F.lit(-1).cast("long")))


_BYTES_SQL = """
    WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity) AS BIGINT) AS q, ['', 'k', 'K', 'm', 'G', 'T', 'x'][l_linenumber % 7 + 1] AS s FROM lineitem),
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, ' ' || CAST(q AS VARCHAR) || s AS said,
        CASE s WHEN '' THEN q WHEN 'k' THEN q * 1024 WHEN 'K' THEN q * 1024 WHEN 'm' THEN q * 1048576 WHEN 'G' THEN q * 1073741824 WHEN 'T' THEN q * 1099511627776 END AS parsed FROM i)
    SELECT l_orderkey, l_linenumber, l_partkey, said, coalesce(parsed, -1) AS parsed, CASE WHEN parsed >= 1073741824 THEN printf('%.2f GiB', parsed / 1073741824) WHEN parsed >= 1048576 THEN printf('%.2f MiB', parsed / 1048576)
        WHEN parsed >= 1024 THEN printf('%.2f KiB', parsed / 1024) WHEN parsed IS NOT NULL THEN CAST(parsed AS VARCHAR) || ' B' ELSE 'invalid' END AS shown FROM p"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found_ = {f"scan_ascii_{t}": _scan(t, "ascii") for t in TABLES}
    found_ |= {f"min_length_m{m}": _scan("documents", "ascii", least=m) for m in (1, 8, 16)}
    found_ |= {
        "scan_utf8_documents": _scan("documents", "utf8"),
        "scan_utf8_pages": _scan("pages", "utf8"),
        "scan_iso2022jp_documents": _scan("documents", "iso2022-jp"),
        "scan_win1251_documents": _scan("documents", "windows-1251"),
        "scan_win1251_cyrillic_documents": _scan_own("windows-1251"),
        "scan_iso2022jp_kanji": _scan_own("iso2022-jp"),
        "scan_utf16le_wide": scan_utf16le_wide,
        "scan_utf16le_ascii_documents": _scan("documents", "utf16le-ascii", charset="UTF-16LE"),
        "scan_utf16le_ascii_latin1": _scan("documents", "utf16le-ascii", "ascii,latin1", charset="UTF-16LE"),
        "scan_utf16le_documents": _scan("documents", "utf16le", charset="UTF-16LE"),
        "scan_utf16le_printable": _scan("documents", "utf16le", "printable", charset="UTF-16LE"),
    }
    found_ |= {f"scan_{e.replace('-', '')}_documents": _scan_own(e) for e in DOUBLE}
    found_ |= {f"scan_{e.replace('-', '')}_part": _scan("part", e) for e in DOUBLE}
    found_ |= {
        "chunked_ascii_documents": _chunked("ascii", 64),
        "chunked_utf8_documents": _chunked("utf8", 64),
        "chunked_utf16le_ascii": _chunked("utf16le-ascii", 128, charset="UTF-16LE"),
        "chunked_iso2022jp_documents": _chunked("iso2022-jp", 128),
        "chunked_gb18030_part": _chunked("gb18030", 6, "part"),
        "chunked_cp932_documents": _chunked_own("cp932", 64),
        "chunked_gb18030_documents": _chunked_own("gb18030", 64),
        "chunked_iso2022jp_kanji": _chunked_own("iso2022-jp", 64),
        "table_function_documents": table_function_documents,
        "streamed_documents": streamed_documents,
        "extract_lineitem_file": extract_lineitem_file,
        "merge_encodings": merge_encodings,
        "line_format": line_format,
        "string_only": string_only,
        "found_by_encoding": found_by_encoding,
        "longest_runs": longest_runs,
        "characters_by_filter": characters_by_filter,
        "chunk_sizes": chunk_sizes,
        "byte_sizes": byte_sizes,
    }
    return found_


def oracle_sql() -> dict[str, str]:
    sql = {f"scan_ascii_{t}": _runs_sql(t, "ascii") for t in TABLES}
    sql |= {f"min_length_m{m}": _runs_sql("documents", "ascii", least=m) for m in (1, 8, 16)}
    wide = "2 * length({})"
    sql |= {
        "scan_utf8_documents": _runs_sql("documents", "utf8", TEXT),
        "scan_utf8_pages": _runs_sql("pages", "utf8", TEXT),
        "scan_iso2022jp_documents": _runs_sql("documents", "iso2022-jp"),
        "scan_win1251_documents": _runs_sql("documents", "windows-1251"),
        "scan_utf16le_ascii_documents": _runs_sql("documents", "utf16le-ascii", unit=wide),
        "scan_utf16le_ascii_latin1": _runs_sql("documents", "utf16le-ascii", LATIN1, unit=wide),
        "scan_utf16le_documents": _runs_sql("documents", "utf16le", unit=wide),
        "scan_utf16le_printable": _wide_sql("text", _PRINTABLE),
        "scan_utf16le_wide": _wide_sql(_shown("text", WIDE, ", 'g'"), _KANJI),
        "scan_win1251_cyrillic_documents": _own_sql("windows-1251"),
        "scan_iso2022jp_kanji": _own_sql("iso2022-jp"),
        "chunked_cp932_documents": _own_sql("cp932"),
        "chunked_gb18030_documents": _own_sql("gb18030"),
        "chunked_iso2022jp_kanji": _own_sql("iso2022-jp"),
        "chunked_ascii_documents": _runs_sql("documents", "ascii"),
        "chunked_utf8_documents": _runs_sql("documents", "utf8", TEXT),
        "chunked_utf16le_ascii": _runs_sql("documents", "utf16le-ascii", unit=wide),
        "chunked_iso2022jp_documents": _runs_sql("documents", "iso2022-jp"),
        "chunked_gb18030_part": _runs_sql("part", "gb18030"),
    }
    sql |= {f"scan_{e.replace('-', '')}_part": _runs_sql("part", e) for e in DOUBLE}
    sql |= {f"scan_{e.replace('-', '')}_documents": _own_sql(e) for e in DOUBLE}
    three = _union(_runs_sql("documents", "ascii"), _runs_sql("documents", "utf8", TEXT), _runs_sql("documents", "iso2022-jp"))
    line = """lpad(CAST("offset" AS VARCHAR), 20, '0') || chr(9) || encoding || chr(9) || text"""
    sql |= {
        "table_function_documents": _union(_runs_sql("documents", "ascii", least=6), _runs_sql("documents", "utf8", TEXT, least=6)),
        "streamed_documents": _runs_sql("documents", "utf8", TEXT),
        "merge_encodings": three,
        "line_format": f"SELECT path, {line} AS line FROM ({_runs_sql('documents', 'ascii')})",
        "string_only": f"SELECT path, text AS line FROM ({_runs_sql('documents', 'ascii', least=8)})",
        "found_by_encoding": f"SELECT encoding_code, encoding, count(*) AS found, CAST(sum(cb) AS BIGINT) AS bytes, max(cch) AS longest FROM ({three}) GROUP BY ALL",
        "longest_runs": f'SELECT path, "offset", cb, cch FROM ({_runs_sql("documents", "utf8", TEXT)}) ORDER BY cb DESC, path, "offset" LIMIT 50',
        "characters_by_filter": _characters_sql(),
        "chunk_sizes": _CHUNK_SQL,
        "byte_sizes": _BYTES_SQL,
    }
    return sql
