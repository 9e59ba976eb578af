import numpy as np
import pytest
from test_scan import _inputs

from glyphvein.operators.scan import scan
from glyphvein.plans.functions import register
from glyphvein.streaming.chunks import scan_chunk_stream

CHUNKS = "path string, chunk_off long, bytes binary, file_len long"


def _sorted(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("names", "filters", "size"), [("ascii,utf8,iso2022-jp", "ascii", 7), ("cp932,gb18030", "ascii", 4), ("utf16le,utf16le-ascii", "ascii,kanji", 5)])
def test_chunks_over_micro_batches(spark, tmp_path, names, filters, size):
    """Chunks shuffled over five micro-batches give the runs of the whole values; nothing stays behind."""
    values = {**_inputs(25, [bytes([0x81, 0xFE])]), "long": b"\x00" + b"abcdef" * 30 + b"\x00tail"}
    rows = [(k, at, bytearray(v[at : at + size]), len(v)) for k, v in values.items() for at in range(0, len(v), size)]
    rows = [rows[i] for i in np.random.default_rng(4).permutation(len(rows))]
    for k in range(5):
        spark.createDataFrame(rows[k::5], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = scan_chunk_stream(spark, stream, names, filters, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in values.items()], "path string, bytes binary")
    assert _sorted(spark.read.parquet(str(tmp_path / "out"))) == _sorted(scan(whole, names, filters, 2))
    assert len([p for p in query.recentProgress if p.numInputRows]) == 5
    assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) == 0


def test_table_function(spark):
    values = spark.createDataFrame([(str(i), bytearray(v), i) for i, v in enumerate(_inputs(60, []).values())] + [("null", None, 0)], "path string, bytes binary, extra int").repartition(3)
    values.createOrReplaceTempView("files")
    register(spark)
    assert _sorted(spark.sql("SELECT * FROM text_runs(TABLE(files))")) == _sorted(scan(values))
    got = spark.sql("SELECT * FROM text_runs(TABLE(files), 'ascii,utf16le', 'ascii,kanji', min_length => 2)")
    assert _sorted(got) == _sorted(scan(values, "ascii,utf16le", "ascii,kanji", 2)) and got.columns == scan(values).columns
    assert spark.sql("SELECT encoding, count(*) AS n FROM text_runs(TABLE(SELECT path, bytes FROM files WHERE path < '3'), 'utf8') GROUP BY encoding").count() == 1
    for wrong in ("TABLE(SELECT path FROM files)", "TABLE(files), 'latin9'", "TABLE(files), 'ascii', 'ascii', 0", "TABLE(files), color => 'red'"):
        with pytest.raises(Exception, match="text_runs|unknown encoding|min-length|analyze"):
            spark.sql(f"SELECT * FROM text_runs({wrong})").collect()
