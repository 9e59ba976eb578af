"""Fill-in-middle forms of texts that are kept as seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME bytes, with the bytes, characters and units that
come before each: a table in the shared folder, a row a document. The two cuts of a document are found from those sums:
only the frames that hold a cut are decompressed for it. The form's text is written frame by frame in its own order,
and the text is rebuilt from that output alone, by its markers; no step holds a whole decompressed text twice.

A unit is a run of ASCII letters or any other single character. Null texts count as empty, which has no units
and stays plain; a null doc_id hashes as the empty string; repeated rows give equal results; an empty table gives an
empty result. Very long texts make many frames. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm.common import document_text, portions, settled, sha256_hex, stored, table, utf8

#: Bytes of text in a frame, up to the end of a character.
FRAME = 1 << 16
LEVEL = 3
#: Of 100 texts, how many at most get a form that is not plain; of 100 of those, how many have the suffix first.
FORMED, SUFFIX_FIRST = 90, 20
#: What stands before the prefix, the suffix and the middle.
MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
FRAMES_SCHEMA = "doc_id long, frames array<binary>, sizes array<long>, units array<long>, chars array<long>, joined array<boolean>, marked boolean"


def starts(data: np.ndarray, joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which a character; joined: the byte before was a letter."""
    char = data & 0xC0 != 0x80
    letter = _LETTER[data]
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if joined and len(data) and letter[0]:
        unit[0] = False
    return unit, char


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """The worker's own, made once: making them costs more than most frames do."""
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), zstandard.ZstdDecompressor()


class Frames:
    """A text as compressed frames. sizes, units, chars: how many come before each frame, and in all; joined: a letter precedes it."""

    def __init__(self, frames: list[bytes], sizes: np.ndarray, units: np.ndarray, chars: np.ndarray, joined: list[bool]):
        self.frames, self.sizes, self.units, self.chars, self.joined = frames, sizes, units, chars, joined

    @staticmethod
    def of(pieces: Iterator[bytes], frame: int = FRAME) -> Frames:
        """Frames of bytes that come in pieces."""
        frames, sums, joined, held, last = [], [(0, 0, 0)], [], b"", False

        def close(data: bytes) -> None:
            nonlocal last
            v = np.frombuffer(data, np.uint8)
            unit, char = starts(v, last)
            frames.append(_zstd()[0].compress(data))
            joined.append(last)
            sums.append((sums[-1][0] + len(v), sums[-1][1] + int(unit.sum()), sums[-1][2] + int(char.sum())))
            last = bool(_LETTER[v[-1]])

        for piece in pieces:
            held = held + piece if held else piece
            begin = 0
            while len(held) - begin > frame:
                end = begin + frame
                while end < len(held) and held[end] & 0xC0 == 0x80:
                    end += 1
                if end == len(held):
                    break
                close(held[begin:end])
                begin = end
            held = held[begin:]
        if held:
            close(held)
        sizes, units, chars = np.array(sums, np.int64).T
        return Frames(frames, sizes, units, chars, joined)

    def frame(self, k: int) -> bytes:
        return _zstd()[1].decompress(self.frames[k])

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and character at which a unit begins; the end of the text for the number of all units."""
        if unit >= self.units[-1]:
            return int(self.sizes[-1]), int(self.chars[-1])
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        begins, char = starts(np.frombuffer(self.frame(k), np.uint8), self.joined[k])
        at = int(np.flatnonzero(begins)[unit - self.units[k]])
        return int(self.sizes[k]) + at, int(self.chars[k]) + int(char[:at].sum())

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes from begin to end (exclusive), frame by frame."""
        k = int(np.searchsorted(self.sizes, begin, "right")) - 1
        while begin < end:
            data = self.frame(k)
            upto = min(end, int(self.sizes[k + 1]))
            yield data[begin - int(self.sizes[k]) : upto - int(self.sizes[k])]
            begin, k = upto, k + 1

    def find(self, wanted: bytes) -> int:
        """Where wanted first stands, also across frames; -1 where it does not."""
        tail = b""
        for k in range(len(self.frames)):
            data = tail + self.frame(k)
            at = data.find(wanted)
            if at >= 0:
                return int(self.sizes[k]) - len(tail) + at
            tail = data[-(len(wanted) - 1) :]
        return -1


def formed(text: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output for a text whose prefix ends at byte first and whose middle ends at second."""
    size = int(text.sizes[-1])
    if form == "plain":
        yield from text.stream(0, size)
        return
    parts = {"prefix": (0, first), "middle": (first, second), "suffix": (second, size)}
    for name in ORDERS[form]:
        yield MARKERS[name]
        yield from text.stream(*parts[name])


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, rebuilt from the output: parts lie between the markers, which no text with a form holds."""
    size = int(output.sizes[-1])
    if form == "plain":
        yield from output.stream(0, size)
        return
    order = ORDERS[form]
    at = [output.find(MARKERS[name]) for name in order]
    if at[0] != 0 or not at[0] < at[1] < at[2]:
        raise ValueError("markers are missing or out of order")
    parts = {name: (begin + len(MARKERS[name]), end) for name, begin, end in zip(order, at, [*at[1:], size], strict=True)}
    for name in ("prefix", "middle", "suffix"):
        yield from output.stream(*parts[name])


def framed(df: DataFrame, frame: int = FRAME) -> DataFrame:
    """doc_id, frames and their sums, and whether the text holds a marker, of each row of df (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            data, at = utf8(batch.column("text"))
            rows = []
            for k in range(batch.num_rows):
                raw = data[at[k] : at[k + 1]].tobytes()
                rows.append((Frames.of(iter([raw]), frame), any(m in raw for m in MARKERS.values())))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([f.frames for f, _ in rows], pa.list_(pa.binary())), pa.array([f.sizes for f, _ in rows], longs), pa.array([f.units for f, _ in rows], longs),
                    pa.array([f.chars for f, _ in rows], longs), pa.array([f.joined for f, _ in rows], pa.list_(pa.bool_())), pa.array([m for _, m in rows], pa.bool_()),
                ],
                ["doc_id", "frames", "sizes", "units", "chars", "joined", "marked"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), document_text().alias("text")).mapInArrow(run, FRAMES_SCHEMA)


def decided(frames: DataFrame) -> DataFrame:
    """frames with n, form, and the units after which prefix and middle end, from a hash of the doc_id."""
    digest = sha256_hex(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    n = F.element_at("units", -1)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    form = F.when((n == 0) | F.col("marked") | (h[2] % 100 >= FORMED), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return frames.select("*", n.alias("n"), form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def transformed(frames: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of the text rebuilt from it; texts: the output itself as well."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: [] for name in ("prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")}
            for r in range(batch.num_rows):
                own = {name: batch.column(name)[r] for name in ("frames", "sizes", "units", "chars", "joined", "form", "first", "second")}
                text = Frames(own["frames"].as_py(), *(own[c].values.to_numpy() for c in ("sizes", "units", "chars")), own["joined"].as_py())
                form, prefix, middle = own["form"].as_py(), (0, None), (0, None)
                if form != "plain":
                    prefix, middle = text.cut(own["first"].as_py()), text.cut(own["second"].as_py())
                said = hashlib.sha256()
                output = Frames.of(_heard(formed(text, form, prefix[0], middle[0]), said))
                back = hashlib.sha256()
                for piece in restored(output, form):
                    back.update(piece)
                found["prefix_chars"].append(prefix[1])
                found["middle_chars"].append(None if middle[1] is None else middle[1] - prefix[1])
                found["output_sha256"].append(said.hexdigest())
                found["restored_sha256"].append(back.hexdigest())
                if texts:
                    found["output"].append(b"".join(output.stream(0, int(output.sizes[-1]))).decode())
            columns = [batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array(found["prefix_chars"], pa.int64()), pa.array(found["middle_chars"], pa.int64())]
            columns += [pa.array(found[name], pa.string()) for name in ("output_sha256", "restored_sha256", *["output"] * texts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * texts])

    return decided(frames).drop("marked").mapInArrow(run, schema)


def _heard(pieces: Iterator[bytes], digest) -> Iterator[bytes]:
    """pieces, each told to the digest as it passes."""
    for piece in pieces:
        digest.update(piece)
        yield piece


def infilled(df: DataFrame, texts: bool = False) -> DataFrame:
    """transformed() for all rows of df (doc_id, text), by way of a stored table of frames."""
    frames = stored(framed(df), "infill-frames")
    return settled(transformed(frames, texts), "infilled", frames)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilled(table(spark, sf_dir, "documents"))
