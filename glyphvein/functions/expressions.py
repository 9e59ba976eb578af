"""Sizes, counts and lines, as Python values and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
LEAST_CHUNK, MOST_CHUNK, CHUNKS_PER_JOB = 16 * MIB, 256 * MIB, 8


def parse_size(text: str) -> int:
    """Bytes of a number with an optional suffix K, M, G or T (powers of 1024, either case)."""
    text = text.strip()
    if not text:
        raise ValueError("empty size")
    found = re.fullmatch(r"\+?([0-9]+)([KMGTkmgt]?)", text)
    if not found:
        raise ValueError(f"invalid size: {text}")
    value = int(found[1]) << {"": 0, "K": 10, "M": 20, "G": 30, "T": 40}[found[2].upper()]
    if value >= 1 << 64:
        raise ValueError(f"size too large: {text}")
    return value


def auto_chunk_size(length: int, jobs: int) -> int:
    """About CHUNKS_PER_JOB chunks a job, a power of two within bounds, smaller while jobs would idle."""
    jobs = max(jobs, 1)
    target = length // (jobs * CHUNKS_PER_JOB)
    size = min(max(1 << (target.bit_length() - 1) if target else LEAST_CHUNK, LEAST_CHUNK), MOST_CHUNK)
    while length and size > LEAST_CHUNK and -(-length // size) < jobs:
        size //= 2
    return size


def parse_size_column(column: Column) -> Column:
    """parse_size() as DECIMAL(20,0); null where it would raise."""
    text = F.trim(column)
    power = F.coalesce(F.element_at(F.create_map(*[x for k, v in (("K", 10), ("M", 20), ("G", 30), ("T", 40)) for x in (F.lit(k), F.lit(v))]), F.upper(F.regexp_extract(text, "([KMGTkmgt])$", 1))), F.lit(0))
    digits = F.regexp_extract(text, r"^\+?([0-9]+)[KMGTkmgt]?$", 1)
    factor = F.element_at(F.create_map(*[x for p in (0, 10, 20, 30, 40) for x in (F.lit(p), F.lit(1 << p))]), power)
    value = F.try_to_number(F.lpad(digits, 20, "0"), F.lit("9" * 20))
    return F.when(digits != "", (value * factor).cast("decimal(38,0)"))


def auto_chunk_size_column(length: Column, jobs: Column) -> Column:
    """auto_chunk_size() over columns: the largest power of two that every rule allows."""
    jobs = F.greatest(jobs, F.lit(1))
    steps = [k for k in range(24, 29)]
    target = F.floor(length / (jobs * CHUNKS_PER_JOB))
    fits = lambda k: ((target >= (1 << k)) | F.lit(k == 24)) & ((F.ceil(length / (1 << k)) >= jobs) | F.lit(k == 24))
    return F.coalesce(*[F.when(fits(k), F.lit(1 << k)) for k in reversed(steps)]).cast("long")


def format_bytes(n: int) -> str:
    """B as a whole number; KiB, MiB, GiB with two decimals."""
    for power, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        if n >= 1 << power:
            return f"{n / (1 << power):.2f} {unit}"
    return f"{n} B"


def format_bytes_column(n: Column) -> Column:
    part = lambda power, unit: F.format_string(f"%.2f {unit}", n / (1 << power))
    return F.when(n >= 1 << 30, part(30, "GiB")).when(n >= 1 << 20, part(20, "MiB")).when(n >= 1 << 10, part(10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def line(offset: Column, label: Column, text: Column) -> Column:
    """A full output line without its end: twenty digits, label, text, joined by tabs."""
    return F.concat_ws("\t", F.lpad(offset.cast("decimal(20,0)").cast("string"), 20, "0"), label, text)
