"""python -m glyphvein INPUT: lines of readable text in a file."""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from glyphvein.encodings import BY_NAME
from glyphvein.functions.expressions import format_bytes
from glyphvein.plans.extract import Options, Told, told_lines
from glyphvein.sources.chunks import input_files, range_size
from glyphvein.sources.lines import write_file, write_lines

TAG = "glyphvein"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphvein", description="Extract readable text from binary data.")
    p.add_argument("input")
    p.add_argument("-s", "--string-only", action="store_true", help="text without offset and encoding")
    p.add_argument("-o", "--output", help="file to write; standard output otherwise")
    p.add_argument("-d", "--output-dir", help="folder of ordered text files, written by the tasks")
    p.add_argument("-e", "--encoding", action="append", help="encodings, comma-separated or repeated")
    p.add_argument("-f", "--filter", action="append", help="character filters, comma-separated or repeated")
    p.add_argument("-m", "--min-length", type=int, default=4)
    p.add_argument("-j", "--jobs", type=int, default=0)
    p.add_argument("-c", "--chunk-size")
    p.add_argument("--stats", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    began = time.time()
    try:
        options = Options(tuple(args.encoding or Options.encodings), tuple(args.filter or Options.filters), args.min_length, args.jobs, args.chunk_size)
        spark = spark or SparkSession.builder.appName("glyphvein").getOrCreate()
        spark.addTag(TAG)
        texts, told = told_lines(spark, args.input, options, args.string_only)
        if args.output_dir:
            write_lines(texts, args.output_dir)
        elif args.output:
            with open(args.output, "wb") as out:
                write_file(texts, out, args.output)
        else:
            write_file(texts, sys.stdout.buffer)
            sys.stdout.buffer.flush()
        if args.stats or args.verbose:
            report(spark, args, options, told(), time.time() - began)
    except KeyboardInterrupt:
        spark.interruptTag(TAG)
        print("error: cancelled by Ctrl+C", file=sys.stderr)
        return 1
    except (ValueError, EOFError, OSError, AnalysisException) as e:  # the last where Spark's readers find no such path
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


def report(spark: SparkSession, args: argparse.Namespace, options: Options, told: Told, elapsed: float) -> None:
    """What was found and done, to standard error. The tasks counted it while they wrote the lines."""
    jobs = options.jobs or spark.sparkContext.defaultParallelism
    say = lambda text: print(text, file=sys.stderr)
    for name in options.encodings:
        more = f", scanned {told.scanned[name]}, {told.seconds[name]:.3f} s of tasks" if args.verbose > 1 and told.scanned else ""
        say(f"{BY_NAME[name].label} ({name}): found {told.found[name]}{more}")
    if told.size:
        sizes = {range_size(size, options.chunk_size, jobs) for _, size in input_files(args.input)}
        say(f"input {format_bytes(told.size)}, {told.chunks} chunks, chunk size {' to '.join(format_bytes(n) for n in sorted({min(sizes), max(sizes)}))}, {told.size / elapsed / (1 << 20):.1f} MiB/s")
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss << 10
    say(f"{jobs} workers, {elapsed:.2f} s, driver's peak memory {format_bytes(peak)}")


if __name__ == "__main__":
    sys.exit(main())
