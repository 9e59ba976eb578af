"""Secret scans over a trigram inverted index.

Each rule is a regular expression. From its parse tree follows a Boolean query over
lower-cased trigrams (an OR of ANDs) that every match must satisfy. Where a stretch of rows is read,
an index of it holds the rows of each trigram that some query names; intersecting the postings
of a clause leaves candidate rows, on which alone the rule's regex runs. A rule without
mandatory trigrams has no query and runs on every row. The index of a stretch is used where it is made:
postings and texts do not leave the task, so nothing is shuffled and no hot key arises.

Null texts count as empty and have no spans. Equal rows get equal spans. New columns
replace columns of the same name; other names do not matter. Offsets are code points, ends exclusive.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphvein.llm.common import portions, table, unused, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose group has fewer than `least` characters are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The first three are the base kinds.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)
BASE = ("assign", "access", "hex")

#: Most strings that one part of a rule may stand for, and most clauses of a query.
_STRINGS, _CLAUSES = 64, 96

#: A query: clauses, each a set of trigrams that all occur. None: nothing is mandatory.
Query = frozenset[frozenset[bytes]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= _CLAUSES else min(a, b, key=len)


def _either(queries: Sequence[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    joined = frozenset(c for q in queries for c in q)
    return joined if len(joined) <= _CLAUSES else None


def _holding(strings: set[bytes]) -> Query:
    """What holds where one of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return None
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _letter(point: int, flags: int) -> set[bytes] | None:
    """The index's form of a character: ASCII is lower-cased, as in the index. None: it may match characters that the index keeps apart."""
    c = chr(point)
    if flags & re.IGNORECASE and not flags & re.ASCII and (not c.isascii() or c in "kKsSiI"):
        return None
    return {(c.lower() if c.isascii() else c).encode()}


def _letters(items: list, flags: int) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, value in items:
        points = [value] if op is C.LITERAL else range(value[0], value[1] + 1) if op is C.RANGE and value[1] - value[0] < 12 else None
        forms = [_letter(p, flags) for p in points] if points is not None else [None]
        if any(f is None for f in forms):
            return None
        found = found.union(*forms)
    return found if len(found) <= 12 else None


def _parts(tree, flags: int) -> tuple[set[bytes] | None, Query]:
    """All strings that a tree stands for, if few; and what holds for its matches."""
    run: set[bytes] | None = {b""}
    whole, query = True, None
    for op, value in tree:
        exact, inner = None, None
        if op is C.LITERAL:
            exact = _letter(value, flags)
        elif op is C.IN:
            exact = _letters(value, flags)
        elif op is C.SUBPATTERN:
            exact, inner = _parts(value[3], (flags | value[1]) & ~value[2])
        elif op is C.BRANCH:
            branches = [_parts(x, flags) for x in value[1]]
            if all(e is not None for e, _ in branches):
                exact = set().union(*(e for e, _ in branches))
            inner = _either([_holding(e) if e is not None else q for e, q in branches])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            once, inner = _parts(body, flags)
            if once is not None and (low, high) in ((0, 1), (1, 1)):
                exact = once | ({b""} if low == 0 else set())
            if low == 0:
                inner = None
            elif once is not None and exact is None and run is not None and len(run) * len(once) <= _STRINGS:
                # the first copy follows what was before, the last one precedes what comes
                query, run, whole = _both(query, _holding({a + b for a, b in product(run, once)})), once, False
                continue
            elif once is not None and exact is None:
                inner = _holding(once)
        elif op is C.AT:
            continue
        joined = None if exact is None or run is None else {a + b for a, b in product(run, exact)}
        if joined is not None and len(joined) <= _STRINGS:
            run = joined
            continue
        query = _both(query, _holding(run))
        whole = False
        if exact is not None and len(exact) <= _STRINGS:
            run = exact
        else:
            query, run = _both(query, inner), {b""}
    if whole:
        return run, _holding(run)
    return None, _both(query, _holding(run))


def trigram_query(pattern: str) -> Query:
    """The clauses of which one must hold in a text (lower-cased by ASCII) that pattern matches in."""
    tree = P.parse(pattern)
    query = _parts(tree, tree.state.flags)[1]
    return None if query is None else frozenset(c for c in query if not any(o < c for o in query))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Index:
    """Postings of the rows of a stretch: (trigram, row), each once, in order."""

    grams: np.ndarray
    rows: np.ndarray
    n: int

    @staticmethod
    def of(texts: pa.Array, known: np.ndarray) -> Index:
        """known: which trigrams are indexed."""
        data, at = utf8(texts)
        low = _LOWER[data].astype(np.uint32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else low[:0]
        place = np.flatnonzero(known[codes])
        row = np.searchsorted(at, place, "right") - 1
        inside = place + 3 <= at[row + 1]
        found = np.unique(codes[place[inside]].astype(np.int64) << 32 | row[inside])
        return Index(found >> 32, found & 0xFFFFFFFF, len(texts))

    def postings(self, gram: int) -> np.ndarray:
        i, j = np.searchsorted(self.grams, [gram, gram + 1])
        return self.rows[i:j]

    def candidates(self, query: Query) -> np.ndarray:
        """Which rows satisfy a query: some clause, all of whose trigrams they have."""
        found = np.zeros(self.n, bool)
        for clause in query:
            rows = None
            for gram in clause:
                own = self.postings(_code(gram))
                rows = own if rows is None else np.intersect1d(rows, own, assume_unique=True)
            found[rows] = True
        return found


def matches(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", into: str = "secret_spans") -> DataFrame:
    """df with an array of (kind, start, end) for each secret, by start, then by the rules' order."""
    df = df.drop(into)
    names = df.columns
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({_code(g) for q in queries if q for clause in q for g in clause})
    schema = T.StructType([*df.schema.fields, T.StructField(into, _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        known = np.zeros(1 << 24, bool)
        known[grams] = True
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in portions(batches, column):
            index = Index.of(batch.column(column), known)
            texts = batch.column(column).to_pylist()
            own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for r, query in enumerate(queries):
                for k in range(len(texts)) if query is None else np.flatnonzero(index.candidates(query)).tolist():
                    own[k] += [(s, r, e) for s, e in matches(rules[r], compiled[r], texts[k] or "")]
            spans = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(x)] for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, arrow)], [*names, into])

    return df.mapInArrow(run, schema)


def redacted(df: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with the union of all spans in a text replaced by mark; null texts stay null."""
    spans = unused(df, "spans")
    found = find_secrets(df, rules, column, spans)
    done = F.expr(
        f"""aggregate(array_sort(transform({spans}, s -> struct(s.start, s.end))),
            named_struct('done', '', 'at', 0L),
            (a, s) -> CASE WHEN s.end <= a.at THEN a
                WHEN s.start < a.at THEN named_struct('done', a.done, 'at', s.end)
                ELSE named_struct('done', concat(a.done, substring({column}, int(a.at) + 1, int(s.start - a.at)), '{mark}'), 'at', s.end) END,
            a -> concat(a.done, substring({column}, int(a.at) + 1)))"""
    )
    return found.withColumn(column, F.when(F.size(spans) > 0, done).otherwise(F.col(column))).select(*df.columns)


def joined(spans: str, kinds: Sequence[str] | None = None) -> F.Column:
    if kinds:
        spans = f"filter({spans}, s -> s.kind IN ({', '.join(repr(k) for k in kinds)}))"
    return F.expr(f"coalesce(array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ','), '')")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"size(filter(secret_spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("secret_spans", BASE), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))
