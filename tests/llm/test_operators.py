"""Each operator against brute force on small tables, with nulls, ties, repeats, empty and long texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from glyphvein.llm import bpe, components, jaccard, mixing, neighbours, quality, scoring, secrets, substring, tokenfile, toxicity
from glyphvein.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def _docs(n=60, seed=3):
    """Prose with repeated lines and passages, near copies, repeated rows, nulls, an empty and a long text."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}{'é' * (i % 3)}" for i in range(400)]
    say = lambda k: " ".join(words[i] for i in rng.integers(0, 400, k))
    passage = say(48)
    texts = [None, "", "one", "two words", " \n\t ", "nbsp x   y", "x" * 5000, say(6000), "it's  a\n\ntest's don't  ", "a | b ### c--d 12'3 4²5", "end <|endoftext|> of<|endoftext|>"]
    base = say(120)
    for i in range(n):
        text = say(int(rng.integers(5, 150)))
        if i % 4 == 0:
            text += "\n" + passage
        if i % 5 == 0:
            cut = base.split(" ")
            cut[int(rng.integers(120))] = f"edit{i}"
            text = " ".join(cut)
        if i % 9 == 0:
            text = base
        texts.append(text)
    rows = [(i, t, "en", [None, "a", "b", "c", "dé"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[21], "en", None, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3).cache()


def _words(text):
    return (text or "").encode().split()


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1


def test_a_cell_of_a_third_of_all_documents(spark):
    """50,000 empty texts of one source meet the plan without being gathered, by broadcast and by salt, with the same result."""
    rows = [(i, None, "a") for i in range(50_000)] + [(100_000 + i, " ".join(["w"] * (1 + i % 40)), "ab"[i % 2]) for i in range(400)]
    sized = spark.createDataFrame(rows, "key long, text string, source string").select("key", "source", mixing.size_of().alias("size"))
    results = []
    for few in (200_000, -1):
        mixing.FEW_CELLS = few
        try:
            results.append(sorted(map(tuple, mixing.copies(sized).select("key", "size", "copies", "target").collect())))
        finally:
            mixing.FEW_CELLS = 200_000
    assert results[0] == results[1] and len(results[0]) == len(rows) and all(r[2] == 1 for r in results[0][:50_000])
    plan = sized.select(F.lit("sa").alias("skey"), "size", F.lit(1).alias("n")).distinct()
    salted = mixing.planned(sized.withColumn("skey", F.lit("sa")), plan, False)
    most = salted.where("size = 0").groupBy(F.pmod(F.xxhash64("key", F.lit(13)), F.lit(mixing.SALTS))).count().agg(F.max("count")).first()[0]
    assert salted.count() == len(rows) and most < 50_000 / mixing.SALTS * 1.3
    assert "BroadcastHashJoin" in mixing.planned(sized.withColumn("skey", F.lit("sa")), plan, True)._jdf.queryExecution().executedPlan().toString()


def test_mixing(spark, docs):
    sized = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), "source", mixing.size_of().alias("size"))
    rows = mixing.copies(sized).collect()
    again = mixing.copies(sized.repartition(5)).collect()
    assert sorted((r.key, r.copies) for r in rows) == sorted((r.key, r.copies) for r in again)
    expected = Counter()
    for d in _docs():
        expected[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    order = [s for s in sorted(x for x in expected if x is not None)] + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(expected.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * expected[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * expected[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in rows:
        assert r.source_size == expected[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    assert mixing.mixed_documents(docs).agg(F.sum(mixing.size_of())).first()[0] == sum(taken.values())
    assert mixing.copies(_empty(spark).select(F.col("doc_id").alias("key"), "source", mixing.size_of().alias("size"))).count() == 0


def test_mixing_of_large_cells(spark):
    """Thousands of documents of one size, of which none is small enough to settle what rounding leaves."""
    sized = spark.range(9000).select(F.col("id").alias("key"), F.when(F.col("id") < 5000, "a").when(F.col("id") < 8000, "b").otherwise("c").alias("source"), F.lit(mixing.SMALL + 1).cast("long").alias("size"))
    rows = mixing.copies(sized).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(rows) == 3 and all(abs(r.taken - r.target) <= 0.02 * r.target and r.most <= 2 for r in rows)


def test_rates_solve_the_dual(spark):
    """Multipliers by bisection, in floats, source by source."""
    rng = np.random.default_rng(33)
    sizes = {"a": rng.integers(1, 400, 300), "b": rng.integers(1, 50, 200), None: rng.integers(1, 900, 150)}
    rows = [(i, s, int(x)) for i, (s, x) in enumerate((s, x) for s, v in sizes.items() for x in v)]
    got = mixing.copies(spark.createDataFrame(rows, "key long, source string, size long")).collect()
    for s, v in sizes.items():
        own = [r for r in got if r.source == s]
        low, high = -50.0, math.log(2)
        for _ in range(200):
            lam = (low + high) / 2
            total = sum(x * min(2.0, math.exp(lam * x / v.mean())) for x in v)
            low, high = (lam, high) if total < own[0].target else (low, lam)
        if own[0].target < 2 * v.sum() * (1 - 1e-9):
            assert all(r.rate == pytest.approx(min(2.0, math.exp(lam * r.size / v.mean())), rel=1e-4) for r in own)
        else:
            assert all(r.copies == 2 for r in own)


# ---------------------------------------------------------------- 2


def _clusters():
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for size in (1, 1, 1, 2, 5, 40, 700):
        center = rng.standard_normal(24)
        for _ in range(size):
            rows.append((n, [float(x) for x in center + 0.18 * rng.standard_normal(24) * (size > 1)], n % 2 if size == 5 else 1))
            n += 1
    rows += [(n, rows[3][1], 1), (n + 1, rows[3][1], 2), (n + 2, None, 1), (n + 3, [0.0] * 24, 1), (n + 4, [1.0, None], 1), (n + 5, [float("nan")] * 24, 1), (n + 6, rows[3][1], None), (n + 7, [1.0, 2.0], 1)]
    return rows


def test_neighbours(spark):
    rows = _clusters()
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    sound = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, v, a in sound:
        for j, w, b in sound:
            if i < j and a == b and len(v) == len(w) and v @ w >= 0.98:
                links[i].add(j)
                links[j].add(i)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_touching_dense_groups(spark):
    rng = np.random.default_rng(5)
    one, other = np.eye(32)[:2]
    rows = []
    for g, centre in enumerate((one, 0.987 * one + np.sqrt(1 - 0.987**2) * other)):
        rows += [(100 * g + i, (centre + 0.003 * rng.standard_normal(32)).tolist(), 1) for i in range(40)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert (true > 40).all() and not (np.argsort(-(x @ x.T), 1)[:, :9] // 40 != np.arange(80)[:, None] // 40).any()
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[r[0]].n_links for r in rows] == true.tolist() and {g.component_id for g in got.values()} == {0}


def test_leaves_by_the_space(spark):
    rng = np.random.default_rng(8)
    sizes = {1: 4000, 2: 5, 3: 1, 4: 30}
    rows = [(i, space, x.tolist()) for i, (space, x) in enumerate((s, rng.standard_normal(16)) for s, n in sizes.items() for _ in range(n))]
    classes = spark.createDataFrame(rows, "cid long, space long, embedding array<double>")
    leaves = defaultdict(set)
    for r in neighbours._leaves(classes, 0, 2, 32).select("tree", "space", "leaf", "cid").collect():
        leaves[r.tree, r.space, r.leaf].add(r.cid)
    assert all(sum(len(v) for k, v in leaves.items() if k[:2] == (tree, space)) == n for tree in range(2) for space, n in sizes.items())
    assert all(len(v) > 1 or k[1] == 3 for k, v in leaves.items()) and max(map(len, leaves.values())) <= 100
    assert all(sum(k[1] == space for k in leaves) == 2 for space in (2, 3, 4))


def test_rare_links_near_the_threshold(spark):
    """Thousands of vectors of one label, of which few are linked, at cosines just above and below the threshold."""
    rng = np.random.default_rng(31)
    x = rng.standard_normal((2500, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(60):
        a, cosine = x[2 * k], 0.975 + 0.01 * k / 60
        side = rng.standard_normal(20)
        side -= (side @ a) * a
        x[2 * k + 1] = cosine * a + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert 20 < true.sum() < 70
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(2500)] == true.tolist()


def test_labels_short_of_links_are_compared_whole(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 16))
    x[1::2] = x[::2] + 0.01 * rng.standard_normal((30, 16))
    # a group of repeated vectors, whose links outweigh all lost pairs
    rows = [(i, v.tolist(), i // 30) for i, v in enumerate(x)] + [(100 + i, (np.eye(16)[0] + 0.001 * np.eye(16)[i % 5 + 1]).tolist(), 0) for i in range(200)]
    few = lambda classes, *_, **__: classes.sparkSession.createDataFrame([], "cid long, near array<struct<cosine:double,other:long>>")
    monkeypatch.setattr(neighbours, "descended", few)
    monkeypatch.setattr(neighbours, "REPEATS", 1)
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 1 and got[i].component_id == i // 2 * 2 for i in range(60)) and all(got[100 + i].n_links == 199 for i in range(200))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)], "a long, b long")
    assert {(r.id, r.component) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert components.local_components(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


# ---------------------------------------------------------------- 3


def test_secrets(spark):
    key = "AKIA" + "Z9" * 9
    texts = [
        None, "", "plain words", 'é token = "abc123" x', "TOKEN:abcde password='s3cr3t+/=' Api_Key=ABCDEF apikey=abcdef", f"x {key}0 AKIASHORT {key}", "0" * 23 + "g" + "0123456789abcdef" * 2, "ſecret=abcdefg secret:=abcdef",
        "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl at -----BEGIN RSA PRIVATE KEY-----", "db http://user:hunter2@host/x ghp_" + "a1" * 18, "token token = token=abcdef123",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, secret_spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secrets.find_secrets(df).collect()}
    for i, t in enumerate([*texts, texts[3]]):
        own = [(m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, t or "") if m.end(rule.group) - m.start(rule.group) >= rule.least]
        assert got[i] == [(secrets.RULES[k].kind, s, e) for s, k, e in sorted(own)]
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("(?i:Ab(c|d)e+F?g)") == frozenset({frozenset({b"ab" + x, b"b" + x + b"e", *y}) for x in (b"c", b"d") for y in ({b"efg"}, {})} - {frozenset({b"ab" + x, b"b" + x + b"e", b"efg"}) for x in (b"c", b"d")})
    masked = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert masked[0] is None and masked[2] == texts[2] and masked[3] == "é [SECRET]\" x"
    assert not any(key in (t or "") for t in masked.values())
    assert secrets.find_secrets(_empty(spark)).count() == 0


def test_secrets_query_columns(spark):
    """Base kinds by the contract's own expressions, over a whole table."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    anycase = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = assign.replace("password|passwd|secret|token|api_?key", anycase)
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = 0
    for r in secrets.op3_secrets(spark, sf).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), k, m.end()) for k, (p, least, g) in enumerate(((assign, 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0))) for m in re.finditer(p, t) if len(m[g]) >= least]
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) - {""} <= set(r.spans.split(","))
        total += len(spans)
    assert total and "Exchange" not in secrets.op3_secrets(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_trigrams_of_other_letters(spark):
    rules = (secrets.Rule("a", "É=[a-z]+"), secrets.Rule("b", "(?i:kelvin)=[0-9]+"), secrets.Rule("c", "(?i:Größe)x"))
    df = spark.createDataFrame([(1, "É=abc é=abc"), (2, "\u212aelvin=1 KELVIN=2"), (3, "GRÖßEx größex")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start) for s in r.secret_spans] for r in secrets.find_secrets(df, rules).collect()}
    assert got == {1: [("a", 0)], 2: [("b", 0), ("b", 9)], 3: [("c", 0), ("c", 7)]}


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize(("window", "bits"), [(35, 8), (6, 8), (6, 1)])
def test_substring(spark, docs, window, bits, monkeypatch):
    if bits == 1:  # many segments, and relays upon relays
        monkeypatch.setattr(substring, "SEGMENT_BYTES", 16_000)
        monkeypatch.setattr(substring, "DIGIT", bits)
    count = Counter(tuple(w[i : i + window]) for d in _docs() for w in [_words(d[1])] for i in range(len(w) - window + 1))
    expected = Counter()
    for d in _docs():
        w = _words(d[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        expected[d[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    got = substring.repeats_removed(docs.select("doc_id", "text"), window, digest=True)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == expected
    assert substring.repeats_removed(_empty(spark)).count() == 0


def test_substring_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "mine", "x"), (2, "a b c d e f", None, "y")], "doc_id long, text string, __seg string, n_words string")
    got = {r.doc_id: r for r in substring.repeats_removed(df, 6).collect()}
    assert got[1]["__seg"] == "mine" and got[2]["__seg"] is None and (got[1].n_words, got[1].n_removed, got[1].kept_text) == (7, 6, "g") and got[2].kept_text == ""


def test_rows_sent_grow_with_the_corpus(spark, monkeypatch):
    """Twice the texts, at most twice the rows that segments and relays send on a level."""
    monkeypatch.setattr(substring, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(substring, "DIGIT", 2)
    real, rows = substring.exchanged, {}

    def counted(sent, stage, senders, depth=0):
        rows[stage, depth] = rows.get((stage, depth), 0) + sent.count()
        return real(sent, stage, senders, depth)

    monkeypatch.setattr(substring, "exchanged", counted)
    seen = []
    for n in (80, 160):
        rng = np.random.default_rng(1)
        frame = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 9, 400)))) for i in range(n)], "doc_id long, text string")
        rows.clear()
        assert substring.repeats_removed(frame, 6).count() == n
        seen.append([v for (stage, _), v in sorted(rows.items()) if stage == 1])
    sent = [4 * 16, 4 * 32]  # buckets times segments, on each of as many levels as digits tell them apart
    assert all(max(levels) <= most for levels, most in zip(seen, sent, strict=True)) and [len(x) for x in seen] == [2, 3]


# ---------------------------------------------------------------- 5


def test_quality_counts(docs):
    model = quality.fit([])
    for r in quality.judged(docs, model).join(docs, "doc_id").collect():
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = Counter(windows)
        repeated = {k for i, x in enumerate(windows) if twice[x] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and (r.kept is False or not r.base_failed)


def test_quality_of_no_and_long_texts(spark):
    model = quality.fit([])
    assert quality.judged(_empty(spark), model).count() == 0
    line = " ".join(f"w{i}" for i in range(40))
    long = "\n".join(f"{line} x{i}" for i in range(8000))
    rows = {r.doc_id: r for r in quality.judged(spark.createDataFrame([(1, long), (2, long + "\n" + line + " x7")], "doc_id long, text string"), model).collect()}
    assert (rows[1].n_words, rows[1].n_dup_lines, rows[1].base_failed) == (41 * 8000, 0, True) and rows[2].n_dup_lines == 1


def test_crf_learns_and_decodes():
    rng = np.random.default_rng(1)
    sequences = []
    for _ in range(150):
        y = np.repeat(rng.integers(0, 2, 6), 3)
        x = np.zeros((len(y), quality.N_FEATURES))
        x[:, 0] = 1
        x[:, 1] = rng.random(len(y)) < np.where(y == 1, 0.75, 0.25)
        sequences.append((x, y))
    model = quality.fit(sequences)
    right = lambda m: np.mean([np.mean(m.viterbi(np.zeros(len(y), int), x) == y) for x, y in sequences])
    # the rates that the sequences were drawn by: no model is right much more often
    emission = np.zeros((quality.N_FEATURES, 2))
    emission[0], emission[1] = np.log([0.75, 0.25]), np.log([1 / 3, 3])
    true = quality.Crf(emission, np.log([[5 / 6, 1 / 6], [1 / 6, 5 / 6]]))
    assert right(model) > right(true) - 0.02
    x, score = sequences[0][0][:7], lambda s: sum(x[i] @ model.emission[:, s[i]] for i in range(7)) + sum(model.transition[s[i], s[i + 1]] for i in range(6))
    best = max(np.ndindex(*[2] * 7), key=score)
    assert score(model.viterbi(np.zeros(7, int), x)) == pytest.approx(score(best))


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op5_quality(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in rows]) > 0.9


# ---------------------------------------------------------------- 6


def _encoding():
    return bpe.encoding(MULTI, public_tokenizers.PATTERN)


def test_bpe(spark, docs, monkeypatch):
    enc = _encoding()
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.digests(docs, MULTI, public_tokenizers.PATTERN).collect()}
    for d in _docs():
        ids = enc.encode_ordinary(d[1] or "")
        r = got[d[0], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((d[1] or "").encode()).hexdigest()
    ids = bpe.encode_texts(docs, MULTI, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in bpe.decode_ids(ids, MULTI, public_tokenizers.PATTERN).collect())
    assert isinstance(enc, tiktoken.Encoding) and bpe.encode_texts(_empty(spark), MULTI, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_texts(spark):
    enc = _encoding()
    rng = np.random.default_rng(17)
    words = ["alpha", "béta", "\n\n", "  x", "don't", "日本", "12345", "#!"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 60_000)), "x" * 70_000, " " * 70_000]
    assert len(texts[0]) > 2 * bpe.LONG_TEXT
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MULTI, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts[:1]):
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    clash = bpe.encode_texts(spark.createDataFrame([("a b", "old", 1)], "text string, ids string, doc_id int"), MULTI, public_tokenizers.PATTERN).first()
    assert list(clash.ids) == enc.encode_ordinary("a b") and clash.doc_id == 1


def test_safe_boundaries():
    rng = np.random.default_rng(2)
    alphabet = [" ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "é", "'s", "'", "1", "²", "#", "日", "😀", "́", "_"]
    enc = _encoding()
    for _ in range(1500):
        text = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), 30))
        parts = list(bpe.pieces(text, 3))
        assert "".join(parts) == text and sum((enc.encode_ordinary(p) for p in parts), []) == enc.encode_ordinary(text)


# ---------------------------------------------------------------- 7


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [plain[k] for k in rng.integers(0, 300, 40)] + (["scoundrel", "vermin", "cretin"][: 1 + i % 3] if toxic else [])
        docs.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "vermin Cretin SCOUNDREL"), (5, docs[5][1])]
    labels += [(5, 0), (None, 1), (7, None), (2000, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("p_severe", F.lit("clash"))
    chain = toxicity.fit_from_labels(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(frame, chain).collect()}
    assert [got[i].rejected for i in range(300, 400)] == [i % 5 == 0 for i in range(300, 400)]
    assert (got[1000].rejected, got[1001].rejected, got[1002].rejected) == (False, False, True)
    assert len(chain.models[1].weights) == len(chain.vocabulary) + 1 and len(chain.models[2].weights) == len(chain.vocabulary) + 2
    # probabilities by the definition of a chain of logistic models
    for i in (5, 10, 301):
        present, earlier = [chain.vocabulary[w] for w in set(docs[i][1].split()) if w in chain.vocabulary], []
        for name, m in zip(toxicity.CATEGORIES, chain.models, strict=True):
            z = m.bias + sum(m.weights[k] for k in present) + sum(w * p for w, p in zip(m.weights[len(chain.vocabulary) :], earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-z)))
            assert getattr(got[i], f"p_{name}") == pytest.approx(earlier[-1], rel=1e-6)
    assert toxicity.score(_empty(spark), chain).count() == 0
    none = toxicity.fit_from_labels(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame, none).where("rejected").count() == 0


def test_linear_model_is_at_its_optimum():
    """The penalised likelihood's subgradient holds zero in each weight."""
    rng = np.random.default_rng(15)
    n, n_words, l1 = 400, 12, 2e-3
    x = rng.random((n, n_words)) < 0.3
    earlier = rng.random((n, 1))
    y = (rng.random(n) < 1 / (1 + np.exp(2 - 3 * x[:, 0] - 2 * x[:, 1] - earlier[:, 0]))).astype(float)
    row, word = np.nonzero(x)
    m = toxicity.fit_linear(row, word, n_words, earlier, y, l1=l1, steps=3000)
    both = np.column_stack([x, earlier])
    error = (1 / (1 + np.exp(-(both @ m.weights + m.bias))) - y) / n
    gradient = both.T @ error
    assert abs(error.sum()) < 1e-5 and m.weights[0] > 1 and (np.abs(gradient) <= l1 + 1e-5).all()
    assert np.abs(gradient + l1 * np.sign(m.weights))[m.weights != 0].max() < 1e-5


def test_folds_do_not_see_themselves():
    """A word that one fold alone has takes no part in what is predicted for that fold."""
    n = 100
    folds = np.arange(n) % toxicity.FOLDS
    toxic = (np.arange(n) // toxicity.FOLDS % 2 == 0).astype(int)
    known = np.ones((toxicity.FOLDS + 1, 2), bool)
    known[0, 1] = False  # without fold 0, word 1 is unknown
    targets = np.repeat(np.column_stack([toxic, toxic])[None], toxicity.FOLDS + 1, 0)
    row, word = np.nonzero(np.column_stack([np.ones(n), (folds == 0) & (toxic == 1)]))
    chain = toxicity.fit_chain(row, word, ["a", "b"], known, targets, folds)
    assert chain.models[0].weights[1] > 0.5
    part = toxicity.fit_linear(row[word == 0], word[word == 0], 2, np.zeros((n, 0)), toxic.astype(float))
    assert part.weights[1] == 0


# ---------------------------------------------------------------- 8


def _linked(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = _words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    return sets, near


def test_jaccard(spark, docs):
    rows = [(d[0], d[1]) for d in _docs()]
    _, near = _linked(rows)
    expected = Counter()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        expected[rows[i][0], len(near[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)] += 1
    found = jaccard.jaccard_links(jaccard._keyed(docs)).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in found) == expected
    keyed = jaccard._keyed(docs)
    audit = jaccard.audited(keyed, jaccard.jaccard_links(keyed)).collect()
    assert len(audit) > 40 and sum(r.n_links > 0 for r in audit) > 10 and all(r.n_links == r.true_links for r in audit)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {r.class_id if r.class_id is not None else "none" for r in found if r.n_grams}
    assert kept.where(F.coalesce("text", F.lit("")).rlike(r"\S")).count() == len(groups)
    assert kept.where("text IS NULL").count() == 1 and jaccard.deduplicated(_empty(spark)).count() == 0


def test_tiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    base = [f"t{i}" for i in range(90)]
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.integers(0, 90, int(rng.integers(0, 3))):
            w[k] = f"e{rng.integers(30)}"
        rows.append((i, " ".join(w)))
    _, near = _linked(rows)
    got = jaccard.jaccard_links(jaccard._keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: len(n) for i, n in enumerate(near)}
    assert jaccard.least_depth(0.8) < jaccard.least_depth(0.95)


def test_stretches_of_templated_texts(spark, monkeypatch):
    """Families that share half their text and signature prefixes, with pairs of near copies in them: no link is lost, whole or in tiles that are tasks."""
    rng = np.random.default_rng(21)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"x{i}_{k}" for k in range(50)]
        for copy in range(2 if i % 3 == 0 else 1):
            w = template + own
            if copy:
                w = [*w[:-3], "p", "q", "r"]
            rows.append((2 * i + copy, " ".join(w)))
    rng.shuffle(rows)
    rows = [(int(i), str(x)) for i, x in rows]
    _, near = _linked(rows)
    assert sum(map(len, near)) == 100
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for huge in (4096, 20):
        monkeypatch.setattr(jaccard, "HUGE", huge)
        got = {r.doc_id: r.n_links for r in jaccard.jaccard_links(jaccard._keyed(frame)).collect()}
        assert [got[i] for i, _ in rows] == [len(x) for x in near]


def test_stretch_ties_miss_none():
    rng = np.random.default_rng(22)
    base = rng.integers(0, 256, (12, 128)).astype(np.uint8)
    full = base[rng.integers(0, 12, 700)]
    change = rng.random(full.shape) < 0.1
    full[change] = rng.integers(0, 256, change.sum())
    a, b = jaccard.stretch_ties(full, 79)
    i, j = np.nonzero(np.triu((full[:, None] == full[None]).sum(2) >= 79, 1))
    assert (components.local_components(700, a, b) == components.local_components(700, i, j)).all() and len(a) < 700
    a, b = jaccard.stretch_ties(full, 79, 300)
    cross = (i < 300) & (j >= 300)
    assert (components.local_components(700, a, b) == components.local_components(700, i[cross], j[cross])).all()


def test_survivors_do_not_depend_on_order(spark):
    rows = [(1, "a b c d e f g", "en", s, 1) for s in ("x", "y", None)] + [(2, "a b c d e f g", "en", "z", 1)]
    kept = {tuple(jaccard.deduplicated(spark.createDataFrame(r, SCHEMA).withColumn("__key", F.lit("mine"))).collect()[0]) for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and next(iter(kept))[0] == 1 and next(iter(kept))[-1] == "mine"


def test_recall_is_measured_and_acted_on(spark, docs, monkeypatch):
    """With prefixes so long that links are lost, the audit shortens them until the links are those of the exact join."""
    keyed = jaccard._keyed(docs)
    expected = sorted(map(tuple, jaccard.jaccard_links(keyed).select("doc_id", "n_links", "class_id").collect()), key=str)
    asked = []
    links = jaccard.jaccard_links
    monkeypatch.setattr(jaccard, "jaccard_links", lambda d, t, n, depth: asked.append(depth) or (links(d, t, n, depth) if depth < 7 else links(d, t, n, depth).withColumn("n_links", F.lit(0).cast("long"))))
    got = jaccard.measured_links(keyed, depth=8)
    assert sorted(map(tuple, got.select("doc_id", "n_links", "class_id").collect()), key=str) == expected and asked[:2] == [8, 7] and len(asked) > 2


def test_hot_stems_are_split(spark, monkeypatch):
    """Many middling heads under one stem: each is dealt by itself, and no tie is lost."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, text(i // 3) + f" tail{i % 3}") for i in range(240)]
    df = jaccard._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = sorted(map(tuple, jaccard.jaccard_links(df).select("doc_id", "n_links", "class_id").collect()))
    assert all(n == 2 and c == d // 3 * 3 for d, n, c in expected)
    monkeypatch.setattr(jaccard, "HUGE", 2)
    monkeypatch.setattr(jaccard, "SMALL", 1)
    assert sorted(map(tuple, jaccard.jaccard_links(df).select("doc_id", "n_links", "class_id").collect())) == expected


# ---------------------------------------------------------------- 9


def test_scores(spark, docs):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*(t or "").encode().translate(lower).split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    count = Counter(x for d in _docs() if not held(d[0]) for x in tokens(d[1]))
    total = sum(count.values())
    expected = Counter((d[0], held(d[0]), len(tokens(d[1])), sum(count[x] > 0 for x in tokens(d[1])), total, round(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in tokens(d[1])), 4)) for d in _docs())
    for hot in (1 << 20, 40):  # with and without words that are joined
        scoring.HOT = hot
        got = scoring.score(docs).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    scoring.HOT = 1 << 20
    assert all(r.score < 0 for r in got) and max(r.bits_per_byte for r in got if r.n_tokens > 100) < 8
    assert scoring.score(_empty(spark)).count() == 0


def _model(rng, n_words=40, bits=16):
    tree = scoring.Tree.of(rng.integers(0, 1000, scoring.WORDS + n_words))
    words = np.unique(rng.integers(-(1 << 62), 1 << 62, n_words))
    tables = rng.integers(-60, 60, (scoring.N_TABLES, 1 << bits)).astype(np.int8)
    return scoring.Model(words, np.arange(scoring.WORDS, scoring.WORDS + len(words), dtype=np.int32), tree, bits, tables, rng.normal(0, 0.3, (scoring.N_INPUTS, scoring.GATES)).astype(np.float32))


def test_model_is_a_distribution():
    """Whatever came before, the probabilities of all symbols sum to one."""
    model = _model(np.random.default_rng(3))
    n = len(model.tree.length)
    assert sum(2.0 ** -model.tree.length.astype(float)) == pytest.approx(1)
    for before in ([], [97, 270, 32], [97] * 200):
        symbols = np.concatenate([[*before, s] for s in range(n)]).astype(np.int32)
        bits = model.code_lengths(symbols, np.arange(n + 1) * (len(before) + 1))
        given = model.code_lengths(np.array(before, np.int32), np.array([0, len(before)]))[0] if before else 0
        assert (2.0 ** (given - bits)).sum() == pytest.approx(1, rel=2e-3)


def test_code_lengths_bit_by_bit():
    """One text at a time and one bit at a time, with weights learned after each block."""
    rng = np.random.default_rng(12)
    model = _model(rng)
    tree, texts = model.tree, [rng.integers(0, 290, k).tolist() for k in (1, 0, 63, 64, 65, 700, 200)]
    symbols, bounds = np.array(sum(texts, []), np.int32), np.r_[0, np.cumsum([len(t) for t in texts])]
    found = scoring.contexts(symbols, bounds)
    expected = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        own, at, block, cost = np.zeros(scoring.N_INPUTS - 1), begin, scoring.BLOCK, 0.0
        while at < end:
            gradient, n = np.zeros(scoring.N_INPUTS - 1), 0
            for i in range(at, min(at + block, end)):
                for b in range(tree.length[symbols[i]]):
                    at_tree = tree.first[symbols[i]] + b
                    turn = int(tree.packed[at_tree]) & 1
                    root, place = at_tree - b % 4, 1
                    for back in range(b % 4):
                        place = 2 * place + (int(tree.packed[root + back]) & 1)
                    spot = [((int(c[i]) + int(tree.salt[root]) & 0xFFFFFFFF) >> (36 - model.bits)) * 16 + place for c in found]
                    x = np.array([*(model.tables[k][s] * scoring.STEP for k, s in enumerate(spot)), tree.prior[at_tree]])
                    w = model.weights[:, int(tree.packed[at_tree]) >> 5]
                    z = min(12, max(-12, (w[:-1] + own) @ x + w[-1]))
                    p = 1 / (1 + math.exp(-z))
                    cost -= math.log2(p if turn else 1 - p)
                    gradient += (turn - p) * x
                    n += 1
            own += scoring.RATE / max(n, 400) * gradient
            at, block = at + block, min(2 * block, scoring.MOST_BLOCK)
        expected.append(cost)
    assert model.code_lengths(symbols, bounds) == pytest.approx(expected, rel=1e-4)


def test_held_out_bits_beat_single_words(spark):
    """Held-out documents of the driver's table cost fewer bits a byte than under single words, and fewer than 2.20."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = scoring.score(docs).join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id").where("held_out")
    base, model = rows.select(*(F.sum(c) / F.sum("size") * -math.log2(10) for c in ("base_score", "score"))).first()
    assert model < base and model < 2.2


def test_spelled_words_are_told_apart():
    """What is spelled so far, from each word's own beginning; nothing of it crosses a space, a known word or a text."""
    symbols = np.array([97, 98, 32, 97, 98, 300, 97, 98, 256, 98, 97], np.int32)
    inside, so_far = scoring.spelled(symbols, np.array([0, 9]))
    assert inside.tolist() == [False, True, True, False, True, True, False, True, True, False, True]
    assert so_far[1] == so_far[4] == so_far[7] != so_far[10] and so_far[2] == so_far[5] == so_far[8] != so_far[1]


def test_symbols_tell_texts_apart():
    """Texts are read back from their symbols: known words stand for themselves, single spaces beside them are understood."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    names = ["the", "of", "é", "rare", "x", "odd"]
    known = {w: scoring.lowered(pa.array([w]))[5][0] for w in names[:3]}
    words = np.sort(np.array(list(known.values())))
    back = {scoring.WORDS + int(np.searchsorted(words, h)): w for w, h in known.items()}
    model = scoring.Model(words, np.arange(scoring.WORDS, scoring.WORDS + 3, dtype=np.int32), None, 16, None, None)
    texts = [None, "", "The", " of", "x "] + ["".join(rng.choice([*names, " ", " ", " ", "\n", "  "], 12)) for _ in range(300)]
    symbols, bounds = model.coded(*scoring.lowered(pa.array(texts, pa.string())))
    for t, i, j in zip(texts, bounds[:-1], bounds[1:], strict=True):
        out, last = b"", None
        assert symbols[j - 1] == scoring.END
        for s in symbols[i : j - 1].tolist():
            word = back[s].encode() if s in back else bytes([s])
            spaced = out and not out[-1:].isspace() and not word.isspace() and (s in back or last in back)
            out += b" " * bool(spaced) + word
            last = s
        assert out.decode() == (t or "").lower()


def test_long_text_is_scored_whole(spark):
    rng = np.random.default_rng(14)
    words = [f"word{i}" for i in range(500)]
    text = " ".join(words[i] for i in rng.integers(0, 500, 60_000))
    assert len(text) > 1 << 18
    rows = [(i, " ".join(words[k] for k in rng.integers(0, 500, 50))) for i in range(60)] + [(100, text), (101, text[: len(text) // 2])]
    got = {r.doc_id: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_tokens == 60_001 and got[100].score < got[101].score < got[0].score < 0
    assert got[100].bits_per_byte < got[0].bits_per_byte < 3
    assert scoring.table_bits(10**6) < scoring.table_bits(10**7)


# ---------------------------------------------------------------- 10


def test_token_file(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, JSON, 2, block=2000)
    assert spark.read.parquet(f"{path}/blocks").count() > 3
    rows = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((d[0] for d in _docs()), key=lambda x: -1 if x is None else x)
    texts = defaultdict(list)
    for d in _docs():
        texts[d[0]].append([*library.encode(d[1] or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in texts[r.doc_id]
        at += r.n_tokens
    digests = {(r.start, r.ids_crc32) for r in tokenfile.read_tokens(spark, path, digest=True).collect()}
    assert digests == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    tokenfile.write_tokens(_empty(spark), str(tmp_path / "none"), JSON, 2)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_units_encode_as_whole_texts():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    alphabet = [" ", "\n", "a", "the", "é", "ñ", "'s", "'", "1", "²", "#", "|", "_", "日", "😀", "́", ".", " ", "<|endoftext|>"]
    units = tokenfile.Units(JSON)
    texts = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), 25)) for _ in range(1500)]
    ids, counts = units.encode(pa.array(texts))
    again, _ = units.encode(pa.array(texts[::-1]))
    own = [e.ids for e in units.library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in own] and ids.tolist() == sum(own, []) and again.tolist() == sum(own[::-1], [])


def test_added_tokens_as_in_the_plain_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "end<|endoftext|><|endoftext|>\n x", "a <|endoftext |> b", "no such string"]
    own = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = tokenfile.Units(JSON).encode(pa.array(texts))
    assert counts.tolist() == [len(x) for x in own] and ids.tolist() == sum(own, [])


def test_blocks_and_damage():
    rng = np.random.default_rng(7)
    for n in (0, 1, tokenfile.LANES, tokenfile.LANES + 1, tokenfile.LANES * tokenfile.SEGMENT + 5):
        ids = rng.integers(0, 700, n) ** 2 // 10
        tokens, counts = np.unique(ids, return_counts=True)
        f = tokenfile.Frequencies.of(tokens, counts)
        coded = tokenfile.encode_block(ids, f)
        assert tokenfile.decode_block(coded, f).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        tokenfile.decode_block(coded[:-1] + bytes([coded[-1] ^ 1]), f)


def test_utf8_of_slices():
    import pyarrow as pa

    data, at = utf8(pa.array(["ab", None, "é", ""]).slice(1))
    assert data.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
