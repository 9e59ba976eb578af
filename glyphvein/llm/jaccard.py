"""Join of documents by the Jaccard similarity of their word n-gram sets, by a MinHash LSH forest.

Documents with equal sets are one class. A class has TREES labels of DEPTH MinHash values; each
tree of the forest is its labels in sorted order, a prefix trie. A row's candidates in a tree are
those with the longest common prefix first, then at ever shorter ones, until the prefix is so short
that the target recall at the threshold holds (1 - (1 - t**d)**TREES); and one value further where
that stretch of the tree is small. All rows of such a stretch are compared: neighbours first, then, in
tiles, those that are not tied by then. A very large stretch is cut into tiles that are tasks of their own.
Candidates whose signatures agree enough are tied; within each group of tied classes, all are then
compared by their exact sets, in tiles. So links are exact, and counted without being listed: a
group of thousands of near copies sends counts, and a spanning forest of its links.

A text of fewer than n words has the sequence of all its words as its only n-gram; a text without
words (or null) has none and is linked with nothing. Rows without doc_id take part; the least
doc_id of a group stands for it, and rows without one stand last. Repeated rows are copies. An empty
table gives an empty result. Names of other columns do not matter: those needed on the way are made unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphvein.llm.common import mixed, portions, released, row_key, settled, stored, table, unused, utf8, word_hashes, words_of
from glyphvein.llm.components import components, forest, local_components

N_WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 8
#: Rows of a sorted tree that each row is compared with first; share of the signature by which the threshold's estimate may fall short.
NEXT, SLACK = 16, 0.18
RECALL = 0.9995
#: Rows of a stretch that is compared at a prefix one value shorter than recall asks for, and of one that is a task's at most.
SMALL, HUGE = 512, 4096
#: Classes of a tile of signatures, of a tile of sets, and entries of a dense tile's piece.
NEAR_TILE, TILE, PIECE = 128, 512, 1 << 22
#: Bytes of sets that a task compares with each other: of a large group's part at least and at most, and of small groups together.
PART_LEAST, PART_MOST, TOGETHER = 1 << 20, 16 << 20, 16 << 20
_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_depth(threshold: float, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix at which pairs at the threshold share a bucket of some tree with the recall asked for."""
    return max([1, *(d for d in range(1, DEPTH + 1) if 1 - (1 - threshold**d) ** trees >= recall)])


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All distinct n-gram hashes of the texts, text by text and ascending, and where each text's begin."""
    begin, end, upto = words_of(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(upto))
    h = word_hashes(data, begin, end)
    count = np.diff(upto)
    left = upto[1:][row] - np.arange(len(row))  # words from here to the text's end
    take = (left >= n) | (np.arange(len(row)) == upto[:-1][row])
    grams = np.zeros(len(row), np.uint64)
    for k in range(n):
        inside = left > k
        shifted = np.zeros(len(row), np.uint64)
        shifted[: len(row) - k] = h[k:]
        grams = np.where(inside, mixed(grams + shifted), grams)
    keys, row = grams[take], row[take]
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    keys, row = keys[fresh], row[fresh]
    assert len(count) == len(at) - 1
    return keys, np.searchsorted(row, np.arange(len(at)))


def signatures(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 16 bits for each text that has n-grams (zeros for others)."""
    some = np.diff(at) > 0
    found = np.zeros((len(at) - 1, len(_FACTORS)), ">u2")
    if some.any():
        starts = at[:-1][some]
        for k, factor in enumerate(_FACTORS):
            found[some, k] = mixed(np.minimum.reduceat(keys * factor, starts)) >> np.uint64(48)
    return found


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """key, doc_id, fp (of the set), n_grams, signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 2 << 20):
            keys, at = shingle_sets(*utf8(batch.column("text")), n)
            size = np.diff(at)
            total = np.zeros(len(keys) + 1, np.uint64)
            np.cumsum(mixed(keys), out=total[1:])
            fp = mixed(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64)
            found = signatures(keys, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(fp), pa.array(size), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "doc_id", "fp", "n_grams", "signature"]
            )

    return docs.mapInArrow(run, "key long, doc_id long, fp long, n_grams long, signature binary")


def _agreeing(full: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the rows i of signatures agree with which of the rows j."""
    return (full[i][:, None] == full[j][None]).sum(2) >= least


def stretch_ties(full: np.ndarray, least: float, across: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ties a - b of a spanning forest of rows of signatures (in the tree's order), all compared that are not tied by others.

    across: only rows before that place are compared with those from it on, if it is above 0.
    """
    n = len(full)
    root = np.arange(n)
    ties = [np.zeros((0, 2), np.int64)]

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        if len(a):
            ties.append(np.stack([a, b], 1))
            every = np.concatenate(ties)
            root = local_components(n, every[:, 0], every[:, 1])
            moved = np.flatnonzero(root != np.arange(n))
            ties[:] = [np.stack([moved, root[moved]], 1)]

    for step in range(1, min(NEXT, n - 1) + 1) if not across else ():
        near = np.arange(n - step)[root[step:] != root[:-step]] if step > 1 else np.arange(n - 1)
        near = near[(full[near] == full[near + step]).sum(1) >= least]
        join(near, near + step)
    tiles = [(x, y) for x in range(0, n, NEAR_TILE) for y in range(x, n, NEAR_TILE)] if not across else [(x, y) for x in range(0, across, NEAR_TILE) for y in range(across, n, NEAR_TILE)]
    if n > NEXT + 1 or across:
        for x, y in tiles:
            i, j = np.arange(x, min(x + NEAR_TILE, across or n)), np.arange(y, min(y + NEAR_TILE, n))
            apart = root[i][:, None] != root[j][None]
            i, j = i[apart.any(1)], j[apart.any(0)]
            if len(i) and len(j):
                p, q = np.nonzero(_agreeing(full, i, j, least))
                join(i[p], j[q])
    return ties[0][:, 0], ties[0][:, 1]


def tied(classes: DataFrame, threshold: float, depth: int | None = None) -> DataFrame:
    """Edges (a, b) that tie classes (fp, signature) which are candidates of each other in some tree: a spanning forest for each stretch of a tree."""
    label = 2 * DEPTH
    shortest = depth or least_depth(threshold)
    wider = max(1, shortest - 1)
    least = (threshold - SLACK) * TREES * DEPTH
    prefix = lambda values: F.expr(f"substring(label, 1, {2 * values})")
    rows = classes.select("fp", "signature", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(signature, t * {label} + 1, {label}))")).alias("tree", "label"))
    rows = rows.select("fp", "signature", "tree", "label", prefix(shortest).alias("head"), prefix(wider).alias("stem"))
    large = stored(rows.groupBy("tree", "head").agg(F.count("*").alias("size")).where(F.col("size") > HUGE), "jaccard-large")
    n_large = large.count()

    def ties(fp: np.ndarray, full: np.ndarray, across: int = 0) -> pa.RecordBatch:
        a, b = stretch_ties(full, least, across)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        labels = utf8(batch.column("label"))[0].reshape(batch.num_rows, label)
        full = utf8(batch.column("signature"))[0].reshape(batch.num_rows, -1)[:, 1::2]
        return np.asarray(batch.column("tree")), labels, full, np.asarray(batch.column("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def worked(tree: np.ndarray, labels: np.ndarray, full: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, j in _stretches(tree, labels, wider):
                if j - i <= SMALL:
                    if j - i > 1:
                        yield ties(fp[i:j], full[i:j])
                else:
                    for p, q in _stretches(tree[i:j], labels[i:j], shortest):
                        if q - p > 1:
                            yield ties(fp[i + p : i + q], full[i + p : i + q])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = read(batch)
            held = rows if held is None else tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            begin = _stretches(held[0], held[1], wider)[-1][0]  # the last stretch may go on
            if len(held[0]) - begin > SMALL:  # of a long one, what has the same prefix at the depth of recall
                begin = _stretches(held[0], held[1], shortest)[-1][0]
            yield from worked(*(x[:begin] for x in held))
            held = tuple(x[begin:] for x in held)
        if held is not None:
            yield from worked(*held)

    def tile(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        side = np.asarray(batch.column("side"))
        order = np.lexsort((np.asarray(batch.column("fp")), side))
        _, _, full, fp = read(batch)
        found = ties(fp[order], full[order], int((side == 0).sum()) if side.any() else 0)
        return pa.Table.from_batches([found])

    if n_large:
        # few: at most one for HUGE rows
        marked = rows.join(F.broadcast(large) if n_large < 100_000 else large, ["tree", "head"], "left")
        parts = F.ceil(F.col("size") / HUGE).cast("int")
        cut = marked.where("size IS NOT NULL").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        cut = cut.withColumn("p", F.explode(F.expr("transform(sequence(0, parts - 1), o -> named_struct('i', least(o, part), 'j', greatest(o, part)))")))
        cut = cut.withColumn("side", F.when((F.col("p.i") != F.col("p.j")) & (F.col("part") == F.col("p.j")), 1).otherwise(0))
        more = cut.select("tree", "label", "signature", "fp", "side", F.xxhash64("tree", "head", "p.i", "p.j").alias("tile")).groupBy("tile").applyInArrow(tile, "a long, b long")
        rows = marked.where("size IS NULL").drop("size")
    # Rows of a shorter prefix meet in one task where they are few; else those of each longer prefix do, as they are compared so.
    wide = stored(rows.groupBy("tree", "stem").agg(F.count("*").alias("many")).where(F.col("many") > HUGE).select("tree", "stem", F.lit(True).alias("wide")), "jaccard-wide")
    rows = rows.join(F.broadcast(wide) if wide.count() < 100_000 else wide, ["tree", "stem"], "left").withColumn("place", F.when(F.col("wide"), F.col("head")).otherwise(F.col("stem")))
    forest = rows.select("tree", "label", "fp", "signature", "place").repartition("tree", "place").sortWithinPartitions("tree", "label", "fp")
    edges = forest.mapInArrow(run, "a long, b long")
    return (edges.unionByName(more) if n_large else edges).distinct()


def _stretches(tree: np.ndarray, labels: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Bounds of stretches with equal tree and first `depth` values of the label."""
    fresh = np.ones(len(tree), bool)
    fresh[1:] = (tree[1:] != tree[:-1]) | (labels[1:, : 2 * depth] != labels[:-1, : 2 * depth]).any(1)
    begin = np.flatnonzero(fresh)
    return list(zip(begin.tolist(), np.append(begin[1:], len(tree)).tolist(), strict=True))


def _shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """How many n-grams each pair of sets has in common; sets as (all keys, bounds)."""
    other = right or left
    own = np.unique(left[0]) if right is None else np.intersect1d(left[0], right[0])
    n, m = len(left[1]) - 1, len(other[1]) - 1
    total = np.zeros((n, m), np.float32)
    sides = []
    for keys, at in (left, other):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.searchsorted(own, keys)
        known = place < len(own)
        known[known] = own[place[known]] == keys[known]
        sides.append((place[known], row[known]))
    if right is None:  # what only one set has is common to none
        several = np.bincount(sides[0][0], minlength=len(own)) > 1
        renumber = np.cumsum(several) - 1
        alone = np.bincount(sides[0][1], ~several[sides[0][0]], n)
        sides = [(renumber[p[k]], r[k]) for p, r in sides for k in (several[p],)]
        width = int(several.sum())
    else:
        alone, width = None, len(own)
    sides = [(p[o], r[o]) for p, r in sides for o in (np.argsort(p, kind="stable"),)]
    step = max(1, PIECE // max(n, m))
    for begin in range(0, width, step):
        dense = []
        for (p, r), rows in zip(sides, (n, m), strict=True):
            i, j = np.searchsorted(p, [begin, begin + step])
            d = np.zeros((rows, min(step, width - begin)), np.float32)
            d[r[i:j], p[i:j] - begin] = 1
            dense.append(d)
        total += dense[0] @ dense[1].T
    if alone is not None:
        total[np.arange(n), np.arange(n)] += alone
    return total.astype(np.int64)


def linked(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each pair of sets has at least the similarity; a set is not linked with itself."""
    common = _shared(left, right)
    sizes = np.diff(left[1])[:, None] + np.diff((right or left)[1])[None]
    found = (common >= threshold * (sizes - common) - 1e-9) & (common > 0)
    if right is None:
        np.fill_diagonal(found, False)
    return found


def _sets(raw: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(raw)
    return np.frombuffer(data.tobytes(), "<u8"), at // 8


def _part(sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = sets
    size = at[rows + 1] - at[rows]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return keys[np.arange(bounds[-1]) + np.repeat(at[rows] - bounds[:-1], size)], bounds


def _verified(threshold: float):
    """For a table of tied classes: weighed links of each class, and for a spanning forest of them, an edge each."""

    def run(rows: pa.Table) -> pa.Table:
        group, side = np.asarray(rows.column("group")), np.asarray(rows.column("side"))
        fp, weight = np.asarray(rows.column("fp")), np.asarray(rows.column("n_docs"))
        sets = _sets(rows.column("grams"))
        once = np.unique(np.stack([group, side, fp], 1), axis=0, return_index=True)[1]  # equal rows sent a set each
        group, side, fp, weight, sets = group[once], side[once], fp[once], weight[once], _part(sets, once)
        links, edges = np.zeros(len(fp), np.int64), [np.zeros((0, 2), np.int64)]
        order = np.lexsort((side, group))
        cuts = np.flatnonzero(np.diff(group[order], prepend=group[order][0] - 1))
        for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[i:j]
            a, b = own[side[own] == 0], own[side[own] == 1]
            if not len(b):
                for x in range(0, len(a), TILE):  # small groups are one tile
                    for y in range(x, len(a), TILE):
                        p, q = a[x : x + TILE], a[y : y + TILE]
                        found = linked(_part(sets, p), None if x == y else _part(sets, q), threshold)
                        links[p] += found @ weight[q]
                        if x != y:
                            links[q] += found.T @ weight[p]
                        s, t = np.nonzero(found)
                        edges.append(forest(p, q, s, t))
            else:
                for x in range(0, len(a), TILE):
                    for y in range(0, len(b), TILE):
                        p, q = a[x : x + TILE], b[y : y + TILE]
                        found = linked(_part(sets, p), _part(sets, q), threshold)
                        links[p] += found @ weight[q]
                        links[q] += found.T @ weight[p]
                        s, t = np.nonzero(found)
                        edges.append(forest(p, q, s, t))
        e = np.concatenate(edges)
        root = local_components(len(fp), e[:, 0], e[:, 1])
        return pa.table([pa.array(fp), pa.array(links), pa.array(fp[root])], ["fp", "links", "tie"])

    return run


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, depth: int | None = None) -> DataFrame:
    """key, doc_id, n_grams, n_links, class_id for each row of docs (key long, doc_id long, text string).

    n_links counts the other rows that are as similar; class_id is the least doc_id reachable by links. depth: the
    values that candidates' labels share in some tree, by default as many as recall allows.
    """
    signed = stored(_signed(docs, n), "jaccard-signed")
    classes = stored(signed.where("n_grams > 0").groupBy("fp").agg(F.count("*").alias("n_docs"), F.min("key").alias("key"), F.first("n_grams").alias("n_grams"), F.first("signature").alias("signature")), "jaccard-classes")
    ties = components(tied(classes, threshold, depth))
    members = classes.select("fp", "n_docs", "key", "n_grams").join(ties.select(F.col("id").alias("fp"), "component"), "fp")
    members = stored(members, "jaccard-members")
    sizes = members.groupBy("component").agg(F.count("*").alias("n_classes"), (8 * F.sum("n_grams")).alias("bytes"))
    # A group above a tile is cut into parts by bytes: a member is sent once for each part, and parts grow with the group.
    part = F.greatest(F.lit(PART_LEAST), F.least(F.lit(PART_MOST), F.col("bytes") / 16))
    chunks = F.when(F.col("n_classes") <= TILE, 1).otherwise(F.ceil(F.col("bytes") / part)).cast("int")
    asked = members.join(sizes, "component").select("key", "fp", "n_docs", "component", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
    # Equal rows share a key, and either of them has the set: they are told apart no more.
    # Both sides are large in general: the plan is the same at every size.
    wanted = docs.select("key", "text").join(asked.hint("merge"), "key")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 2 << 20):
            keys, at = shingle_sets(*utf8(batch.column("text")), n)
            raw = [keys[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fp", "n_docs", "component", "chunks", "chunk")), pa.array(raw, pa.binary())], ["fp", "n_docs", "component", "chunks", "chunk", "grams"])

    sets = wanted.mapInArrow(grams, "fp long, n_docs long, component long, chunks int, chunk int, grams binary")
    together = members.agg(F.coalesce(8 * F.sum("n_grams"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-together // TOGETHER))
    # A small group is compared whole, many in one task; of a large one, each pair of chunks is a task's.
    small = sets.where("chunks = 1").select("fp", "n_docs", "grams", F.col("component").alias("group"), F.lit(0).alias("side"), F.pmod(F.xxhash64("component"), F.lit(4 * parts)).cast("long").alias("task"))
    pairs = F.explode(F.expr("transform(sequence(0, chunks - 1), o -> named_struct('i', least(o, chunk), 'j', greatest(o, chunk)))"))
    large = sets.where("chunks > 1").select("fp", "n_docs", "grams", "component", "chunk", pairs.alias("p"))
    tile = F.xxhash64("component", "p.i", "p.j")
    large = large.select("fp", "n_docs", "grams", tile.alias("group"), F.when((F.col("p.i") != F.col("p.j")) & (F.col("chunk") == F.col("p.j")), 1).otherwise(0).alias("side"), tile.alias("task"))
    compared = small.unionByName(large).groupBy("task").applyInArrow(_verified(threshold), "fp long, links long, tie long")
    compared = stored(compared, "jaccard-compared")
    links = compared.groupBy("fp").agg(F.sum("links").alias("links"))
    groups = components(compared.where("tie <> fp").select(F.col("fp").alias("a"), F.col("tie").alias("b")))
    rows = signed.select("key", "doc_id", "fp", "n_grams").join(links, "fp", "left").join(groups.select(F.col("id").alias("fp"), "component"), "fp", "left").join(classes.select("fp", "n_docs"), "fp", "left")
    rows = rows.withColumn("group", F.when(F.col("n_grams") > 0, F.coalesce("component", "fp")))
    least = rows.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "group", "left")
    done = rows.select("key", "doc_id", "n_grams", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n_docs") - 1, F.lit(0))).alias("n_links"), F.coalesce("least", "doc_id").alias("class_id"), "group")
    return settled(done, "jaccard-links", signed, classes, members, compared)


#: Share of a sample's true links to be found, or prefixes get shorter.
LEAST_RECALL = 0.995
#: Rows audited, and bytes of each at most, which bounds what the tasks are sent.
AUDITED, AUDITED_BYTES = 256, 1 << 18


def audited(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, most: int = AUDITED) -> DataFrame:
    """key, n_links (as found) and true_links of a sample of rows, compared with every row by their sets.

    Half of the sample has links by `found` (of jaccard_links), half has none, so that lost links show where they are rare.
    """
    linked_rows = [found.where((F.col("n_grams") > 0) & (F.col("n_links") > 0 if some else F.col("n_links") == 0)).groupBy("key").agg(F.first("n_links").alias("n_links")).orderBy(F.xxhash64("key"), "key").limit(most // 2) for some in (True, False)]
    sample = linked_rows[0].unionByName(linked_rows[1])
    rows = docs.where(F.octet_length("text") <= AUDITED_BYTES).join(F.broadcast(sample), "key").groupBy("key").agg(F.first("n_links").alias("n_links"), F.first("text").alias("text")).toArrow()
    own, at = shingle_sets(*utf8(rows.column("text")), n)
    owner, size = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(at)
    order = np.argsort(own, kind="stable")
    own, owner = own[order], owner[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = np.zeros(len(size), np.int64)
        for batch in batches:
            for part in portions(iter([batch]), "text", 2 << 20):
                keys, bounds = shingle_sets(*utf8(part.column("text")), n)
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                first, last = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
                times = last - first
                upto = np.concatenate([[0], np.cumsum(times)])
                met = np.repeat(first - upto[:-1], times) + np.arange(upto[-1])
                pair, common = np.unique(owner[met] * part.num_rows + np.repeat(row, times), return_counts=True)
                i, j = pair // part.num_rows, pair % part.num_rows
                union = size[i] + np.diff(bounds)[j] - common
                true += np.bincount(i[common >= threshold * union - 1e-9], minlength=len(size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(size))), pa.array(true)], ["at", "true_links"])

    sums = docs.select("text").mapInArrow(run, "at long, true_links long").groupBy("at").agg((F.sum("true_links") - 1).alias("true_links"))  # less the row itself
    known = docs.sparkSession.createDataFrame(list(zip(range(len(size)), rows.column("key").to_pylist(), rows.column("n_links").to_pylist(), strict=True)), "at long, key long, n_links long")
    return known.join(sums, "at").select("key", "n_links", "true_links")


def measured_links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, depth: int | None = None) -> DataFrame:
    """jaccard_links() with its recall measured on a sample against all rows; where that falls short, again at prefixes one value shorter."""
    depth = depth or least_depth(threshold)
    while True:
        found = jaccard_links(docs, threshold, n, depth)
        told = audited(docs, found, threshold, n).agg(F.sum(F.least("n_links", "true_links")).alias("met"), F.sum("true_links").alias("true")).first()
        if not told.true or told.met >= LEAST_RECALL * told.true:
            return found
        released(found)
        depth -= 1
        if not depth:
            raise RuntimeError(f"{told.met} of {told.true} links were found at the shortest prefix")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def deduplicated(df: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """df with one document of each group of linked ones (its least doc_id; of rows equal in that and text, the least by a hash of the row); texts without words all stay."""
    keys = measured_links(_keyed(df), threshold, n)
    names, key = df.columns, unused(df, "key")
    first = keys.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("k")).select(F.col("k.key").alias(key))
    keyed = df.withColumn(key, row_key("doc_id", "text"))
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.join(first, key, "left_semi").where(~wordless)
    kept = kept.groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return kept.select("row.*").unionByName(df.where(wordless))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured_links(_keyed(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_grams", "n_links", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
