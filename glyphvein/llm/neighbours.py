"""Near-dedup of embeddings by NN-descent.

Equal vectors of a label are one class. Each class starts with its best neighbours in the leaves
of a few random-hyperplane trees; then rounds of neighbours-of-neighbours joins improve the lists:
all that are neighbours of one vector, or have it as theirs, are compared with each other. Edges at
the threshold are kept. A list whose last entry is still a link is saturated, and enlarged to the
whole group that links tie together: groups are compared in tiles, so links are counted exactly and
not listed. Links between two groups that no list has room for are sought among the saturated classes,
in the leaves of further trees, until these find none. A bounded sample of classes
of each label is compared with all its classes, in blocks, to audit how many have all their links; while
a label falls short, more trees and rounds follow, and after a few turns all its classes are compared.

Cosines are in double precision. Vectors that are null, zero or hold null or non-finite components,
and vectors without label, link with nothing. Vectors of different lengths are not compared.
Repeated vectors link with each other; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from glyphvein.llm.common import released, settled, stored, table
from glyphvein.llm.components import components, forest, local_components

THRESHOLD = 0.98
#: Neighbours of a list, trees to begin with, vectors of a leaf, rounds at most, share of lists that may still change.
K, TREES, LEAF, ROUNDS, STILL = 8, 5, 256, 6, 0.002
#: Classes audited in all, the share of them with all their links to reach, and after how many turns of trees labels that fall short are compared whole.
AUDITED, RECALL, REPEATS = 4096, 0.999, 3
TILE = 512
#: Bytes of a large group's part that a task compares, at least and at most.
PART_LEAST, PART_MOST = 1 << 18, 16 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, in double precision; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    at = np.asarray(column.offsets, np.int64)
    at = at - at[0]
    size = np.diff(at)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - at[:-1][row]] = flat
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _leaves(classes: DataFrame, seed: int, trees: int, leaf: int, also: tuple[str, ...] = ()) -> DataFrame:
    """classes (and columns `also` of longs), once a tree, with the tree's leaf.

    A leaf is a stretch of a space's codes in order, of about `leaf` vectors by the space's own count: a small space is
    one leaf, and no class is alone in one unless it is alone in its space. Larger leaves are dealt out by hash.
    """
    largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    # finer than leaves, so that stretches can be cut between codes
    depth = int(np.ceil(np.log2(max(largest / leaf, 1)))) + 2 if largest > leaf else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            size = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for tree in range(trees):
                code = np.zeros(len(x), np.int64)
                for d in np.unique(size):
                    planes = np.random.default_rng([seed, tree, int(d)]).standard_normal((int(d), depth))
                    code[size == d] = ((x[size == d][:, :d] @ planes) > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), tree, np.int32)), pa.array(code)], [*batch.schema.names, "tree", "code"])

    kept = "".join(f", {c} long" for c in also)
    placed = classes.select("cid", "space", "embedding", *also).mapInArrow(run, f"cid long, space long, embedding array<double>{kept}, tree int, code long")
    space = Window.partitionBy("tree", "space")
    ordered = space.orderBy("code")
    sizes = placed.groupBy("tree", "space", "code").count()
    sizes = sizes.withColumn("step", F.floor((F.sum("count").over(ordered) - F.col("count")) / leaf))
    step = Window.partitionBy("tree", "space", "step")
    sizes = sizes.withColumn("held", F.sum("count").over(step)).withColumn("first", F.lag("step", 1, -1).over(ordered) != F.col("step"))
    # a stretch of few vectors goes to the one before it, the first one to the one after it
    opens = F.when(F.col("first") & (F.col("held") >= leaf // 4), 1).otherwise(0)
    sizes = sizes.withColumn("stretch", F.greatest(F.lit(1), F.sum(opens).over(ordered)))
    sizes = sizes.withColumn("total", F.sum("count").over(Window.partitionBy("tree", "space", "stretch")))
    parts = F.when(F.col("total") <= 2 * leaf, 1).otherwise(F.ceil(F.col("total") / leaf))
    leaves = placed.join(sizes.select("tree", "space", "code", "stretch", parts.alias("parts")), ["tree", "space", "code"])
    return leaves.withColumn("leaf", F.xxhash64("tree", "space", "stretch", F.pmod(F.xxhash64("cid", "tree", F.lit(seed)), F.col("parts"))))


def _best_of(x: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    k = min(k, len(x) - 1)
    if k < 1:
        return cid[:0], cid[:0], np.zeros(0)
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(x)), k)
    return cid[row], cid[best.reshape(-1)], cosine[row, best.reshape(-1)]


def _listed(pairs: DataFrame, k: int) -> DataFrame:
    """cid, near: the k best of each class's candidates (cid, other, cosine)."""
    once = pairs.groupBy("cid", "other").agg(F.max("cosine").alias("cosine"))
    # an aggregate of bounded lists: a class has at most so many candidates as trees and rounds offer it
    return once.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "other")), asc=False), 1, k).alias("near"))


def started(classes: DataFrame, seed: int, trees: int = TREES, leaf: int = LEAF, k: int = K) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        a, b, c = _best_of(matrix(rows.column("embedding")), np.asarray(rows.column("cid")), k)
        return pa.table([pa.array(a), pa.array(b), pa.array(c)], ["cid", "other", "cosine"])

    return _leaves(classes, seed, trees, leaf).select("leaf", "cid", "embedding").groupBy("leaf").applyInArrow(run, "cid long, other long, cosine double")


def _met(classes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Pairs that are neighbours of one class, or have it as neighbour, and better than the worst of either's list."""
    out = graph.select(F.col("cid").alias("via"), F.explode("near").alias("e")).select("via", F.col("e.other").alias("cid"), F.col("e.cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("via").orderBy(F.desc("cosine"), "cid"))
    back = out.select(F.col("cid").alias("via"), F.col("via").alias("cid"), "cosine").withColumn("rank", rank).where(F.col("rank") <= k).select("via", "cid")
    both = out.select("via", "cid").unionByName(back).distinct()
    worst = F.when(F.size("near") >= k, F.element_at("near", -1)["cosine"]).otherwise(F.lit(-2.0))
    known = classes.select("cid", "embedding").join(graph.select("cid", worst.alias("worst")), "cid")
    rows = both.join(known, "cid").repartition("via").sortWithinPartitions("via")

    def compared(via: np.ndarray, cid: np.ndarray, worst: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(via, prepend=via[0] - 1))
        size = np.diff(np.append(cuts, len(via)))
        found = [], [], []
        for n in np.unique(size):  # groups of a size are one stack of matrices
            at = cuts[size == n][:, None] + np.arange(n)
            cosine = np.matmul(x[at], x[at].transpose(0, 2, 1))
            better = (cosine > np.minimum(worst[at][:, :, None], worst[at][:, None, :])) & ~np.eye(n, dtype=bool)
            g, i, j = np.nonzero(better)
            for part, value in zip(found, (cid[at[g, i]], cid[at[g, j]], cosine[g, i, j]), strict=True):
                part.append(value)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in found], ["cid", "other", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            via = np.asarray(held.column("via"))
            whole = int(np.searchsorted(via, via[-1]))  # the last group may go on
            if whole:
                part = held.slice(0, whole)
                yield compared(via[:whole], np.asarray(part.column("cid")), np.asarray(part.column("worst")), matrix(part.column("embedding")))
                held = held.slice(whole)
        if held is not None:
            yield compared(np.asarray(held.column("via")), np.asarray(held.column("cid")), np.asarray(held.column("worst")), matrix(held.column("embedding")))

    return rows.select("via", "cid", "worst", "embedding").mapInArrow(run, "cid long, other long, cosine double")


def descended(classes: DataFrame, graph: DataFrame | None, seed: int, k: int = K) -> DataFrame:
    """Neighbour lists: those of new trees joined to graph's, then refined until few change."""
    pairs = lambda g: g.select("cid", F.explode("near").alias("e")).select("cid", "e.other", "e.cosine")
    first = started(classes, seed, k=k)
    lists = stored(_listed(first if graph is None else first.unionByName(pairs(graph)), k), "graph")
    total = classes.count()
    for _ in range(ROUNDS):
        following = stored(_listed(pairs(lists).unionByName(_met(classes, lists, k)), k), "graph")
        changed = following.join(lists.withColumnRenamed("near", "old"), "cid").where(F.col("near") != F.col("old")).count()
        released(lists)
        lists = following
        if changed <= STILL * total:
            break
    return lists


def _verified(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        group, side, cid, weight = (np.asarray(rows.column(c)) for c in ("group", "side", "cid", "n"))
        x = matrix(rows.column("embedding"))
        links, edges = np.zeros(len(cid), np.int64), [np.zeros((0, 2), np.int64)]
        order = np.lexsort((side, group))
        cuts = np.flatnonzero(np.diff(group[order], prepend=group[order][0] - 1))
        for first, last in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[first:last]
            a, b = own[side[own] == 0], own[side[own] == 1]
            same = not len(b)
            b = a if same else b
            for i in range(0, len(a), TILE):
                for j in range(i if same else 0, len(b), TILE):
                    p, q = a[i : i + TILE], b[j : j + TILE]
                    found = x[p] @ x[q].T >= threshold
                    if same and i == j:
                        np.fill_diagonal(found, False)
                    links[p] += found @ weight[q]
                    if not same or i != j:
                        links[q] += found.T @ weight[p]
                    edges.append(forest(p, q, *np.nonzero(found)))
        e = np.concatenate(edges)
        root = local_components(len(cid), e[:, 0], e[:, 1])
        return pa.table([pa.array(cid), pa.array(links), pa.array(cid[root])], ["cid", "links", "tie"])

    return run


def _bridges(rows: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Pairs a, b of components that a link ties, found in the leaves of new trees over rows (cid, space, embedding, component)."""

    def run(leaf: pa.Table) -> pa.Table:
        owner, at = np.unique(np.asarray(leaf.column("component")), return_inverse=True)
        if len(owner) < 2:
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        x = matrix(leaf.column("embedding"))
        i, j = np.nonzero((x @ x.T >= threshold) & (at[:, None] < at[None]))
        root = local_components(len(owner), at[i], at[j])
        moved = np.flatnonzero(root != np.arange(len(owner)))
        return pa.table([pa.array(owner[moved]), pa.array(owner[root[moved]])], ["a", "b"])

    leaves = _leaves(rows, seed, TREES, LEAF, also=("component",)).select("leaf", "component", "embedding")
    return leaves.groupBy("leaf").applyInArrow(run, "a long, b long").distinct()


def bridged(classes: DataFrame, lists: DataFrame, ties: DataFrame, threshold: float, seed: int, k: int = K) -> DataFrame:
    """ties (id, component), with components joined that have links beyond their lists.

    A link that neither end lists has a saturated list at either end, so only such classes are searched,
    and only for links to other components, until new trees find none.
    """
    saturated = lists.where((F.size("near") >= k) & (F.element_at("near", -1)["cosine"] >= threshold - 1e-9)).select("cid")
    full = stored(classes.select("cid", "space", "embedding").join(saturated, "cid"), "saturated")
    turn = 0
    while True:
        found = stored(_bridges(full.join(ties.withColumnRenamed("id", "cid"), "cid"), threshold, 1000 * (seed + 1) + turn), "bridges")
        if found.isEmpty():
            return ties
        joined = components(found).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        ties = stored(ties.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component")), "ties")
        turn += 1


def linked_classes(classes: DataFrame, lists: DataFrame, threshold: float, seed: int = 0, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """links of each class that has some, and the components of classes; all links within a tied group are found.

    Each space of `whole` (space) is one group, whose classes are all compared.
    """
    edges = lists.select("cid", F.explode("near").alias("e")).where(F.col("e.cosine") >= threshold - 1e-9).select(F.col("cid").alias("a"), F.col("e.other").alias("b"))
    ties = bridged(classes, lists, stored(components(edges), "ties"), threshold, seed)
    if whole is not None:
        short = classes.join(F.broadcast(whole), "space").select("cid", F.xxhash64("space").alias("component"))
        ties = stored(ties.join(short, ties["id"] == short["cid"], "left_anti").unionByName(short.select(F.col("cid").alias("id"), "component")), "ties")
    members = classes.join(ties.withColumnRenamed("id", "cid"), "cid")
    # A group above a tile is cut into parts by bytes: a member is sent once for each part, and parts grow with the group.
    row = 8 * (classes.agg(F.max(F.size("embedding"))).first()[0] or 1)
    part = F.greatest(F.lit(PART_LEAST), F.least(F.lit(PART_MOST), F.col("size") * row / 16))
    chunks = F.when(F.col("size") <= TILE, 1).otherwise(F.ceil(F.col("size") * row / part)).cast("int")
    members = members.join(ties.groupBy("component").agg(F.count("*").alias("size")), "component").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cid"), chunks).cast("int"))
    pairs = F.explode(F.expr("transform(sequence(0, chunks - 1), o -> named_struct('i', least(o, chunk), 'j', greatest(o, chunk)))"))
    tiles = members.select("cid", "n", "embedding", "component", "chunk", "chunks", pairs.alias("p"))
    group = F.xxhash64("component", "p.i", "p.j")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ties.count() * row // PART_MOST))
    task = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(4 * parts)).cast("long")).otherwise(group)
    side = F.when((F.col("p.i") != F.col("p.j")) & (F.col("chunk") == F.col("p.j")), 1).otherwise(0)
    asked = tiles.select("cid", "n", "embedding", group.alias("group"), side.alias("side"), task.alias("task"))
    compared = stored(asked.groupBy("task").applyInArrow(_verified(threshold), "cid long, links long, tie long"), "links")
    links = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(compared.where("tie <> cid").select(F.col("cid").alias("a"), F.col("tie").alias("b"))).withColumnRenamed("id", "cid")
    return links, groups


def audited(classes: DataFrame, links: DataFrame, threshold: float, most: int = AUDITED) -> list[Row]:
    """space, rows, missed: of a sample of classes, how many there are of a space and how many of them lack links.

    A sample of about `most` classes is compared with all classes of their spaces. It is dealt evenly among
    strata (spaces by classes without links, with few and with many), each of which is taken whole if it is small;
    where there are more strata than that, a stratum is that of spaces whose hashes agree.
    """
    size = F.when(F.col("links") == 0, 0).when(F.col("links") <= K, 1).otherwise(2)
    spaces = F.pmod(F.xxhash64("space"), F.lit(most // 12))
    known = classes.join(links, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("part", spaces).withColumn("size", size)
    strata = known.groupBy("part", "size").count()
    fair, left, todo = 0.0, most, sorted(r["count"] for r in strata.collect())
    for i, n in enumerate(todo):  # what small strata leave over goes to the large ones
        fair = left / (len(todo) - i)
        left -= min(n, fair)
    rate = F.least(F.lit(1.0), F.lit(fair) / F.col("count"))
    sample = known.join(F.broadcast(strata), ["part", "size"]).where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 40)) < rate * float(1 << 40))
    sample = sample.select("cid", "space", "embedding", "links").toArrow()
    ids, own, x = np.asarray(sample.column("cid")), np.asarray(sample.column("space")), matrix(sample.column("embedding"))
    listed = np.asarray(sample.column("links"))
    groups = {int(v): np.flatnonzero(own == v) for v in np.unique(own)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, n, cid, space = matrix(batch.column("embedding")), np.asarray(batch.column("n")), np.asarray(batch.column("cid")), np.asarray(batch.column("space"))
            for v in np.unique(space):
                asked, rows = groups.get(int(v)), np.flatnonzero(space == v)
                if asked is None:
                    continue
                for at in range(0, len(rows), TILE):
                    to = rows[at : at + TILE]
                    width = min(x.shape[1], y.shape[1])  # of one space, vectors have equal lengths: the rest is zeros
                    # products of other shapes may round otherwise: what is on the edge is no lack
                    found = (x[asked, :width] @ y[to, :width].T >= threshold + 1e-9) & (ids[asked][:, None] != cid[to][None])
                    true[asked] += found @ n[to]
        some = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(true[some])], ["at", "true"])

    true = np.zeros(len(ids), np.int64)
    if len(ids):
        found = classes.select("cid", "space", "n", "embedding").mapInArrow(run, "at long, true long").groupBy("at").agg(F.sum("true").alias("true")).toArrow()
        true[np.asarray(found.column("at"))] = np.asarray(found.column("true"))
    missed = listed < true
    return [Row(space=v, rows=len(at), missed=int(missed[at].sum())) for v, at in groups.items()]


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df (vec_id, embedding, label)."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.col("label").cast("string").alias("label"), sound.alias("sound"))
    rows = rows.withColumn("cid", F.when(F.col("sound"), F.xxhash64("label", "embedding")))
    classes = stored(rows.where("sound").groupBy("cid", "label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).select("cid", F.xxhash64("label", F.size("embedding")).alias("space"), "embedding", "n", "least"), "classes")
    lists = None
    exact, whole = set(), None
    for turn in itertools.count():
        if turn < REPEATS:
            lists = descended(classes, lists, seed=turn)
        links, groups = linked_classes(classes, lists, threshold, turn, whole)
        links, groups = stored(links, "class-links"), stored(groups, "class-groups")
        found = audited(classes, links, threshold)
        short = {r.space for r in found if r.missed > (1 - RECALL) * r.rows} - exact
        if not short:
            break
        if turn + 1 >= REPEATS:  # trees do not find their links
            exact |= short
            whole = df.sparkSession.createDataFrame([(v,) for v in exact], "space long")
    known = classes.select("cid", "n", "least").join(links, "cid", "left").join(groups, "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    firsts = known.groupBy("group").agg(F.min("least").alias("first"))
    known = known.join(firsts, "group").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found"), "first")
    done = rows.select("vec_id", "cid").join(known, "cid", "left")
    component = F.coalesce("first", "vec_id")
    done = done.select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return settled(done, "near-duplicates", classes, links, groups, lists)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
