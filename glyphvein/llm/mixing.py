"""Mixing sources to target weights by entropy balancing.

Of all rates r that give each source its target of words, those are taken that change the
documents least in relative entropy, with no rate above the cap. By convex duality they are
r = min(cap, exp(lambda * size / mean size)) with one multiplier per source, found by Newton
steps on the dual, for all sources at once, over the counts of documents by (source, size).
The rates are then rounded into copies: systematically along the sizes, with the rest of each
source settled on small documents. Everything is DataFrame operations.

Null texts have size 0, null sources are one source; documents of size 0 keep one copy; equal
rows may get numbers of copies that differ by one, the same in each run as a set; an empty table
gives an empty result. New columns replace columns of the same name; mixed_documents() adds none.

Error: the rounding along a source's sizes is off by less than one document; in a cell of more than PART documents
each salted part rounds on its own, which adds at most one document of that size a part. Settling takes what is left
off small documents, as far as cells of at most PART documents of 1 to SMALL words go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphvein.llm.common import WORD, released, row_key, stored, table, unused

#: A cell (source, size) with more documents is dealt out in salted parts of about so many.
PART = 2000
#: Most cells that are sent to every task, at about a hundred bytes; of more, each meets its documents in SALTS parts.
FEW_CELLS, SALTS = 200_000, 64
#: Documents up to so many words settle what rounding leaves: bounds the array of a source.
SMALL = 4096


def size_of(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """The target of each source; sources: skey, source, source_size, n, a row each."""
    # Windows over one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    ahead, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sources.withColumn("weight", pick)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("level", level)
        # the water level: the first, by room, that its own source need not cut off
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level")), F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("most") / F.col("weight"))).over(every))
        .select("skey", "source_size", "n", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))
    )


def _tilt(cap: float) -> Column:
    import math

    # at the cap exactly where the exponent reaches it; rounding must not pass it
    return F.when(F.col("lam") * F.col("x") >= math.log(cap), F.lit(cap)).otherwise(F.exp(F.col("lam") * F.col("x")))


def balanced(cells: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """skey and lam for each source: damped Newton on the dual, one grouped sum a step, kept inside a bracket."""
    import math

    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    state = sources.where("source_size > 0").select(
        "skey", "target", mean.alias("mean"), F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), math.log(cap) * mean).otherwise(0.0).alias("lam"),
        (-50.0 * mean).alias("lo"), (math.log(cap) * mean).alias("hi"), F.lit(False).alias("done"),
    )
    state = stored(state, "mixing-state")
    live = cells.where("size > 0").select("skey", "size", "n")
    for _ in range(most_steps):
        x = F.col("size") / F.col("mean")
        tilted = live.join(state.where("NOT done"), "skey").withColumn("x", x).withColumn("words", F.col("n") * F.col("size") * _tilt(cap))
        sums = tilted.groupBy("skey").agg(F.sum("words").alias("total"), F.sum(F.when(F.col("lam") * F.col("x") < math.log(cap), F.col("words") * F.col("x"))).alias("slope"))
        at = state.join(sums, "skey", "left")
        gap = F.log("total") - F.log("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap * F.col("total") / F.col("slope")
        met = F.col("done") | (F.abs(F.col("total") - F.col("target")) <= tolerance * F.col("target"))
        following = at.select(
            "skey", "target", "mean", F.when(met, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2).alias("lam"),
            F.when(met, F.col("lo")).otherwise(lo).alias("lo"), F.when(met, F.col("hi")).otherwise(hi).alias("hi"), (met | (hi - lo < 1e-14)).alias("done"),
        )
        following = stored(following, "mixing-state")
        released(state)
        state = following
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"sources are not balanced after {most_steps} steps")
    return state.select("skey", "mean", "lam")


def rounded(cells: DataFrame, cap: float) -> DataFrame:
    """cells with `base` copies for each document and `more`: copies beyond those, over the whole cell.

    cells: skey, size, n, rate, target. Along the sizes of a source the fractions add up and each whole
    number passed is one copy, so the error stays below one document; it is then settled on small ones.
    """
    whole = F.floor("rate")
    cells = cells.withColumn("base", whole).withColumn("due", F.col("n") * (F.col("rate") - whole)).withColumn("band", F.floor(4 * F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
    bands = cells.groupBy("skey", "band").agg(F.sum("due").alias("band_due"))
    bands = bands.withColumn("before", F.coalesce(F.sum("band_due").over(Window.partitionBy("skey").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = Window.partitionBy("skey", "band").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("due").over(inside)
    cells = cells.join(bands, ["skey", "band"]).withColumn("upto", upto)
    more = F.least(F.col("n"), F.greatest(F.lit(0), F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("due") + 0.5)))
    cells = stored(cells.select("skey", "size", "n", "rate", "target", "base", more.cast("long").alias("more")), "mixing-cells")
    missing = cells.groupBy("skey").agg(
        (F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("more")))).alias("gap"),
        F.sort_array(F.collect_list(F.when((F.col("size").between(1, SMALL)) & (F.col("n") <= PART), F.struct("size", "n", "base", "more"))), asc=False).alias("small"),
    )
    # the largest that fit, as many as there are; a copy is added below the cap, taken away above none
    settle = F.expr(
        f"""aggregate(small, named_struct('gap', gap, 'done', array_repeat(named_struct('size', 0L, 'change', 0L), 0)), (a, c) ->
            named_struct('gap', a.gap - c.size * CASE WHEN a.gap >= 0
                    THEN least(floor((a.gap + c.size * 0.5) / c.size), c.n * ({int(cap)} - c.base) - c.more) * 1.0D
                    ELSE -least(floor((c.size * 0.5 - a.gap) / c.size), c.more + c.n * c.base) * 1.0D END,
                'done', concat(a.done, array(named_struct('size', c.size, 'change', CASE WHEN a.gap >= 0
                    THEN least(floor((a.gap + c.size * 0.5) / c.size), c.n * ({int(cap)} - c.base) - c.more)
                    ELSE -least(floor((c.size * 0.5 - a.gap) / c.size), c.more + c.n * c.base) END)))),
            a -> filter(a.done, d -> d.change <> 0))"""
    )
    changes = missing.select("skey", F.explode(settle).alias("c")).select("skey", "c.size", "c.change")
    return cells.join(changes, ["skey", "size"], "left").withColumn("more", F.col("more") + F.coalesce("change", F.lit(0))).drop("change")


def planned(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """The plan's row for each document. A cell may hold a third of all documents (empty texts of one source): none is gathered in one task."""
    if few:
        return sized.join(F.broadcast(plan), ["skey", "size"])
    salted = sized.withColumn("part", F.pmod(F.xxhash64("key", F.lit(13)), F.lit(SALTS)).cast("int"))
    return salted.join(plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["skey", "size", "part"]).drop("part")


def copies(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sized (key, source, size) with source_size, target, rate, copies."""
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    cells = stored(sized.groupBy("skey", "source", "size").count().withColumnRenamed("count", "n"), "mixing-counts")
    per_source = cells.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    sources = stored(source_targets(per_source, weights, share, cap), "mixing-sources")
    lam = balanced(cells, sources, cap)
    tilted = cells.select("skey", "size", "n").join(sources.drop("n"), "skey").join(lam, "skey", "left")
    tilted = tilted.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", F.when((F.col("size") == 0) | F.col("lam").isNull(), F.lit(1.0)).otherwise(_tilt(cap)))
    plan = rounded(tilted.select("skey", "size", "n", "rate", "target"), cap).drop("target").join(sources.drop("n"), "skey")
    plan = stored(plan, "mixing-plan")
    docs = planned(sized, plan, plan.count() <= FEW_CELLS)
    parts = F.ceil(F.col("n") / PART)
    docs = docs.withColumn("order", F.xxhash64("key", F.lit(11))).withColumn("salt", F.pmod(F.xxhash64("key", F.lit(12)), parts))
    cell = Window.partitionBy("skey", "size", "salt")
    rank = F.row_number().over(cell.orderBy("order", "key"))
    jitter = F.pmod(F.xxhash64("skey", "size", "salt"), F.lit(1 << 20)) / (1 << 20)
    docs = docs.withColumn("rank", rank).withColumn("here", F.count("*").over(cell))
    chosen = F.when(parts <= 1, F.col("more")).otherwise(F.floor(F.col("here") * F.col("more") / F.col("n") + jitter))
    docs = docs.withColumn("chosen", chosen.cast("long"))
    got = F.col("base") + F.floor(F.col("chosen") / F.col("here")) + (F.col("rank") <= F.pmod("chosen", "here")).cast("int")
    return docs.withColumn("copies", F.least(F.greatest(got, F.lit(0)), F.lit(int(cap))).cast("int")).drop("skey", "salt", "order", "chosen", "rank", "here", "base", "more", "n")


def mixed_documents(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of df as often as it was given copies."""
    names, key, times, first, again = df.columns, *(unused(df, x) for x in ("key", "copies", "first", "again"))
    keyed = df.withColumn(key, row_key("doc_id", "text"))
    given = copies(stored(keyed.select(F.col(key).alias("key"), "source", size_of().alias("size")), "mixing-sized"), weights, share, cap)
    totals = given.groupBy("key").agg(F.sum("copies").alias(times)).withColumnRenamed("key", key)
    # Equal rows share a key: the first of them, by a hash of the row, stands for all of their copies.
    least = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*names))) == 1
    dealt = keyed.join(totals.hint("merge"), key).withColumn(first, least).where(F.col(first) & (F.col(times) > 0))
    return dealt.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("key"), "source", size_of().alias("size")), "mixing-sized")
    given = copies(sized)
    return given.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
