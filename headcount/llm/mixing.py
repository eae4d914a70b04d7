"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

1. Targets: weights share out the wanted words; no source gives more than a stated
   multiple of its size, and what it cannot give is shared again by weight.
2. A source is a tape of its documents in permuted order, laid out once per copy. The
   mix takes the tape up to the target, so a source gives each document equally often
   but for the last copy. Long documents are cut off first and short ones make up the
   rest, so the miss is at most half a document of average length.
3. What a source gives is cut into blocks, and the blocks of all sources are dealt to
   the output shards: a node of the tree splits its quota of every source in two by
   drawing without replacement, until each leaf is a shard. Quotas are exact.
4. A shard draws its own range of each source's permuted blocks, disjoint from all
   others, and shuffles what they hold.

All steps are column expressions and windows; the tables of sources and of quotas have
a row per source, and every draw is a hash, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headcount.session import Scratch

#: Rows of a source's tape that one task lays out.
BLOCK_ROWS = 50_000
#: Blocks that an output shard draws, on average.
SHARD_BLOCKS = 32

#: Sources up to which their table is broadcast; it has a row per source.
BROADCAST_SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def sizes(docs: DataFrame, identity: list[str]) -> DataFrame:
    """(doc_id, source, size, mark, n): rows that agree in `identity` too are counted."""
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(*identity).alias("mark"),
        )
        .groupBy("doc_id", "source", "size", "mark")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: place, weight, rows, source_size, target.

    Sources in order of code points, null last, take the weights in turn. The level of
    words per weight is the first at which the next source, by what it can give per
    weight, is not above its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    per_source = (
        sized.groupBy("source")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.col("size") * F.col("n")).alias("source_size"),
        )
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(given, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("reach", F.col("cap") / F.col("weight"))
    )
    by_reach = Window.orderBy("reach", "place")
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return (
        per_source.withColumn("level", level)
        .withColumn(
            "water",
            F.min_by(
                F.when(F.col("reach") >= F.col("level"), F.col("level")),
                F.when(F.col("reach") >= F.col("level"), F.col("reach")),
            ).over(everything),
        )
        .withColumn(
            "target",
            F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")),
        )
        .select("source", "place", "weight", "rows", "source_size", "target")
    )


def _small(per_source: DataFrame, count: int) -> DataFrame:
    """A table with a row per source, to be broadcast if `count` of them are few."""
    return F.broadcast(per_source) if count <= BROADCAST_SOURCES else per_source


def _tapes(sized: DataFrame, sources: DataFrame, count: int, seed: int) -> DataFrame:
    """Each row's start on its tape: long and short documents of a source have one each."""
    placed = (
        sized.join(_small(sources, count), sized["source"].eqNullSafe(sources["source"]))
        .drop(sources["source"])
        .withColumn("long", F.col("size") * F.col("rows") > F.col("source_size"))
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "mark", "size"))
        .withColumn(
            "block",
            F.pmod(
                F.shiftrightunsigned("order", 16),
                F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)).cast("long"),
            ),
        )
    )
    words = F.col("size") * F.col("n")
    within = Window.partitionBy("place", "long", "block").orderBy("order", "doc_id", "mark", "size")
    tape = placed.withColumn(
        "start",
        F.coalesce(
            F.sum(words).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    before = Window.partitionBy("place", "long").orderBy("block")
    offsets = (
        placed.groupBy("place", "long", "block")
        .agg(F.sum(words).alias("words"))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("words").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("tape", F.sum("words").over(Window.partitionBy("place", "long")))
        .drop("words")
    )
    return (
        tape.join(offsets, ["place", "long", "block"])
        .withColumn("start", F.col("start") + F.col("offset"))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("start", F.col("start") + F.col("i") * F.col("size"))
        .select("doc_id", "place", "size", "mark", "order", "long", "start", "tape")
    )


def _copies(target: Column, most: float) -> Column:
    """How often the tape up to `target` passes the middle of a row."""
    middle = F.col("start") + F.col("size") / F.lit(2.0)
    passes = F.when(
        F.col("tape") > 0,
        F.ceil((target - middle) / F.col("tape")),
    ).otherwise(F.when(target > 0, F.lit(1)).otherwise(F.lit(0)))
    return F.least(F.greatest(passes, F.lit(0)), F.lit(math.floor(most))).cast("int")


def draw(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 16,
    seed: int = 7,
    identity: list[str] | None = None,
) -> DataFrame:
    """One row per row of `docs`: how often the mix takes it, and into which shards.

    Columns: doc_id, source, size (words; null text: 0), mark (hash of `identity`, which
    is the text unless told otherwise),
    source_size, target (double), copies (int, at most `most`), taken (copies * size),
    shards (array of int, one for each copy). Null is a source of its own, last in
    order. Rows that agree in all of these are counted before the shuffle and then taken
    one by one. If no text has a word, all targets are 0. Other columns of `docs` are not read; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized, _ = scratch.keep(sizes(docs, identity or ["text"]))
    sources, _ = scratch.keep(targets(sized, weights, share, most))
    count = sources.count()
    tape, _ = scratch.keep(_tapes(sized, sources, count, seed))
    goals = tape.groupBy("place").agg(
        F.coalesce(F.max(F.when(F.col("long"), F.col("tape"))), F.lit(0)).alias("long_words")
    )
    plan = sources.join(goals, "place").withColumn(
        "long_target",
        F.when(
            F.col("source_size") > 0,
            F.col("target") * F.col("long_words") / F.col("source_size"),
        ).otherwise(0.0),
    )
    given = (
        tape.where("long")
        .join(_small(plan.select("place", "long_target"), count), "place")
        .groupBy("place")
        .agg(F.sum(_copies(F.col("long_target"), most) * F.col("size")).alias("given"))
    )
    plan = plan.join(given, "place", "left").withColumn(
        "short_target", F.col("target") - F.coalesce("given", F.lit(0))
    )
    goal = F.when(F.col("long"), F.col("long_target")).otherwise(F.col("short_target"))
    taken = (
        tape.join(_small(plan, count), "place")
        .withColumn("copies", _copies(goal, most))
        .select(
            "doc_id", "source", "place", "size", "mark", "order", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )
    leaves = splitting_tree(_quotas(plan, shards), shards, seed)
    quota = F.element_at("edges", -1)

    def shard_of(copy: Column) -> Column:
        block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("order"), copy), quota)
        return F.size(F.filter("edges", lambda edge: edge <= block))

    return taken.join(_small(leaves, count), "place").select(
        "doc_id",
        "source",
        "size",
        "mark",
        "source_size",
        "target",
        "copies",
        "taken",
        F.when(
            F.col("copies") > 0, F.transform(F.sequence(F.lit(1), F.col("copies")), shard_of)
        )
        .otherwise(F.array().cast("array<int>"))
        .alias("shards"),
    )


def _quotas(plan: DataFrame, shards: int) -> DataFrame:
    """(place, quota): the blocks that each source gives, at least one."""
    total = F.sum("target").over(Window.partitionBy())
    return plan.select(
        F.col("place").cast("int").alias("place"),
        F.greatest(
            F.ceil(
                F.when(total > 0, F.col("target") / total).otherwise(0.0)
                * F.lit(shards * SHARD_BLOCKS)
            ),
            F.lit(1),
        )
        .cast("long")
        .alias("quota"),
    )


def _splitter(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """Draws what a node's left child gets of one source, and keeps the rest of the state."""

    def split(state: Column, source: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            chance = _uniform(F.lit(seed), F.lit(level), F.col("first"), source["place"], i)
            hit = F.when(chance * at["stock"] < at["wanted"], 1).otherwise(0).cast("long")
            return F.struct(
                (at["stock"] - 1).alias("stock"),
                (at["wanted"] - hit).alias("wanted"),
                (at["got"] + hit).alias("got"),
            )

        start = F.struct(
            state["stock"].alias("stock"),
            state["wanted"].alias("wanted"),
            F.lit(0).cast("long").alias("got"),
        )
        units = F.when(
            source["quota"] > 0, F.sequence(F.lit(1).cast("long"), source["quota"])
        ).otherwise(F.array().cast("array<long>"))
        done = F.aggregate(units, start, one)
        drawn = F.array(F.struct(source["place"].alias("place"), done["got"].alias("quota")))
        return F.struct(
            done["stock"].alias("stock"),
            done["wanted"].alias("wanted"),
            F.concat(state["left"], drawn).alias("left"),
        )

    return split


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, edges): where each shard's range of the source's blocks ends.

    A node holds the quotas of all sources and a number of shards. It draws its left
    child's blocks from its own without replacement, one block at a time with the
    probability of what is still wanted over what is still there, which is exactly the
    multivariate hypergeometric law. The rest is the right child's. The work per level
    is the number of blocks, `SHARD_BLOCKS` a shard.
    """
    pair = "struct<place:int,quota:long>"
    nodes = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("quotas")
    )
    nodes = nodes.select(
        F.lit(0).alias("first"), F.lit(shards).alias("width"), F.col("quotas").cast(f"array<{pair}>")
    )
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        half = F.floor(F.col("width") / 2).cast("int")
        stock = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, s: a + s["quota"])
        wanted = F.floor((stock * half + F.floor(F.col("width") / 2)) / F.col("width")).cast("long")

        begin = F.struct(
            stock.alias("stock"), wanted.alias("wanted"), F.array().cast(f"array<{pair}>").alias("left")
        )
        nodes = nodes.withColumn("left", F.aggregate("quotas", begin, _splitter(seed, level), lambda a: a["left"]))
        right = F.zip_with(
            "quotas",
            "left",
            lambda q, x: F.struct(q["place"].alias("place"), (q["quota"] - x["quota"]).alias("quota")),
        )
        children = F.array(
            F.struct(F.col("first"), half.alias("width"), F.col("left").alias("quotas")),
            F.struct(
                (F.col("first") + half).alias("first"),
                (F.col("width") - half).cast("int").alias("width"),
                right.alias("quotas"),
            ),
        )
        leaf = F.array(F.struct(F.col("first"), F.col("width"), F.col("quotas")))
        nodes = (
            nodes.withColumn("child", F.explode(F.when(F.col("width") > 1, children).otherwise(leaf)))
            .select("child.*")
            .select("first", "width", F.col("quotas").cast(f"array<{pair}>"))
        )
    flat = nodes.select("first", F.explode("quotas").alias("s")).select("first", "s.*")
    running = Window.partitionBy("place").orderBy("first")
    return (
        flat.withColumn("edge", F.sum("quota").over(running))
        .groupBy("place")
        .agg(F.sort_array(F.collect_list(F.struct("first", "edge")))["edge"].alias("edges"))
    )


def mixture(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 7,
    names: tuple[str, str] = ("shard", "shuffle_key"),
    **law: object,
) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken.

    Adds under `names` the shard and the order inside it; columns of these names are
    replaced. Equal rows travel once and are repeated by the draw. Columns must have a
    hash, which rules out maps.
    """
    own = docs.columns
    key = ["doc_id", "source", "mark"]
    plan = draw(docs, shards=shards, seed=seed, identity=own, **law)
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64(*own).alias("mark"),
            F.struct(*own).alias("row"),
        )
        .groupBy(*key)
        .agg(F.first("row").alias("row"))
    )
    plan = plan.where(F.col("copies") > 0).select(*[F.col(k).alias(f"p_{k}") for k in key], "shards")
    same = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in key]
    return (
        rows.join(plan, same[0] & same[1] & same[2])
        .select("row", "mark", F.posexplode("shards").alias("copy", "drawn"))
        .select(
            *[F.col("row")[n].alias(n) for n in own if n not in names],
            F.col("drawn").alias(names[0]),
            F.xxhash64(F.lit(seed + 2), "row.doc_id", "mark", "copy", "drawn").alias(names[1]),
        )
    )
