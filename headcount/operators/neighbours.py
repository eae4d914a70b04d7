"""Nearest neighbours between the distinct vectors of a table, exact or by hashed buckets.

Exact: space is split into cells of about equal numbers of vectors (`space`). A vector
first finds neighbours in its own cell, which bounds how far the true ones can be; then
it visits the cells that its ball reaches, the nearest first, in rounds with a reach that
shrinks as neighbours are found. No pair outside those cells is looked at, and none is
left out.

Hashed: several tables of buckets, cut along random directions, each give a vector the
best of its bucket; the best of all tables are kept. A vector that meets too few others in
its buckets widens its reach by the exact search. The work is rows times buckets' size
times tables, whatever the number of features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headcount.operators import space
from headcount.operators.space import matrix
from headcount.session import cut_lineage

# Vectors per cell, and per bucket of a hashed table.
CELL_ROWS = 2000
BUCKET_ROWS = 2000
# Hashed tables.
TABLES = 16
# Shares of the reach, as distances, that the rounds of visits go to.
ROUNDS = (0.5, 0.75, 1.0)
# Cells that a vector without enough neighbours yet visits, by the first round; eight
# times as many in each later one.
FIRST_CELLS = 8
# A vector whose ball reaches no more cells than these goes to all of them at once.
DIRECT_CELLS = 8
# Distances that a task holds at a time.
BATCH_DISTANCES = 512_000

_ENTRY = "struct<square: double, vec: array<double>, sizes: array<bigint>>"
_NEAR = "array<struct<square: double, id: bigint>>"


def _closest(queries: np.ndarray, points: np.ndarray, k: int, reach: np.ndarray | None = None):
    """The `k` closest points of each query within its squared `reach`.

    Returns query index, point index and squared distance, in this order and by
    distance; equal distances come in vector order, in which the points are
    sorted. A matrix product finds the candidates, with a margin for its
    rounding, and only they are measured exactly. Without `reach` the queries are
    the points, and a point is not its own neighbour.
    """
    norms = np.einsum("ij,ij->i", points, points)
    # one product gives the squares less the query's own, without matrices in between
    sides = np.vstack([-2.0 * points.T, norms])
    found = []
    size = max(1, BATCH_DISTANCES // len(points))
    for start in range(0, len(queries), size):
        batch = queries[start : start + size]
        own = np.einsum("ij,ij->i", batch, batch)
        rough = np.column_stack([batch, np.ones(len(batch))]) @ sides
        margin = 2e-9 * (own + norms.max(initial=0.0) + 1e-30)
        limit = np.full(len(batch), np.finfo(float).max)
        if reach is None:
            at = np.arange(len(batch))
            rough[at, start + at] = np.inf
        else:
            limit = np.minimum(limit, reach[start : start + size] - own)
        if k < len(points) and not np.all(limit < np.finfo(float).max):
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
        who, which = np.nonzero(rough <= (limit + margin)[:, None])
        squares = np.zeros(len(who))
        for d in range(points.shape[1]):
            gap = batch[who, d] - points[which, d]
            squares += gap * gap
        order = np.lexsort((which, squares, who))
        who, which, squares = who[order], which[order], squares[order]
        # Place of each entry among those of its query.
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < k
        found.append((who[kept] + start, which[kept], squares[kept]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _points(rows: pa.Table, name: str) -> np.ndarray:
    """The vectors of a column as a matrix."""
    column = rows[name].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _in_order(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    frame = frame.sort_values("id", kind="stable").reset_index(drop=True)
    return frame, matrix(frame["vec"])


def _at_home(k: int):
    """The neighbours of each vector of a cell within it, and the reach that follows.

    The reach is the square of the last neighbour's distance, if there are `k`, and a
    little more, so that rounding hides no tie. A vector whose ball stays inside the box
    of the cell has seen all.
    """

    def meet(rows: pa.Table, boxes: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        count, reach, seen = np.zeros(len(rows), dtype=np.int64), np.empty(0), np.empty(0)
        which, squares = np.empty(0, dtype=np.int64), np.empty(0)
        if len(rows):
            points = _points(rows, "vec")
            who, which, squares = _closest(points, points, k)
            count = np.bincount(who, minlength=len(points))
            ends = np.cumsum(count)
            reach = np.full(len(points), np.inf)
            reach[count == k] = squares[ends[count == k] - 1] * (1 + 1e-9)
            low, high = _points(boxes, "low")[0], _points(boxes, "high")[0]
            inside = np.minimum(points - low, high - points).min(axis=1) ** 2 > reach
            seen = np.where(inside, reach, -1.0)
        entries = pa.StructArray.from_arrays([pa.array(squares), rows["id"].combine_chunks().take(pa.array(which))], ["square", "id"])
        starts = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(starts), entries)
        return rows.append_column("near", near).append_column("reach", pa.array(reach)).append_column("seen", pa.array(seen))

    return meet


def _home(cells: space.Cells, k: int, width: int) -> DataFrame:
    """(id, vec, cell, near, reach, seen) of all vectors."""
    tasks = 4 * int(cells.table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"id long, vec array<double>, cell string, near {_NEAR}, reach double, seen double"
    boxes = space.boxes_of(cells, width)
    return (
        cells.table.select("id", "vec", "cell")
        .repartition(tasks, "cell")
        .groupBy("cell")
        .cogroup(boxes.repartition(tasks, "cell").groupBy("cell"))
        .applyInArrow(_at_home(k), schema)
    )


def _bucket_entries(k: int):
    """(id, square, other): the neighbours of each vector of a bucket within it."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame, points = _in_order(frame)
        who, which, squares = _closest(points, points, k)
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"id": ids[who], "square": squares, "other": ids[which]})

    return meet


def _abroad(k: int):
    def meet(visitors: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(hosts):
            return pd.DataFrame({"id": [], "square": [], "other": []})
        hosts, points = _in_order(hosts)
        who, which, squares = _closest(
            matrix(visitors["vec"]), points, k + 1, visitors["reach"].to_numpy()
        )
        own, other = visitors["id"].to_numpy()[who], hosts["id"].to_numpy()[which]
        kept = own != other
        return pd.DataFrame({"id": own[kept], "square": squares[kept], "other": other[kept]})

    return meet


def _best(entries: DataFrame, k: int) -> DataFrame:
    """(id, near): the `k` nearest of (id, square, other), ranked before they are gathered."""
    place = F.row_number().over(W.partitionBy("id").orderBy("square", "other"))
    return (
        entries.withColumn("_place", place)
        .where(F.col("_place") <= k)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("square", F.col("other").alias("id")))).alias("near"))
    )


def _entries(near: DataFrame) -> DataFrame:
    return near.select("id", F.explode("near").alias("e")).select("id", "e.square", F.col("e.id").alias("other"))


def _search(state: DataFrame, cells: space.Cells, width: int, k: int) -> DataFrame:
    """(id, near): the exact neighbours, from (id, vec, cell, near, reach, seen) after home.

    `seen` is how far a vector has looked. It is done when that is its reach, or when
    there are no more cells; rounds end when all are.
    """
    top = cells.top

    def nearest_cells(count: int):
        @F.pandas_udf("double")
        def limit(vecs: pd.Series, seen: pd.Series) -> pd.Series:
            found = np.full(len(vecs), np.inf)
            if len(vecs):
                points = matrix(vecs)
                who, _, gaps = top.reached(points, found)
                for i in range(len(points)):
                    beyond = np.sort(gaps[(who == i) & (gaps > seen.iat[i])])
                    if len(beyond) > count:
                        found[i] = beyond[count - 1]
            return pd.Series(found)

        return limit

    @F.pandas_udf("boolean")
    def few(vecs: pd.Series, reach: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=bool)
        who, _, _ = top.reached(matrix(vecs), reach.to_numpy())
        return pd.Series(np.bincount(who, minlength=len(vecs)) <= DIRECT_CELLS)

    done, turn = [], 0
    infinite = F.lit(float("inf"))
    none = F.array().cast(_NEAR)
    while True:
        state = cut_lineage(state)
        finished = F.col("seen") >= F.col("reach")
        done.append(state.where(finished).select("id", "near"))
        active = state.where(~finished)
        if active.isEmpty():
            break
        share = ROUNDS[min(turn, len(ROUNDS) - 1)] ** 2
        known = active.where(F.col("reach") < infinite).withColumn(
            "limit",
            F.when(few("vec", "reach"), F.col("reach")).otherwise(F.greatest(F.col("reach") * share, F.col("seen"))),
        )
        lost = active.where(F.col("reach") == infinite)
        lost = lost.withColumn("limit", nearest_cells(FIRST_CELLS ** (turn + 1))("vec", "seen"))
        active = cut_lineage(known.unionByName(lost))
        away = space.visits(active, cells, width).withColumnRenamed("cell", "to")
        away = away.join(active.select("id", "cell", "reach"), "id").where(F.col("to") != F.col("cell"))
        away = cut_lineage(away.select("id", "vec", "reach", F.col("to").alias("cell")))
        met = space.seated(away, cells.table, _abroad(k), "id long, square double, other long")
        best = _best(_entries(active).union(met), k)
        last = F.col("near")[k - 1]["square"] * F.lit(1 + 1e-9)
        state = (
            active.drop("near")
            .join(best, "id", "left")
            .withColumn("near", F.coalesce("near", none))
            .select(
                "id",
                "vec",
                "cell",
                "near",
                F.when(F.size("near") >= k, last).otherwise(infinite).alias("reach"),
                F.col("limit").alias("seen"),
            )
        )
        turn += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def _numbered(vectors: DataFrame) -> DataFrame:
    """`vectors` with ids that rise in vector order, so ties by id are ties by vector."""
    return cut_lineage(vectors.orderBy("vec").withColumn("id", F.monotonically_increasing_id()))


def _named(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """(vec, neighbours) from (id, near)."""
    others = numbered.select(F.col("id").alias("other"), F.col("vec").alias("near"), "sizes")
    near = (
        _entries(found)
        .join(others, "other")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("square", F.col("near").alias("vec"), "sizes"))).alias("neighbours"))
    )
    none = F.array().cast(f"array<{_ENTRY}>")
    return numbered.join(near, "id", "left").select("vec", F.coalesce("neighbours", none).alias("neighbours"))


def _width(vectors: DataFrame) -> int:
    first = vectors.select(F.size("vec").alias("n")).first()
    return first["n"] if first else 1


def nearest_vectors(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """`vec` and `neighbours`: its `k` nearest other vectors, nearest first.

    `vectors` has distinct `vec` (array of double) and `sizes` (array of bigint,
    passed along). Equal distances come in vector order.
    """
    numbered = _numbered(vectors)
    return _named(numbered, _exact(numbered, k, seed))


def _exact(numbered: DataFrame, k: int, seed: int, asking: DataFrame | None = None) -> DataFrame:
    """(id, near) of all vectors, or of the ids in `asking`, which start without a home."""
    width = _width(numbered)
    cells = space.cells_of(numbered.select("id", "vec"), width, CELL_ROWS, seed)
    if asking is None:
        home = _home(cells, k, width)
        if not len(cells.top.at) and not cells.trees:
            return home.select("id", "near")
    else:
        home = numbered.join(asking, "id", "left_semi").select(
            "id", "vec", F.lit("").alias("cell"), F.array().cast(_NEAR).alias("near"), F.lit(float("inf")).alias("reach"), F.lit(-1.0).alias("seen")
        )
    return _search(home, cells, width, k)


def hashed_vectors(
    vectors: DataFrame, k: int, seed: int = 42, tables: int | None = None, bucket_rows: int | None = None
) -> DataFrame:
    """As `nearest_vectors`, with the best neighbours that buckets of like vectors hold.

    Each of the `tables` tables (`TABLES` by default) cuts space along other random
    directions into buckets of about `bucket_rows` vectors (`BUCKET_ROWS`). What a vector is given are true
    distances; some of the `k` may not be the nearest, but there are never fewer.
    """
    numbered = _numbered(vectors)
    width = _width(numbered)
    seeds = [seed + 1000 * (table + 1) for table in range(tables or TABLES)]
    buckets = space.buckets_of(numbered.select("id", "vec"), width, bucket_rows or BUCKET_ROWS, seeds)
    if buckets is None:  # one bucket holds all
        whole = numbered.select("id", "vec", F.lit("").alias("cell"))
    else:
        whole = buckets
    tasks = 4 * int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = (
        whole.repartition(tasks, "cell")
        .groupBy("cell")
        .applyInPandas(_bucket_entries(k), "id long, square double, other long")
    )
    # at most `k` entries of a vector from each table; a pair has one distance in all
    entry = F.struct("square", F.col("other").alias("id"))
    best = cut_lineage(near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("near")))
    if buckets is None:
        return _named(numbered, best)
    met = best.where(F.size("near") >= k)
    few = cut_lineage(numbered.select("id").join(met, "id", "left_anti"))
    if not few.isEmpty():
        best = met.unionByName(_exact(numbered, k, seed, few))
    return _named(numbered, best)


#: Ways to find neighbours.
METHODS = {"exact": nearest_vectors, "hashed": hashed_vectors}
