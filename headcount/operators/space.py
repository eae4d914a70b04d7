"""Trees that cut space into cells of a few thousand vectors, however many there are.

A tree is grown in levels. The splits of a level are taken from a hash sample of each cell
that is still too large: for the first level on the driver, for the others by one task per
cell, so what any one place holds is a sample of bounded size. A cell is named by its path,
one number per level, and the trees of a level are a table that is joined by the path
above. Splits run along the axes, or along random directions for `hashed` buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headcount.session import cut_lineage

#: Vectors sampled per cell to place the splits.
SAMPLED = 16
#: Cells that one split tree has at most: a level multiplies the cells by this.
FAN_OUT = 1024
#: Rows that one task takes through a tree, or to a cell.
DESK_ROWS = 20_000


@dataclass
class Splits:
    """A binary tree over space: `low` or `high` below zero is the cell `-child - 1`.

    A node sends points left whose projection on its direction is at most `at`; axis
    splits have unit directions.
    """

    directions: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def cell(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), dtype=np.int64)
        waiting = [(0 if len(self.at) else -1, np.arange(len(points)))]
        while waiting:
            node, who = waiting.pop()
            if node < 0:
                found[who] = -node - 1
            elif len(who):
                left = points[who] @ self.directions[node] <= self.at[node]
                waiting.append((int(self.low[node]), who[left]))
                waiting.append((int(self.high[node]), who[~left]))
        return found

    def reached(self, points: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, gap): the cells no further from each point than its limit.

        Limits and gaps are squared distances; for splits along axes only.
        """
        who_found, cells, gaps = [], [], []
        waiting = [(0 if len(self.at) else -1, np.arange(len(points)), np.zeros(points.shape))]
        while waiting:
            node, who, apart = waiting.pop()
            if node < 0:
                who_found.append(who)
                cells.append(np.full(len(who), -node - 1))
                gaps.append((apart * apart).sum(axis=1))
                continue
            dim = int(np.argmax(self.directions[node]))
            beyond = points[who, dim] - self.at[node]
            for child, outside in ((self.low[node], beyond > 0), (self.high[node], beyond <= 0)):
                moved = apart.copy()
                moved[outside, dim] = np.maximum(moved[outside, dim], np.abs(beyond[outside]))
                touched = (moved * moved).sum(axis=1) <= limits[who]
                if touched.any():
                    waiting.append((int(child), who[touched], moved[touched]))
        if not who_found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return np.concatenate(who_found), np.concatenate(cells), np.concatenate(gaps)

    def boxes(self, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, low, high): the parts of a box that the cells are; for splits along axes only."""
        found = []
        waiting = [(0 if len(self.at) else -1, low, high)]
        while waiting:
            node, low, high = waiting.pop()
            if node < 0:
                found.append((-node - 1, low, high))
                continue
            dim, at = int(np.argmax(self.directions[node])), self.at[node]
            top, bottom = high.copy(), low.copy()
            top[dim], bottom[dim] = min(high[dim], at), max(low[dim], at)
            waiting += [(int(self.low[node]), low, top), (int(self.high[node]), bottom, high)]
        return found

    def row(self) -> dict[str, list]:
        return {
            "directions": self.directions.ravel().tolist(),
            "at": self.at.tolist(),
            "low": self.low.tolist(),
            "high": self.high.tolist(),
        }


SPLITS = "directions array<double>, at array<double>, low array<int>, high array<int>"


def splits_of(row, width: int) -> Splits:
    """The tree that a row of a table of trees holds."""
    return Splits(
        np.asarray(row["directions"], float).reshape(-1, width),
        np.asarray(row["at"], float),
        np.asarray(row["low"], int),
        np.asarray(row["high"], int),
    )


def _between(low: float, high: float) -> float:
    """Half way, so that vectors on either value are as far from the other side as they can be."""
    middle = low + (high - low) / 2
    return middle if low <= middle < high else low


def grow(sample: np.ndarray, cells: int, seed: int | None = None) -> Splits:
    """Halve the sample until there are enough cells.

    Along the widest side, or along a random direction if there is a seed.
    """
    width = sample.shape[1] if sample.ndim == 2 else 1
    draw = None if seed is None else np.random.default_rng(seed)
    directions, at, low, high = [], [], [], []
    made = 0
    # (points, cells wanted, node above, side of it); the top is node 0
    waiting: list[tuple] = [(sample, cells, None, None)]
    while waiting:
        points, wanted, above, side = waiting.pop(0)
        axis = np.zeros(width)
        along = None
        if wanted > 1 and len(points) > 1:
            spread = points.max(axis=0) - points.min(axis=0)
            if spread.max() > 0:
                axis[int(spread.argmax())] = 1.0
                along = points[:, int(spread.argmax())]
                if draw is not None:
                    turned = draw.standard_normal(width)
                    turned /= np.linalg.norm(turned)
                    slanted = points @ turned
                    if slanted.max() > slanted.min():
                        axis, along = turned, slanted
        if along is None:
            made += 1
            child = -made
        else:
            values = np.sort(along)
            middle = values[(len(values) - 1) // 2]
            # a cut at the top value would leave one side empty
            cut = middle if middle < values[-1] else values[values < values[-1]][-1]
            below = along <= cut
            child = len(at)
            directions.append(axis)
            at.append(cut if draw is not None else _between(cut, values[below.sum()]))
            low.append(0)
            high.append(0)
            half = max(1, min(wanted - 1, round(wanted * below.mean())))
            waiting.append((points[below], half, child, low))
            waiting.append((points[~below], wanted - half, child, high))
        if above is not None:
            side[above] = child
    return Splits(
        np.array(directions, dtype=float).reshape(-1, width),
        np.array(at, dtype=float),
        np.array(low, dtype=int),
        np.array(high, dtype=int),
    )


def matrix(vecs: pd.Series) -> np.ndarray:
    return np.array(vecs.tolist(), dtype=float)


@dataclass
class Cells:
    """Where vectors are: `table` has their `cell`, `top` and `trees` say how it is found.

    `trees` has one table for each level below the top: the tree of each cell that is cut.
    """

    table: DataFrame
    top: Splits
    trees: list[DataFrame]


def _wanted(rows: int, cell_rows: int) -> int:
    return min(FAN_OUT, max(1, -(-rows // cell_rows)))


def _drawn(cell_rows: int, seed: Column) -> Column:
    """Whether a vector is among those that place the splits of its cell of `rows` vectors."""
    share = (F.xxhash64("vec", seed).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    wanted = F.least(F.ceil(F.col("rows") / cell_rows), F.lit(FAN_OUT)) * SAMPLED
    return share <= wanted / F.col("rows")


def _sampled(vectors: DataFrame, cell_rows: int, seed: int) -> DataFrame:
    """Of each cell, with its number of vectors in `rows`, those that place its splits."""
    return vectors.where(_drawn(cell_rows, F.lit(seed)))


def seated(rows: DataFrame, hosts: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """`work` on the rows and the hosts of each cell, at most about `DESK_ROWS` rows at a time.

    A cell that many rows go to is copied, and its rows shared out. The rows are few and
    the work on them is long: fixed task numbers keep Spark from merging them by bytes.
    """
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    desks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(DESK_ROWS)).cast("int").alias("desks"))
    dealt = rows.join(desks, "cell").withColumn("desk", F.pmod(F.xxhash64("id"), F.col("desks")).cast("int"))
    copied = hosts.join(desks, "cell").withColumn("desk", F.explode(F.sequence(F.lit(0), F.col("desks") - 1)))
    return (
        dealt.drop("desks")
        .repartition(tasks, "cell", "desk")
        .groupBy("cell", "desk")
        .cogroup(copied.drop("desks").repartition(tasks, "cell", "desk").groupBy("cell", "desk"))
        .applyInPandas(work, schema)
    )


def cells_of(vectors: DataFrame, width: int, cell_rows: int, seed: int, slanted: bool = False) -> Cells:
    """The cells of `vectors` (id, vec), which are distinct.

    Levels are added until no cell has more than twice `cell_rows`. The table is stored.
    """
    rows = vectors.count()
    wanted = _wanted(rows, cell_rows)
    points = np.empty((0, width))
    if wanted > 1:
        sample = _sampled(vectors.withColumn("rows", F.lit(rows)), cell_rows, seed).orderBy("vec")
        points = matrix(sample.select("vec").toPandas()["vec"]).reshape(-1, width)
    top = grow(points, wanted, seed if slanted else None)

    @F.pandas_udf("string")
    def first(vecs: pd.Series) -> pd.Series:
        return pd.Series(top.cell(matrix(vecs)).astype(str) if len(vecs) else [], dtype=object)

    celled, trees = cut_lineage(vectors.withColumn("cell", first("vec"))), []
    while True:
        seed += 1
        sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        large = cut_lineage(sizes.where(F.col("rows") > 2 * cell_rows))
        if large.isEmpty():
            return Cells(celled, top, trees)
        parts = _sampled(celled.join(large, "cell"), cell_rows, seed)
        place = _placing(cell_rows, seed if slanted else None)
        found = cut_lineage(parts.groupBy("cell").applyInPandas(place, f"cell string, {SPLITS}"))
        if found.where(F.size("at") > 0).isEmpty():
            raise ValueError("cells of equal vectors cannot be cut; vectors must be distinct")
        trees.append(found)
        cut = seated(celled.join(large, "cell", "left_semi"), found, _below(width), celled.schema)
        celled = cut_lineage(cut.unionByName(celled.join(large, "cell", "left_anti")))


def buckets_of(vectors: DataFrame, width: int, cell_rows: int, seeds: list[int]) -> DataFrame | None:
    """(id, vec, cell): the buckets of `vectors` in one table for each seed, all cut together.

    A cell is named by its table and its path; each table is cut as `cells_of` with its
    seed along random directions would. Null if one bucket holds all.
    """
    rows = vectors.count()
    wanted = _wanted(rows, cell_rows)
    if wanted == 1:
        return None
    drawn = F.array(*[_drawn(cell_rows, F.lit(s)) for s in seeds])
    sample = vectors.withColumn("rows", F.lit(rows)).select("vec", drawn.alias("drawn"))
    sample = sample.where(F.exists("drawn", lambda x: x)).orderBy("vec").toPandas()
    taken = np.array(sample["drawn"].tolist(), dtype=bool).reshape(-1, len(seeds))
    points = matrix(sample["vec"]).reshape(-1, width)
    tops = [grow(points[taken[:, i]], wanted, seed) for i, seed in enumerate(seeds)]

    @F.pandas_udf("array<long>")
    def first(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        own = matrix(vecs)
        return pd.Series(list(np.column_stack([top.cell(own) for top in tops])))

    celled = vectors.select("id", "vec", F.posexplode(first("vec")).alias("table", "at"))
    celled = cut_lineage(celled.select("id", "vec", F.concat_ws(":", "table", "at").alias("cell")))
    table, turn = F.split("cell", ":")[0].cast("int"), 0
    while True:
        turn += 1
        sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        large = cut_lineage(sizes.where(F.col("rows") > 2 * cell_rows))
        if large.isEmpty():
            return celled
        seed = F.element_at(F.array(*[F.lit(s + turn) for s in seeds]), table + 1)
        parts = celled.join(large, "cell").where(_drawn(cell_rows, seed)).withColumn("seed", seed)
        found = cut_lineage(parts.groupBy("cell").applyInPandas(_placing(cell_rows, "seed"), f"cell string, {SPLITS}"))
        if found.where(F.size("at") > 0).isEmpty():
            raise ValueError("cells of equal vectors cannot be cut; vectors must be distinct")
        cut = seated(celled.join(large, "cell", "left_semi"), found, _below(width), celled.schema)
        celled = cut_lineage(cut.unionByName(celled.join(large, "cell", "left_anti")))


def _placing(cell_rows: int, seed: int | str | None) -> Callable:
    """The tree of a cell from its sample; a seed may be the name of its column."""

    def place(group: pd.DataFrame) -> pd.DataFrame:
        points = matrix(group["vec"])
        points = points[np.lexsort(points.T[::-1])]
        own_seed = int(group[seed].iat[0]) if isinstance(seed, str) else seed
        own = grow(points, _wanted(int(group["rows"].iat[0]), cell_rows), own_seed)
        return pd.DataFrame([{"cell": group["cell"].iat[0]} | own.row()])

    return place


def _below(width: int) -> Callable:
    """The cell below their own for rows of one cell; a cell without a tree stays."""

    def step(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(trees):
            found = splits_of(trees.iloc[0], width).cell(matrix(rows["vec"]))
            rows = rows.assign(cell=[f"{c}.{n}" for c, n in zip(rows["cell"], found, strict=True)])
        return rows.drop(columns="desk")

    return step


BOXES = "cell string, low array<double>, high array<double>"


def boxes_of(cells: Cells, width: int) -> DataFrame:
    """(cell, low, high): the box of each cell, a row per cell."""
    spark = cells.table.sparkSession
    ends = np.full(width, -np.inf), np.full(width, np.inf)
    rows = [(str(c), low.tolist(), high.tolist()) for c, low, high in cells.top.boxes(*ends)]
    found = spark.createDataFrame(rows, BOXES)

    def cut(batches):
        for batch in batches:
            parts = [
                (f"{row['cell']}.{c}", low, high)
                for _, row in batch.iterrows()
                for c, low, high in splits_of(row, width).boxes(np.array(row["low_end"], float), np.array(row["high_end"], float))
            ]
            yield pd.DataFrame(parts, columns=["cell", "low", "high"])

    for trees in cells.trees:
        above = found.withColumnsRenamed({"low": "low_end", "high": "high_end"})
        whole = found.join(trees.select("cell"), "cell", "left_anti")
        found = cut_lineage(above.join(trees, "cell").mapInPandas(cut, BOXES).unionByName(whole))
    return found


VISITS = "id long, vec array<double>, limit double, seen double, cell string, gap double"


def visits(asking: DataFrame, cells: Cells, width: int) -> DataFrame:
    """(id, vec, limit, seen, cell, gap): the cells that each row of `asking` has to see.

    `asking` has id, vec, limit and seen: cells no further than the limit, but for those
    no further than `seen`, in squared distances. The gap to a cell below another is at
    least that to the one above.
    """
    top = cells.top

    def first(batches):
        for batch in batches:
            if len(batch):
                who, cell, gap = top.reached(matrix(batch["vec"]), batch["limit"].to_numpy())
                yield batch.iloc[who].assign(cell=cell.astype(str), gap=gap)

    def further(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="desk")
        if not len(rows) or not len(trees):
            return rows
        who, cell, gap = splits_of(trees.iloc[0], width).reached(matrix(rows["vec"]), rows["limit"].to_numpy())
        out = rows.iloc[who]
        return out.assign(
            cell=[f"{c}.{n}" for c, n in zip(out["cell"], cell, strict=True)], gap=np.maximum(out["gap"].to_numpy(), gap)
        )

    found = asking.select("id", "vec", "limit", "seen").mapInPandas(first, VISITS)
    for trees in cells.trees:
        found = seated(cut_lineage(found), trees, further, VISITS)
    return found.where((F.col("gap") > F.col("seen")) & (F.col("gap") <= F.col("limit")))
