"""Squarified treemaps: areas equal weights, level by level or a whole small repository at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.sources.storage import staged

PLACED = "repo_id string, path string, x double, y double, w double, h double"
#: Repositories with fewer nodes are laid out by one task each.
WHOLE_NODES = 200_000


def ratio(total: float, low: float, high: float, side: float) -> float:
    """The worst aspect ratio of a row with this sum, least and greatest area along a side: max(s^2 R+ / t^2, t^2 / (s^2 R-))."""
    if total <= 0 or side <= 0:
        return math.inf
    s2, t2 = side * side, total * total
    return max(s2 * high / t2, t2 / (s2 * low) if low > 0 else math.inf)


def squarify(areas: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """A cell for each area, in order, in the rectangle: the squarified treemap of Bruls, Huizing and van Wijk.

    A row lies along the shorter side (across the width when width <= height) and takes the next area as long as its
    worst aspect ratio doesn't grow.
    """
    cells: list[tuple[float, float, float, float]] = []
    row: list[float] = []
    total = low = high = worst = 0.0

    def lay_down() -> None:
        nonlocal x, y, w, h
        across, side = w <= h, min(w, h)
        thick, run = total / side if side > 0 else 0.0, 0.0
        for a in row:
            length = a / thick if thick > 0 else 0.0
            cells.append((x + run, y, length, thick) if across else (x, y + run, thick, length))
            run += length
        if across:
            y, h = y + thick, max(h - thick, 0.0)
        else:
            x, w = x + thick, max(w - thick, 0.0)

    for a in areas:
        if row:
            grown = ratio(total + a, min(low, a), max(high, a), min(w, h))
            if grown <= worst:
                row.append(a)
                total, low, high, worst = total + a, min(low, a), max(high, a), grown
                continue
            lay_down()
        row, total, low, high = [a], a, a, a
        worst = ratio(a, a, a, min(w, h))
    if row:
        lay_down()
    return cells


class Squarifier:
    """The same treemap of areas that come in descending order, in parts: it holds the row that isn't ended and no more.

    Prefix sums give any row's total. Along a row the ratio falls while its thinnest side is the row's own and grows once
    it is a cell's, so a row's end lies where the two meet, which doubling steps and halving find.
    """

    def __init__(self, x: float, y: float, w: float, h: float):
        self.x, self.y, self.w, self.h = x, y, w, h
        self.waiting = np.zeros(0)

    def push(self, areas: np.ndarray, last: bool) -> np.ndarray:
        """The cells (x, y, w, h) of the first areas that haven't got one; all of them if these are the last."""
        a = np.concatenate([self.waiting, areas])
        sums = np.concatenate([[0.0], np.cumsum(a)])
        cells = np.empty((len(a), 4))
        i = 0
        while i < len(a):
            k = self._row(a, sums, i)
            if k is None:
                if not last:
                    break
                k = len(a) - i
            self._lay_down(a[i : i + k], sums[i : i + k] - sums[i], sums[i + k] - sums[i], cells[i : i + k])
            i += k
        self.waiting = a[i:]
        return cells[:i]

    def _row(self, a: np.ndarray, sums: np.ndarray, i: int) -> int | None:
        """How many areas from i on make a row; None if more areas might belong to it."""
        side, n = min(self.w, self.h), len(a) - i
        if side <= 0:
            return 1
        square = side * side

        def met(k: int) -> bool:
            total = sums[i + k] - sums[i]
            return total * total >= square * math.sqrt(a[i] * a[i + k - 1])

        high = 1
        while high < n and not met(high):
            high *= 2
        if high >= n:
            high = n
            if not met(n):
                return None
        low = high // 2  # not met, or 0
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if met(mid) else (mid, high)
        of = lambda k: ratio(sums[i + k] - sums[i], a[i + k - 1], a[i], side)
        if high > 1 and of(high) > of(high - 1):
            return high - 1
        while high < n and of(high + 1) <= of(high):  # rounding, or areas of 0
            high += 1
        return high if high < n else None

    def _lay_down(self, areas: np.ndarray, before: np.ndarray, total: float, out: np.ndarray) -> None:
        across, side = self.w <= self.h, min(self.w, self.h)
        thick = total / side if side > 0 else 0.0
        along = before / thick if thick > 0 else np.zeros(len(areas))
        length = areas / thick if thick > 0 else np.zeros(len(areas))
        if across:
            out[:, 0], out[:, 1], out[:, 2], out[:, 3] = self.x + along, self.y, length, thick
            self.y, self.h = self.y + thick, max(self.h - thick, 0.0)
        else:
            out[:, 0], out[:, 1], out[:, 2], out[:, 3] = self.x, self.y + along, thick, length
            self.x, self.w = self.x + thick, max(self.w - thick, 0.0)


#: Directories with more children are laid out in arrays.
FEW = 64


def _repository(group: pa.Table) -> pa.Table:
    """All cells of a repository: its rows are sorted once, and each directory's children are a slice of them."""
    rows = group.sort_by([("parent_path", "ascending"), ("weight", "descending"), ("path", "ascending")])
    parent, path = rows["parent_path"].to_pylist(), rows["path"].to_pylist()
    weight = rows["weight"].cast(pa.float64()).to_numpy()
    begins = [i for i in range(len(parent)) if i == 0 or parent[i] != parent[i - 1]]
    below = {parent[a]: (a, b) for a, b in zip(begins, [*begins[1:], len(parent)], strict=True)}
    a, b = below.get("", (0, 0))
    side = math.sqrt(max(weight[a:b].sum(), 1.0))
    cells = np.zeros((len(parent), 4))
    waiting = [("", 0.0, 0.0, side, side)] if b else []
    while waiting:
        at, *box = waiting.pop()
        a, b = below[at]
        cells[a:b] = squarify(weight[a:b].tolist(), *box) if b - a <= FEW else Squarifier(*box).push(weight[a:b], True)
        waiting += [(path[k], *cells[k].tolist()) for k in range(a, b) if path[k] in below]
    return pa.table({"repo_id": rows["repo_id"], "path": rows["path"], **{k: cells[:, i] for i, k in enumerate("xywh")}})


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of rows that come sorted by repository, parent, weight and path, with their parents' rectangles.

    A directory of any size goes through in batches: only the rows of its last, unfinished row of cells are held.
    """
    at, layer, held = None, None, []

    def out(cells: np.ndarray) -> pa.RecordBatch:
        """The first len(cells) rows held, with their cells."""
        nonlocal held
        table = pa.Table.from_batches(held)
        n = len(cells)
        held = table.slice(n).to_batches()
        done = table.slice(0, n).combine_chunks()
        return pa.RecordBatch.from_arrays([*[done.column(k).combine_chunks() for k in ("repo_id", "path")], *[pa.array(cells[:, k]) for k in range(4)]], ["repo_id", "path", "x", "y", "w", "h"])

    for b in batches:
        if not len(b):
            continue
        repo, parent = b.column("repo_id"), b.column("parent_path")
        other = pa.compute.or_(pa.compute.not_equal(repo[1:], repo[:-1]), pa.compute.not_equal(parent[1:], parent[:-1]))
        cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), len(b)]
        weight, boxes = b.column("weight").to_numpy(), [b.column(k) for k in "xywh"]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = (repo[i].as_py(), parent[i].as_py())
            if key != at:
                if held:
                    yield out(layer.push(np.zeros(0), True))
                at, layer, held = key, Squarifier(*[x[i].as_py() for x in boxes]), []
            held.append(b.slice(i, j - i).select(["repo_id", "path"]))
            cells = layer.push(weight[i:j], False)
            if len(cells):
                yield out(cells)
    if held:
        yield out(layer.push(np.zeros(0), True))


def lay_out(nodes: DataFrame, whole_nodes: int = WHOLE_NODES) -> DataFrame:
    """nodes with rectangles x, y, w, h. Small repositories are groups of their own; in large ones the directories of a
    level are dealt over all tasks, one level after the other, as a cell's shape depends on its parent's. The children
    of one directory are laid out in order by one task, batch by batch."""
    sizes = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.sum(F.when(F.col("parent_path") == "", F.col("weight"))).alias("total"))
    sizes = staged(sizes)
    slim = nodes.select("repo_id", "path", "parent_path", "weight", "depth")
    small = slim.join(sizes.where(F.col("n") <= whole_nodes).select("repo_id").hint("shuffle_hash"), "repo_id", "left_semi")
    placed = staged(small.groupBy("repo_id").applyInArrow(_repository, PLACED))
    large = sizes.where(F.col("n") > whole_nodes)
    deepest = large.agg(F.max("deepest")).first()[0] or 0
    if deepest:
        side = F.sqrt(F.greatest("total", F.lit(1)).cast("double"))
        level = large.select("repo_id", F.lit("").alias("path"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), side.alias("w"), side.alias("h"))
        big = slim.join(large.select("repo_id").hint("shuffle_hash"), "repo_id", "left_semi")
        for d in range(1, deepest + 1):  # as many rounds as the tree is deep
            parents = level.select("repo_id", F.col("path").alias("parent_path"), "x", "y", "w", "h").hint("merge")
            rows = big.where(F.col("depth") == d).join(parents, ["repo_id", "parent_path"]).select("repo_id", "parent_path", "path", F.col("weight").cast("double").alias("weight"), "x", "y", "w", "h")
            rows = rows.repartition("repo_id", "parent_path").sortWithinPartitions("repo_id", "parent_path", F.desc("weight"), "path")
            level = staged(rows.mapInArrow(_directories, PLACED))
            placed = placed.unionByName(level)
    return nodes.join(placed.hint("merge"), ["repo_id", "path"])
