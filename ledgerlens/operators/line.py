"""The best of all K-Means partitions of one column, by cuts between its sorted values.

On a line the best clusters are intervals, so K of them are K - 1 cuts.  The rows are
folded to blocks of neighbouring values (count, sum, sum of squares, least, greatest).
If the points of a block that may hold a cut cost nothing, the cost of every choice of
cuts is a lower bound; cuts at the ends of blocks give an upper bound.  A block whose
lower bound lies above the best upper bound holds no cut and is never split again; the
others are split by another count of their rows, until each is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerlens.functions import scalars as s
from ledgerlens.functions.tables import agg

BLOCKS = 2_048  # blocks a count aims at
ROWS = 128      # rows of the cost table that are held at a time
BLOCK_SCHEMA = "block int, n double, total double, square double, least double, most double"


def _counted(data: DataFrame, column: str, low: np.ndarray, high: np.ndarray, steps: int) -> pd.DataFrame:
    """The rows inside the ascending ranges [low, high], folded to ``steps`` blocks a range."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(low) * steps
        sums, least, most = np.zeros((3, size)), np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            x = batch[column].to_numpy(dtype="float64")
            at = np.searchsorted(low, x, side="right") - 1
            inside = (at >= 0) & (x <= high[at])
            x, at = x[inside], at[inside]
            block = at * steps + np.minimum((x - low[at]) / (high[at] - low[at]) * steps, steps - 1).astype(np.int64)
            for total, weight in zip(sums, (None, x, x * x)):
                total += np.bincount(block, weights=weight, minlength=size)
            np.minimum.at(least, block, x)
            np.maximum.at(most, block, x)
        met = np.flatnonzero(sums[0])
        yield pd.DataFrame({"block": met.astype("int32"), "n": sums[0, met], "total": sums[1, met], "square": sums[2, met],
                            "least": least[met], "most": most[met]})

    parts = data.select(column).mapInPandas(partial, BLOCK_SCHEMA)
    merged = agg(parts, {"n": "sum(n)", "total": "sum(total)", "square": "sum(square)", "least": "min(least)", "most": "max(most)"}, ["block"])
    return merged.toPandas().sort_values("block", ignore_index=True)


class _Cuts:
    """Costs of k - 1 cuts at the open blocks; ``free``: the points of an open block of several values cost nothing."""

    def __init__(self, blocks: pd.DataFrame, k: int, free: bool):
        self.sums = np.vstack([np.zeros(3), blocks[["n", "total", "square"]].to_numpy().cumsum(axis=0)])
        place = np.flatnonzero(blocks["open"])
        loose = (blocks["least"] < blocks["most"]).to_numpy()[place]
        self.start, self.end, last = place + 1, place + 1 - (loose & free), len(blocks)
        self.left = [self.cost(np.zeros_like(self.end), self.end)]
        self.right = [self.cost(self.start, np.full_like(self.start, last))]
        for _ in range(k - 2):
            self.left.append(self._through(self.left[-1], forward=True))
            self.right.append(self._through(self.right[-1], forward=False))
        self.total = [a + b for a, b in zip(self.left, reversed(self.right))]

    def cost(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Squared distances to their mean of the points in blocks start..end-1."""
        n, total, square = (self.sums[np.maximum(end, start), j] - self.sums[start, j] for j in range(3))
        return np.maximum(square - total * total / np.maximum(n, 1), 0)

    def _through(self, so_far: np.ndarray, forward: bool) -> np.ndarray:
        m, best = len(so_far), np.empty(len(so_far))
        for a in range(0, m, ROWS):
            own, other = np.arange(a, min(a + ROWS, m))[:, None], np.arange(m)[None, :]
            one, two = (other, own) if forward else (own, other)
            gaps = self.cost(np.broadcast_to(self.start[one], (len(own), m)), np.broadcast_to(self.end[two], (len(own), m)))
            best[a:a + ROWS] = np.where(one <= two, gaps + so_far[None, :], np.inf).min(axis=1)
        return best

    def best(self) -> list[int]:
        """Ends of the clusters, as numbers of blocks, of the cheapest choice."""
        at = int(self.total[-1].argmin())
        cuts = [at]
        for so_far in reversed(self.left[:-1]):
            at = int((so_far[:at + 1] + self.cost(self.start[:at + 1], np.full(at + 1, self.end[at]))).argmin())
            cuts.append(at)
        return [int(self.end[i]) for i in reversed(cuts)]


def best_intervals(data: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(centres, sizes, cost, scans) of the cheapest k intervals; the rows are only ever counted."""
    ends = agg(data, {"low": f"min({s.name(column)})", "high": f"max({s.name(column)})"}).first()
    blocks = pd.DataFrame({"n": [0.0], "total": [0.0], "square": [0.0], "least": [ends["low"]], "most": [ends["high"]], "open": [True]})
    scans = 0
    while True:
        split = blocks["open"] & (blocks["least"] < blocks["most"])
        if scans and not split.any():
            break
        wide = blocks[split] if split.any() else blocks.assign(most=blocks["least"] + 1.0)  # one value only
        steps = max(2, BLOCKS // len(wide))
        parts = _counted(data, column, wide["least"].to_numpy(), wide["most"].to_numpy(), steps).drop(columns="block").assign(open=True)
        scans += 1
        blocks = pd.concat([blocks.drop(wide.index), parts]).sort_values("least", ignore_index=True)
        bound, cuts = _Cuts(blocks, k, free=True), _Cuts(blocks, k, free=False)
        limit = cuts.total[-1].min() + 1e-9 * blocks["square"].sum()
        holds = np.min(bound.total, axis=0) <= limit
        blocks.loc[blocks["open"], "open"] = holds
        closed = ~blocks["open"]  # neighbours without a cut become one block
        group = (blocks["open"] | (closed != closed.shift())).cumsum()
        blocks = blocks.groupby(group, sort=True).agg({"n": "sum", "total": "sum", "square": "sum", "least": "min", "most": "max", "open": "any"}).reset_index(drop=True)
    cuts = _Cuts(blocks, k, free=False)
    edges = np.array([0, *cuts.best(), len(blocks)])
    n, total, _ = (cuts.sums[edges[1:]] - cuts.sums[edges[:-1]]).T
    cost = float(cuts.cost(edges[:-1], edges[1:]).sum())
    centres = pd.Series(total / np.maximum(n, 1)).where(n > 0).ffill().bfill()  # fewer values than k: an empty cluster lies on its neighbour
    return centres.to_numpy()[:, None], n, cost, scans
