"""Exact cosines of two sets of vectors, block by block, as matrix products over tiles.

Rows meet where their block columns are equal. Each side of a block is cut into tiles of TILE rows; a task multiplies
one tile of the left with one of the right, so its memory is bounded whatever the block holds, and a crowded block
is spread over as many tasks as it has pairs of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096
#: Similarities held at once by a task.
CHUNK = 4_000_000


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size) & (size > 0)
    x[good] /= size[good, None]
    x[~good] = np.nan
    return x, good


def _tiled(rows: DataFrame, block: list[str], tile: int, name: str) -> DataFrame:
    """(block, name): the tiles of each block, one at least."""
    return rows.groupBy(*block).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias(name))


def cosines(left: DataFrame, right: DataFrame, block: list[str], *, least: float | None = None, top: int | None = None, ordered: bool = False, tile: int = TILE) -> DataFrame:
    """(left_id, right_id, similarity) of pairs in equal blocks.

    left has left_id, left_vector and the block columns, right likewise; null blocks meet nothing. Vectors of a block have
    one length. least drops pairs below it. top keeps, for each left row, all pairs among which its most similar top
    are (ties included; the caller ranks them). ordered also wants left_order and right_order, and drops pairs with
    right_order after left_order, before top is taken. The similarity with an all-zero vector is null, and dropped if
    least or top is given.
    """
    whole = F.lit(True)
    for b in block:
        whole = whole & F.col(b).isNotNull()
    left, right = left.where(whole & F.col("left_vector").isNotNull()), right.where(whole & F.col("right_vector").isNotNull())
    # a row is copied for the tiles of its own block only; blocks that one side lacks meet nothing
    sizes = _tiled(left, block, tile, "lefts").join(_tiled(right, block, tile, "rights"), block)
    extra = (["left_order"], ["right_order"]) if ordered else ([], [])
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = F.pmod(F.xxhash64(*block), F.lit(max(1, left.count() // tile, right.count() // tile)))  # small blocks share a task
    l = left.join(sizes, block).select(key.alias("k"), F.to_json(F.struct(*block)).alias("b"), "left_id", F.col("left_vector").cast("array<float>").alias("left_vector"), *extra[0], place("left_id", "lefts").alias("i"), every("rights").alias("j"))
    r = right.join(sizes, block).select(key.alias("k"), F.to_json(F.struct(*block)).alias("b"), "right_id", F.col("right_vector").cast("array<float>").alias("right_vector"), *extra[1], place("right_id", "rights").alias("j"), every("lefts").alias("i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        of = b.groupby("b", sort=False).indices
        for at, rows in a.groupby("b", sort=False).indices.items():
            if at not in of:
                continue
            mine, theirs = a.iloc[rows], b.iloc[of[at]]
            x, _ = _unit(mine["left_vector"])
            y, _ = _unit(theirs["right_vector"])
            ids, others = mine["left_id"].to_numpy(), theirs["right_id"].to_numpy()
            step = max(1, CHUNK // len(others))
            for s in range(0, len(ids), step):
                sim = x[s : s + step] @ y.T
                keep = np.ones(sim.shape, bool) if least is None and top is None else ~np.isnan(sim)
                if least is not None:
                    keep &= np.nan_to_num(sim, nan=-2) >= least
                if ordered:
                    keep &= theirs["right_order"].to_numpy()[None, :] <= mine["left_order"].to_numpy()[s : s + step, None]
                if top is not None and sim.shape[1] > top:
                    ranked = np.where(keep, sim, -np.inf)
                    limit = np.partition(ranked, -top, axis=1)[:, -top]
                    keep &= ranked >= limit[:, None]
                rows, cols = np.nonzero(keep)
                parts.append(pd.DataFrame({"left_id": ids[s + rows], "right_id": others[cols], "similarity": sim[rows, cols]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"left_id": [], "right_id": [], "similarity": []}).astype({"left_id": "int64", "right_id": "int64"})

    met = l.groupBy("k", "i", "j").cogroup(r.groupBy("k", "i", "j")).applyInPandas(run, "left_id long, right_id long, similarity double")
    return met.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))
