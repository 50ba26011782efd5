"""Connected parts: of a link table in rounds that grow with the logarithm of a part's length, of an array at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut


def connected(links: DataFrame, count: list[int] | None = None) -> DataFrame:
    """(node, root) for links (a, b) of long numbers: root is the smallest number that node reaches; roots aren't listed.

    Every node hooks its larger neighbours, then its smaller ones, onto the least it sees, in turns, until the table
    rests. Each round is a checkpoint; ``count`` gets the number of rounds.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rounds, before = 0, None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            break
        before, rounds = now, rounds + 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hooked = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hooked.union(least.select("u", F.col("m").alias("v"))).distinct())
    if count is not None:
        count.append(rounds)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(mask: np.ndarray) -> np.ndarray:
    """The first place, counted row by row, of each pixel's part over eight neighbours; -1 outside the mask."""
    h, w = mask.shape
    at = np.arange(h * w).reshape(h, w)
    u, v = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        on = mask[a] & mask[b]
        u.append(at[a][on])
        v.append(at[b][on])
    u, v = np.concatenate(u), np.concatenate(v)
    root = np.arange(h * w)
    while True:
        p, q = root[u], root[v]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root[root] != root).any():
            root = root[root]
    return np.where(mask, root.reshape(h, w), -1)
