"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector per group.

Vectors are compared only when their labels are equal. Equal vectors of a label are one node with a count.
Cells come from spherical k-means on a bounded sample; a large table's cells are divided again by k-means on
samples of each, so cells keep their size as the table grows (up to ``centres`` numbers for all their centres,
32 MB; only then do they grow). A vector lives in its nearest cell and visits each
cell in which a neighbour could live: y within angle t of x can only be nearer to centre c than to x's own
centre h if x . (h - c) / |h - c| <= sin t, so no link is lost to a cell border. Within a (label, cell),
blocks of residents meet blocks of residents and visitors; a block product gives each resident its number
of links and one edge to the smallest member of its local component, never the pairs themselves.

Edge cases: null labels, null or zero vectors and vectors with null or non-finite components link with
nothing (n_links 0, component = own id, kept); repeated vectors link with each other; a null id links
with nothing and is kept; components of any finite size are scaled before they are squared; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, components, discard, smallest_hashes, table


def usable(col: str = "embedding"):
    """Whether a vector is not null, not zero, and free of null and non-finite components."""
    c = F.col(col)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of at most k cells; the first centres are spread by greedy farthest choice."""
    x = np.unique(unit(x), axis=0)
    k = min(k, len(x))
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(k - 1):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            s = x[own == j].sum(0)
            if np.linalg.norm(s) > 0:
                c[j] = s / np.linalg.norm(s)
    return np.unique(c, axis=0)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = 10_000, cell: int = 8192, residents: int = 256, others: int = 1024, top: int = 1024, centres: int = 4_000_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of one label with the cosine or more."""
    good = vectors.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    nodes = table(good.groupBy("label", "x").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("x")))
    dims = [r[0] for r in nodes.groupBy("d").count().orderBy("d").collect()]
    used: list[DataFrame] = []
    parts = [_links(nodes.where(F.col("d") == d).drop("d"), cosine, sample, cell, residents, others, top, max(top, centres // max(1, d)), used) for d in dims]
    roots = None
    if parts:
        found = table(_union(parts))
        discard(*used)
        counted = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
        per = nodes.join(counted, "node", "left").join(roots, "node", "left")
        per = table(per.select("label", "x", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")))
        discard(nodes, found)
        linked = attach(good, per, ["label", "x"], "copies").select("vec_id", "n", "root")
        fine = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        out = linked.unionByName(vectors.where(~fine).select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("root")))
    else:
        out = vectors.select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("root"))
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _vectors(sample: DataFrame) -> np.ndarray:
    return np.array(sample.select("x").toArrow().column(0).to_pylist(), float)


def _seats(rows: DataFrame, centres: dict[int, np.ndarray], sin: float) -> DataFrame:
    """(label, x, node, copies, cell, resident): each row of a cell in the parts of that cell that it lives in or visits.

    A cell without centres stays whole. A part's number is unique among all cells'.
    """
    kind = rows.schema["label"].dataType.simpleString()  # labels of any type are only compared
    gaps = {k: np.linalg.norm(c[:, None] - c[None], axis=2) + np.eye(len(c)) for k, c in centres.items()}
    stride = max(map(len, centres.values()), default=1)

    def assign(batches):
        for batch in batches:
            names = batch.schema.names
            cells = batch.column(names.index("cell")).to_numpy()
            lives = batch.column(names.index("resident")).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                mine = np.flatnonzero(cells == cell)
                part = batch.take(pa.array(mine))
                c = centres.get(cell)
                if c is None:
                    row, to, home = np.arange(len(mine)), np.zeros(len(mine), int), np.zeros(len(mine), int)
                else:
                    s = unit(np.array(part.column(1).to_pylist(), float)) @ c.T
                    home = s.argmax(1)
                    row, to = np.nonzero((s[np.arange(len(s)), home][:, None] - s) / gaps[cell][home] <= sin)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(k).take(at) for k in range(4)] + [pa.array((cell * stride + to).astype(np.int32)), pa.array((home[row] == to) & lives[mine][row])], names)

    return rows.mapInArrow(assign, f"label {kind}, x array<double>, node long, copies long, cell int, resident boolean")


def _links(nodes: DataFrame, cosine: float, sample: int, cell: int, residents: int, others: int, top: int, most: int, used: list[DataFrame]) -> DataFrame:
    """(node, links, root): partial link counts of nodes and edges to a smaller node that they reach."""
    count = nodes.count()
    cells = max(1, min(most, max(8, count // cell)))
    first = spherical_kmeans(_vectors(smallest_hashes(nodes.select("node", "x"), "node", sample, 5)), min(top, cells))
    sin = np.sqrt(max(0.0, 1 - cosine * cosine)) + 1e-9
    seats = _seats(nodes.select("label", "x", "node", "copies", F.lit(0).alias("cell"), F.lit(True).alias("resident")), {0: first}, sin)
    if cells > top:
        # Every cell is divided by itself: a vector that lives in or visits a cell lives in or visits its parts.
        seats = table(seats)
        used.append(seats)
        per = -(-cells // len(first))
        draw = seats.where("resident").select("cell", "node", "x").where(F.xxhash64("node", F.lit(6)).cast("double") / 2.0**64 + 0.5 <= min(1.0, 8.0 * per * len(first) / count))

        def divide(p: pd.DataFrame) -> pd.DataFrame:
            c = spherical_kmeans(np.stack(p.sort_values("node")["x"].to_numpy()), per)
            return pd.DataFrame({"cell": p["cell"].iloc[0], "x": list(c)})

        # A task's sample: 16 vectors a part at most, whatever falls in the cell.
        rank = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(6)), "node"))
        found = draw.withColumn("rank", rank).where(F.col("rank") <= 16 * per).groupBy("cell").applyInPandas(divide, "cell int, x array<double>")
        parts: dict[int, list] = {}
        for row in found.toLocalIterator():  # at most ``most`` centres
            parts.setdefault(row["cell"], []).append(row["x"])
        seats = _seats(seats, {k: np.array(v, float) for k, v in parts.items()}, sin)
    seats = table(seats)
    used.append(seats)
    sizes = seats.groupBy("label", "cell").agg(F.sum(F.col("resident").cast("long")).alias("own"), F.count(F.lit(1)).alias("everyone"))
    sizes = sizes.select(F.col("label").alias("l"), F.col("cell").alias("c"), F.ceil(F.col("own") / residents).cast("int").alias("nb"), F.ceil(F.col("everyone") / others).cast("int").alias("no")).where("nb > 0")
    seats = seats.join(sizes, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c"))).drop("l", "c")
    mine = seats.where("resident").withColumn("hb", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nb")).cast("int")).withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("no") - 1)))
    rest = seats.withColumn("ob", F.pmod(F.xxhash64("node", F.lit(2)), F.col("no")).cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cols = ["label", "cell", "hb", "ob", "node", "copies", "x"]
    blocks = mine.select(*cols, F.lit(True).alias("mine")).union(rest.select(*cols, F.lit(False).alias("mine")))
    return blocks.groupBy("label", "cell", "hb", "ob").applyInPandas(lambda p: _block(p, cosine), "node long, links long, root long")


def _block(p: pd.DataFrame, cosine: float) -> pd.DataFrame:
    p = p.sort_values(["mine", "node"], kind="stable")
    x = unit(np.stack(p["x"].to_numpy()))
    mine = p["mine"].to_numpy()
    node, copies = p["node"].to_numpy(), p["copies"].to_numpy()
    a, b = node[mine], node[~mine]
    near = x[mine] @ x[~mine].T >= cosine
    near &= a[:, None] != b[None]
    links = near @ copies[~mine]
    # Local components over residents and others: smallest reachable id, spread until it rests.
    la, lb = a.copy(), b.copy()
    i, j = np.nonzero(near)
    spot = {n: k for k, n in enumerate(b.tolist())}
    same = np.array([spot.get(n, -1) for n in a.tolist()])
    while len(i):
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, i, lb[j])
        np.minimum.at(nb, j, la[i])
        both = same >= 0
        low = np.minimum(na[both], nb[same[both]])
        na[both], nb[same[both]] = low, low
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    keep = (links > 0) | (la < a)
    other = np.flatnonzero(lb < b)
    return pd.DataFrame({"node": np.concatenate([a[keep], b[other]]), "links": np.concatenate([links[keep], np.zeros(len(other), np.int64)]), "root": np.concatenate([la[keep], lb[other]])})
