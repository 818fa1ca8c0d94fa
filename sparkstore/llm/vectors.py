"""Exact near-duplicates among vectors by a pivot-partitioned range join (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, cut, look_up, short_batches

COSINE = 0.93
#: Rows of one slice of a cell, and so of the matrix that a task holds; rows that
#: pass by it at once.
SLICE, PASSING = 8192, 512
#: Rows for each pivot of a label, and numbers in all pivots together, which bound
#: what is sent to the executors: with more rows than those allow, cells grow.
CELL, PIVOT_VALUES = 1024, 1 << 22
#: Vectors of a label that try its pivots, and the most copies of a vector, on
#: average, at which pivots are used.
PROBES, MOST_COPIES = 256, 4.0
#: Added to distance bounds, far above rounding; bounds only choose candidates.
SLACK = 1e-6


def _unit(vectors: pd.Series, dim: int) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable() -> Column:
    """Whether a row may link: label and vector not null, finite, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(usable, F.lit(False))


def _reach(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and which cells it is sent to: its own, and the
    earlier ones that its ball reaches.

    With d the distance of unit vectors: y of cell q and x of cell p within the
    radius r give d(y,p) <= d(x,p) + r <= d(x,q) + r <= d(y,q) + 2r by the
    triangle inequality twice; that is the bound for sending y to p. Since x is
    no nearer to q than to p, y also lies within r of the bisecting hyperplane:
    d(y,p)^2 - d(y,q)^2 <= 2 r d(p,q), the second and sharper bound.
    """
    d2 = np.maximum(0, 2 - 2 * x @ p.T)
    home = d2.argmin(1)
    own = d2[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    reach = (np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * radius + SLACK) & (d2 - own[:, None] <= 2 * radius * apart[home] + SLACK)
    reach &= np.arange(len(p)) <= home[:, None]
    reach[np.arange(len(x)), home] = True
    return home, reach


def _worth(pivots: np.ndarray, probes: np.ndarray, radius: float) -> np.ndarray:
    """As many of a label's pivots as cost the least by what the probes tell, or one.

    With P cells and c copies of a vector on average, a vector meets (c - 1/2)/P of
    the others; each copy more is shipped. Vectors that no metric bound can prune
    meet half of the others whatever P, and then have one cell.
    """
    best, cost, n = pivots[:1], 0.5, len(pivots)
    while n > 1 and len(probes):
        copies = _reach(probes, pivots[:n], radius)[1].sum(1).mean()
        now = (copies - 0.5) / n + 0.05 * (copies - 1)
        if copies <= MOST_COPIES and now < cost:
            best, cost = pivots[:n], now
        n //= 2
    return best


def _pivots(distinct: DataFrame, cell_rows: int, radius: float) -> dict:
    """Unit pivot vectors of each label (and dimension) of more than two cells' rows.

    They are the vectors of least keyed hash, one for ``cell_rows`` rows of a label,
    so their number grows with the rows, until all have PIVOT_VALUES numbers; from
    there on a pivot stands for more rows, alike in all labels. ``_worth`` then tells
    how many of them a label uses.
    """
    whole = distinct.agg(F.sum("dim").alias("values")).first()[0] or 0
    per = max(cell_rows, -(-whole // PIVOT_VALUES))
    sizes = distinct.groupBy("label", "dim").count().where(F.col("count") >= 2 * per).collect()
    if not sizes:
        return {}
    want = {(r["label"], r["dim"]): r["count"] // per for r in sizes}
    share = [(r["label"], r["dim"], min(1.0, (2.0 * want[r["label"], r["dim"]] + 2 * PROBES) / r["count"])) for r in sizes]
    share = distinct.sparkSession.createDataFrame(share, "label string, dim int, share double")
    drawn = distinct.select("label", "dim", "embedding", F.xxhash64("embedding", F.lit(5)).alias("h"))
    drawn = drawn.join(F.broadcast(share), ["label", "dim"]).where(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
    found: dict = {}
    for r in sorted(drawn.select("label", "dim", "h", "embedding").collect(), key=lambda r: r["h"]):
        found.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    out = {}
    for k, v in found.items():
        x = _unit(pd.Series(v), k[1])
        out[k] = _worth(x[: want[k]], x[want[k] : want[k] + PROBES], radius)
    return out


def _assign(pivots, radius: float):
    """Sends each vector to its own cell and, as a replica, to the earlier cells
    that its ball reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cell, target, at = [], [], []
            for (label, dim), part in rows.groupby(["label", "dim"], sort=False):
                p = pivots.value.get((label, dim))
                pos = rows.index.get_indexer(part.index)
                if p is None or len(p) < 2:
                    cell.append(np.zeros(len(part), int)), target.append(np.zeros(len(part), int)), at.append(pos)
                    continue
                home, reach = _reach(_unit(part["embedding"], dim), p, radius)
                i, to = np.nonzero(reach)
                cell.append(home[i]), target.append(to), at.append(pos[i])
            if at:
                out = rows.iloc[np.concatenate(at)].reset_index(drop=True)
                yield out.assign(home=np.concatenate(cell), cell=np.concatenate(target))

    return run


def _join(cosine: float):
    """Joins each slice with itself and, in order, with the rows sent to it.

    A slice's own rows come first and are held; the others pass by in blocks, so
    memory is bounded by the slice. Gives links of each vector, counted with the
    multiplicity of the other side, and a star for each connected part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, parts = None, None, []
        for rows in batches:
            for k, part in rows.groupby(["label", "dim", "cell", "slice"], sort=False):
                if k != key:
                    if parts:
                        own, out = inner(parts, key[1])
                        yield out
                    key, own, parts = k, None, []
                home = part[part["role"] == 0]
                if len(home):
                    parts.append(home)
                rest = part[part["role"] == 1]
                if len(rest):
                    if parts:
                        own, out = inner(parts, key[1])
                        yield out
                        parts = []
                    if own is not None:
                        yield outer(own, rest, key[1])
        if parts:
            yield inner(parts, key[1])[1]

    def inner(parts: list[pd.DataFrame], dim: int):
        rows = pd.concat(parts, ignore_index=True)
        x, n, rep = _unit(rows["embedding"], dim), rows["n"].to_numpy(), rows["rep"].to_numpy()
        found = []
        for at in range(0, len(x), PASSING):
            i, j = np.nonzero(x[at : at + PASSING] @ x[at:].T >= cosine)
            found.append((i[j > i] + at, j[j > i] + at))
        i, j = (np.concatenate(v) for v in zip(*found, strict=True))
        return (x, n, rep), told(i, j, rep, rep, n, n)

    def outer(own, rows: pd.DataFrame, dim: int) -> pd.DataFrame:
        x, n, rep = own
        i, j = np.nonzero(x @ _unit(rows["embedding"], dim).T >= cosine)
        return told(i, j, rep, rows["rep"].to_numpy(), n, rows["n"].to_numpy())

    def told(i, j, rep_i, rep_j, n_i, n_j) -> pd.DataFrame:
        a, b = rep_i[i], rep_j[j]
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n_j[j], n_i[i]]), len(nodes)).astype(np.int64)
        u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while len(u) and (root[u] != root[v]).any():
            low = np.minimum(root[u], root[v])
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
            root = root[root]
        return pd.DataFrame({"a": nodes, "b": nodes[root], "links": count})

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, slice_rows: int = SLICE, cell_rows: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of
    ``rows(vec_id, embedding, label)``.

    Links are all pairs of equal non-null label and cosine of at least
    ``cosine``, in double precision. Rows whose vector is null, empty, zero, of
    another dimension or holds null or non-finite components link with nothing.
    Equal vectors are joined once and counted as often as they occur; copies
    link with each other. component_id is the smallest vec_id reachable (null
    only where all are); kept means vec_id equals it. Repeated rows count as
    separate vectors, rows of one vec_id too. Other columns are ignored; no rows
    give no rows.

    A cell is joined in slices of about ``slice_rows`` vectors: each slice holds its
    own and lets the later ones pass, so a task's memory is that of a slice, and a
    cell of n vectors ships n / (2 slice_rows) copies of each beside the replicas.
    Vectors travel in the input's precision.
    """
    spark = rows.sparkSession
    short_batches(spark, PASSING)
    kind = rows.schema["embedding"].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = rows.where(_usable()).withColumn("dim", F.size("embedding"))
    # -0.0 and 0.0 differ as keys; they are the same component here
    usable = usable.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(number)).otherwise(x)))
    keyed = usable.withColumn("key", F.sha2(F.concat_ws(",", F.col("label"), F.col("embedding").cast("array<string>").cast("string")), 256))
    grouped = keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = cut(grouped.withColumn("rep", F.monotonically_increasing_id()))  # numbers stay as written
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    pivots = spark.sparkContext.broadcast(_pivots(distinct, cell_rows, radius))
    schema = f"rep long, n long, label string, dim int, embedding array<{number}>"
    placed = distinct.select("rep", "n", "label", "dim", "embedding").mapInPandas(_assign(pivots, radius), f"{schema}, home long, cell long")
    placed = cut(placed.withColumn("c", F.xxhash64("label", "dim", "cell")))  # cells of one hash have their slices in common numbers, no more
    own = F.col("home") == F.col("cell")
    sizes = cut(placed.groupBy("c").agg(F.ceil(F.count_if(own) / slice_rows).cast("int").alias("k"), F.count("*").alias("n")))
    sliced = look_up(placed, "c", sizes, "k", placed.count(), "rep").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    # a home row: its own slice, and those before it; a replica: every slice of the cell
    to = F.when(own, F.sequence(F.lit(0), F.col("at"))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = sliced.withColumn("slice", F.explode(to)).withColumn("role", F.when(own & (F.col("slice") == F.col("at")), 0).otherwise(1))
    keys = ["label", "dim", "cell", "slice"]
    found = dealt.select(*keys, "role", "rep", "n", "embedding").repartition(*keys).sortWithinPartitions(*keys, "role")
    found = cut(found.mapInPandas(_join(cosine), "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    known = distinct.select("key", "rep", "least", F.col("n").alias("rows")).join(counts, "rep", "left").join(parts, "rep", "left")
    known = cut(known.select("key", "least", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), F.coalesce("root", "rep").alias("root")))
    named = cut(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    known = look_up(known, "root", named, "component_id", known.count(), "key")
    known = cut(known.select("key", F.struct("links", "component_id").alias("found"), F.col("rows").alias("n")))
    many = known.agg(F.sum("n")).first()[0] or 0
    linked = look_up(keyed.select("vec_id", "key"), "key", known, "found", many, "vec_id").select("vec_id", "found.links", "found.component_id")
    alone = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("links").alias("n_links"), "component_id", (F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"))
