"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors at a cosine of at least c lie within a squared distance of 2 - 2c.  They are rotated, which keeps distances, and
cut into blocks of few dimensions; the squared budget is shared out by dimensions, so of two near vectors some block is within
its share.  Each block is range-joined: its first dimensions are a grid, a vector is put into every cell within half a radius
of it, and a pair meets in all cells near to it but is judged in the one that holds its middle, and in the first block that
finds it.  So every near pair is judged once, in one task.

Rotated vectors are carried as whole numbers of 16 bits.  Products of these are exact whichever way they are added up, so all
tasks agree on which cell and block has a pair, and bounds on the rounding tell links from others; the few pairs in between
are handed on and decided by the cosine of the vectors as they are.  Copies are one vector from the start.  A task gives back
the number of links of each vector and as many links as hold its components together, never all pairs; cells of many vectors
are dealt out in tiles of two lots each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import checked_broadcast, drop_stored, free_name, store
from loomspark.llm.graph import components


@dataclass(frozen=True)
class Parameters:
    cosine: float = 0.93
    #: Dimensions of a block, and of its grid.
    block: int = 8
    grid: int = 4
    #: A cell is as many radii wide.
    width: float = 2.0
    #: A cell with more vectors is dealt out in lots of about so many; rows a task gets, about.
    lot: int = 2048
    rows_a_task: int = 20_000
    #: Copies of a vector from which on they are hot.
    hot: int = 5000
    most_broadcast: int = 64_000_000
    seed: int = 20240229


#: Coordinates lie between -1 and 1 and are carried as 16-bit numbers of this scale.
SCALE = 32_000
#: More than what double precision can be off by in a norm or a rotation.
TINY = 1e-9


@lru_cache(maxsize=8)
def rotation(d: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


@dataclass(frozen=True)
class Budgets:
    """What holds for whole-number vectors of d dimensions: squared distances that are surely links, or may be, and each block's share."""

    starts: list[int]
    surely: int
    maybe: int
    blocks: list[int]
    radius: list[float]

    @staticmethod
    def of(d: int, p: Parameters) -> Budgets:
        near = math.sqrt(max(0.0, 2 - 2 * p.cosine))
        # Each coordinate is rounded by half a unit at most, so a difference of two vectors by the root of d units.
        off = lambda n: math.sqrt(n) * (1 + TINY) + SCALE * TINY
        starts = [*range(0, d, p.block), d]
        radius = [near * SCALE * math.sqrt((b - a) / d) + off(b - a) for a, b in zip(starts, starts[1:], strict=False)]
        least = max(0.0, near * SCALE - off(d))
        return Budgets(starts, math.floor(least**2) if near * SCALE > off(d) else -1, math.ceil((near * SCALE + off(d)) ** 2), [math.ceil(r * r) for r in radius], radius)


def rotated(vectors: np.ndarray, p: Parameters) -> np.ndarray:
    """Unit vectors, rotated, as whole numbers.  The largest component is divided out first, so that no square is too large or small."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.rint((v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(v.shape[1], p.seed) * SCALE).astype(np.int16)


def cells(q: np.ndarray, b: int, t: Budgets, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): all cells of block b's grid within half a radius of each row; a cell is a number made of its coordinates."""
    first = t.starts[b]
    dims = min(p.grid, t.starts[b + 1] - first)
    wide = p.width * t.radius[b]
    row, cell = np.arange(len(q)), np.zeros(len(q), np.int64)
    for i in range(first, first + dims):
        x = q[row, i].astype(np.float64)
        low, high = np.floor((x - t.radius[b] / 2 - 1) / wide).astype(np.int64), np.floor((x + t.radius[b] / 2 + 1) / wide).astype(np.int64)
        n = high - low + 1
        at = np.repeat(np.arange(len(row)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        row, cell = row[at], cell[at] * BASE + (low[at] + step + BASE // 2)
    return row, cell


#: Cells of one dimension that a cell number has room for; coordinates are bounded by the unit length.
BASE = 4096


def middle_cell(a: np.ndarray, b: np.ndarray, block: int, t: Budgets, p: Parameters) -> np.ndarray:
    """The cell that holds the middle of each pair; from whole numbers only, so it is the same in every task."""
    first = t.starts[block]
    cell = np.zeros(len(a), np.int64)
    for i in range(first, first + min(p.grid, t.starts[block + 1] - first)):
        total = a[:, i].astype(np.int64) + b[:, i]
        cell = cell * BASE + (np.floor(total / 2 / (p.width * t.radius[block])).astype(np.int64) + BASE // 2)
    return cell


def placed(batches: Iterator[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    """(node, grp, d, copies, block, cell, q): every vector in all cells that are near to it, block by block."""
    for b in batches:
        size = b.column("d").to_numpy()
        for d in np.unique(size).tolist():
            part = b.take(pa.array(np.flatnonzero(size == d)))
            vectors = part.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d)
            q, t = rotated(vectors, p), Budgets.of(d, p)
            raw = [x.tobytes() for x in q]
            for k in range(len(t.blocks)):
                row, cell = cells(q, k, t, p)
                for at in range(0, len(row), 5000):
                    r = row[at : at + 5000]
                    of = part.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays(
                        [of.column("node"), of.column("grp"), of.column("d"), of.column("copies"), pa.array(np.full(len(r), k, np.int32)), pa.array(cell[at : at + 5000]), pa.array([raw[i] for i in r.tolist()], pa.binary())],
                        names=["node", "grp", "d", "copies", "block", "cell", "q"],
                    )


PLACED = "node long, grp long, d int, copies long, block int, cell long, q binary"
#: kind LINKS: vector a has n links here; FOREST: a link (a, b) that holds a component together; CLOSE: a pair to be decided.
FOUND = "kind int, a long, b long, n long"
LINKS, FOREST, CLOSE = 0, 1, 2


def judged(tile: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    """The pairs of a tile, one cell or two lots of one, that are judged here."""
    d, block, cell = int(tile["d"].iloc[0]), int(tile["block"].iloc[0]), int(tile["cell"].iloc[0])
    t = Budgets.of(d, p)
    node, copies, lot = (tile[c].to_numpy(np.int64) for c in ("node", "copies", "lot"))
    q = np.frombuffer(b"".join(tile["q"]), np.int16).reshape(-1, d)
    order = np.argsort(node, kind="stable")
    node, copies, lot, q = node[order], copies[order], lot[order], q[order]
    x = q[:, t.starts[block] : t.starts[block + 1]].astype(np.float64)
    norm = (x * x).sum(axis=1)
    n, label, links, two = len(node), np.arange(len(node)), np.zeros(len(node), np.int64), tile["lot_a"].iloc[0] != tile["lot_b"].iloc[0]
    forest, close = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    stripe = max(1, 1_000_000 // n)
    for start in range(0, n, stripe):
        part = slice(start, min(n, start + stripe))
        # Sums and products of whole numbers below 2**53: exact in any order.
        dist = norm[part, None] + norm[None, :] - 2 * (x[part] @ x.T)
        i, j = np.nonzero(dist <= t.blocks[block])
        i += start
        keep = i < j
        if two:
            keep &= lot[i] != lot[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            here = middle_cell(q[a], q[b], block, t, p) == cell
            a, b = a[here], b[here]
            diff = q[a].astype(np.int64) - q[b]
            squares = np.add.reduceat(diff * diff, t.starts[:-1], axis=1)
            first = (squares[:, :block] > np.array(t.blocks[:block], np.int64)).all(axis=1)
            total = squares.sum(axis=1)
            link = first & (total <= t.surely)
            unsure = first & ~link & (total <= t.maybe)
            close.append(np.stack([node[a[unsure]], node[b[unsure]]], axis=1))
            a, b = a[link], b[link]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while True:
                apart = label[a] != label[b]
                if not apart.any():
                    break
                k = int(apart.argmax())
                a, b = a[k:], b[k:]
                new, old = sorted((label[a[0]], label[b[0]]))
                label[label == old] = new
                forest.append(np.array([[node[a[0]], node[b[0]]]], np.int64))
    kinds = [(LINKS, np.stack([node[links > 0], node[links > 0]], axis=1), links[links > 0]), (FOREST, np.concatenate(forest), 0), (CLOSE, np.concatenate(close), 0)]
    return pd.concat([pd.DataFrame({"kind": kind, "a": ab[:, 0], "b": ab[:, 1], "n": m}) for kind, ab, m in kinds], ignore_index=True)


def judged_bucket(pdf: pd.DataFrame, p: Parameters) -> pd.DataFrame:
    found = [judged(tile, p) for _, tile in pdf.groupby(["grp", "d", "block", "cell", "lot_a", "lot_b"], sort=False) if len(tile) > 1]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("kind", "a", "b", "n")})


def tiles(rows: DataFrame, p: Parameters) -> DataFrame:
    """rows with lot, lot_a and lot_b: a cell of many rows is dealt out in lots, and each row goes to the tiles of its lot and another."""
    cell = ["grp", "d", "block", "cell"]
    many = rows.groupBy(*cell).agg(F.ceil(F.count("*") / p.lot).cast("int").alias("lots")).filter("lots > 1")
    cut = rows.join(checked_broadcast(store(many, "many"), p.most_broadcast), cell, "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    lot = cut.withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int"))
    other = lot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    return other.select(*rows.columns, "lot", F.least("lot", "other").alias("lot_a"), F.greatest("lot", "other").alias("lot_b"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; each vector is divided by its largest component first, so that no square is too large or small."""
    even = lambda v: F.transform(v, lambda x: x.cast("double") / F.array_max(F.transform(v, lambda y: F.abs(y.cast("double")))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    both = F.element_at(F.transform(F.array(F.struct(even(a).alias("x"), even(b).alias("y"))), lambda v: dot(v["x"], v["y"]) / F.sqrt(dot(v["x"], v["x"]) * dot(v["y"], v["y"]))), 1)
    return both


def embedding_dedup(vectors: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", p: Parameters = Parameters()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Two vectors of one label are linked from a cosine of p.cosine on.  n_links counts the other rows linked directly, copies
    included; component_id is the smallest vec_id that links reach, the own one included; kept where that is the own one.
    Vectors without a label, that are null, empty or zero, or hold null or non-finite components are linked with nothing; nor
    are vectors of different lengths.  Repeated rows are linked as copies; a null vec_id is left out of the minimum, and kept
    if nothing it reaches has one.  An empty table gives none; other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"))
    number = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", number) & F.exists("e", lambda x: x != 0), F.lit(False))
    # Copies are one class; equal arrays are equal keys, whatever the sign of a zero.
    classes = rows.filter(usable).groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = store(classes.select("*", F.monotonically_increasing_id().alias("node"), F.size("e").alias("d"), F.xxhash64("label").alias("grp")), "classes")

    doubles = classes.select("node", "grp", "d", "copies", F.transform("e", lambda x: x.cast("double")).alias("e"))
    put = store(doubles.mapInArrow(lambda batches: placed(batches, p), PLACED), "placed")
    laid = tiles(put, p)
    n_tasks = max(spark.sparkContext.defaultParallelism, math.ceil(put.count() / p.rows_a_task))
    bucket = F.pmod(F.xxhash64("grp", "d", "block", "cell", "lot_a", "lot_b"), F.lit(n_tasks)).alias("bucket")
    found = laid.select("*", bucket).repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(lambda pdf: judged_bucket(pdf, p), FOUND)
    found = store(found, "found")

    of = lambda x: classes.select(F.col("node").alias(x), F.col("e").alias(f"e_{x}"), F.col("copies").alias(f"copies_{x}"), F.col("label").alias(f"label_{x}"))
    close = found.filter(F.col("kind") == CLOSE).select("a", "b").join(of("a"), "a").join(of("b"), "b")
    close = store(close.filter((F.col("label_a") == F.col("label_b")) & (cosine(F.col("e_a"), F.col("e_b")) >= p.cosine)).select("a", "b", "copies_a", "copies_b"), "close")
    counts = found.filter(F.col("kind") == LINKS).select(F.col("a").alias("node"), "n")
    counts = counts.unionByName(close.select(F.col("a").alias("node"), F.col("copies_b").alias("n"))).unionByName(close.select(F.col("b").alias("node"), F.col("copies_a").alias("n")))
    links = counts.groupBy("node").agg(F.sum("n").alias("links"))
    labels = components(found.filter(F.col("kind") == FOREST).select("a", "b").union(close.select("a", "b")))
    reached = classes.join(labels.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = reached.join(smallest, "root").join(links, "node", "left")
    facts = store(facts.select("label", "e", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "facts")

    # Back to the rows: of a class with very many copies the rows stay where they are.
    hot = checked_broadcast(facts.filter(F.col("copies") > p.hot), p.most_broadcast)
    rest = facts.filter(F.col("copies") <= p.hot)
    own = free_name(rows, "own")
    marked = rows.withColumn(own, usable)
    on = ["label", "e"]
    columns = ["vec_id", "n_links", "component_id"]
    linked = marked.filter(own).join(hot, on).select(*columns).unionByName(marked.filter(own).join(hot.select(*on), on, "left_anti").join(rest, on).select(*columns))
    alone = marked.filter(~F.col(own)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = store(linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "deduped")
    drop_stored(spark, classes, put, found, close, labels, facts)
    return out
