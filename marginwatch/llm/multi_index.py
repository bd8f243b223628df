"""Near-duplicate vectors through an inverted multi-index.

Two independent codebooks quantise the two halves of every vector; their product is a grid of cells.
From its own halves each vector visits the cells in multi-sequence order, nearest first, until no
further cell can hold a vector within reach, and only the vectors of the visited cells are verified.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import map_batches, staged
from marginwatch.llm.components import components

MEMBERS, VISITORS = 2_048, 4_096


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, zero or not finite."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / math.sqrt(v @ v)


def codebook(points: np.ndarray, size: int, turns: int = 10) -> np.ndarray:
    """Centroids of ``points`` by Lloyd's algorithm, started at distinct points drawn with a fixed seed."""
    distinct = np.unique(points, axis=0)
    draw = np.random.default_rng(7).permutation(len(distinct))[: max(1, size)]
    centres = distinct[draw] if len(distinct) else np.zeros((1, points.shape[1]))
    for _ in range(turns):
        near = _squares(points, centres).argmin(1)
        for k in np.unique(near):
            centres[k] = points[near == k].mean(0)
    return np.unique(centres, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and for every centre a lower bound of the squared distance between
    the row and any point whose nearest centre it is: that to the plane halfway to the row's own."""
    d = _squares(x, centres)
    near = d.argmin(1)
    apart = np.sqrt(_squares(centres, centres))[near]
    with np.errstate(divide="ignore", invalid="ignore"):
        low = (d - d[np.arange(len(x)), near][:, None]) / (2 * apart)
    low[np.arange(len(x)), near] = 0
    return near, np.maximum(np.nan_to_num(low, nan=0.0, posinf=0.0), 0) ** 2


def visits(first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells of the product grid in order of bound, as long as it is at most ``reach``.

    Multi-sequence traversal: both lists of bounds are sorted, and a heap holds the frontier of the
    grid of sums.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap:
        low, i, j = heapq.heappop(heap)
        if low > reach:
            break
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def _compare(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """Links of one block of visitors with one block of members of the same row of the grid.

    Gives (u, null, n): n vectors linked with u; and (u, v, 0): u and v are connected here.
    """
    ids = np.array(left.column("id").to_pylist(), np.int64)
    v = np.array([np.frombuffer(x) for x in left.column("unit").to_pylist()])
    cells = left.column("cells").to_pylist()
    other = np.array(right.column("id").to_pylist(), np.int64)
    copies = np.array(right.column("copies").to_pylist(), np.int64)
    w = np.array([np.frombuffer(x) for x in right.column("unit").to_pylist()])
    cell = np.array(right.column("b").to_pylist(), np.int64)
    links, us, vs = np.zeros(len(ids), np.int64), [], []
    by_cell: dict[int, list[int]] = {}
    for k, found in enumerate(cells):
        for b in found:
            by_cell.setdefault(b, []).append(k)
    for b in np.unique(cell):
        asked, there = np.array(by_cell.get(int(b), []), np.int64), np.flatnonzero(cell == b)
        if len(asked):
            hit = v[asked] @ w[there].T >= least
            hit &= ids[asked][:, None] != other[there][None, :]
            links[asked] += hit @ copies[there]
            x, y = np.nonzero(hit)
            us.append(asked[x])
            vs.append(there[y])
    us = np.concatenate([np.empty(0, np.int64), *us])
    vs = np.concatenate([np.empty(0, np.int64), *vs])
    low, low_other = ids.copy(), other.copy()
    before = -1
    while len(us) and (now := int(low.sum() + low_other.sum())) != before:
        before = now
        np.minimum.at(low_other, vs, low[us])
        np.minimum.at(low, us, low_other[vs])
    joined, joined_other = np.flatnonzero(low != ids), np.flatnonzero(low_other != other)
    some = np.flatnonzero(links)
    u = np.concatenate([ids[some], ids[joined], other[joined_other]])
    to = np.concatenate([np.zeros(len(some), np.int64), low[joined], low_other[joined_other]])
    n = np.concatenate([links[some], np.zeros(len(joined) + len(joined_other), np.int64)])
    mask = np.arange(len(u)) < len(some)
    return pa.table({"u": pa.array(u), "v": pa.array(to, mask=mask), "n": pa.array(n)})


def near_vectors(
    rows: DataFrame, *, least: float = 0.98, codewords: int | None = None, sample: int = 4_096
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows`` (vec_id, embedding, label).

    Vectors of equal, non-null label and equal dimension are linked at cosine ``least`` or more.
    Exact copies are one vector with a number of copies. The codebooks are fitted on about
    ``sample`` vectors; every vector is indexed. ``codewords`` per half grows with the square root of
    the number of vectors, up to 256. Unit vectors at cosine c lie sqrt(2 - 2c) apart, and a visit
    ends where the bound on that distance is exceeded, so recall is full but for rounding.

    A row of the grid is cut into blocks of members and of visitors, compared block by block, so a
    crowded cell is spread over tasks; what leaves a block is linear in it, not the links. Vectors
    that are null, zero or not finite have no links and stay alone.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()

    def prepare():
        def each(batch: pa.RecordBatch):
            found = [unit(x) for x in batch.column("embedding").to_pylist()]
            labels = batch.column("label").to_pylist()
            found = [None if y is None else x for x, y in zip(found, labels, strict=True)]
            return {
                "vec_id": batch.column("vec_id"),
                "label": batch.column("label"),
                "unit": [None if x is None else x.tobytes() for x in found],
            }

        return each

    label = rows.schema["label"].dataType.simpleString()
    prepared = map_batches(
        rows.select("vec_id", "embedding", "label"), f"vec_id {kind}, label {label}, unit binary", prepare
    )
    prepared = staged(prepared.withColumn("print", F.when(F.col("unit").isNotNull(), F.sha2("unit", 256))))
    nodes = staged(
        prepared.where("unit is not null and vec_id is not null")
        .groupBy("label", "print")
        .agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    n = nodes.count()
    size = codewords or max(2, min(256, int(math.sqrt(n / 64))))
    share = F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))
    drawn: dict[int, list[np.ndarray]] = {}
    for r in nodes.where(share).select("unit").collect():
        v = np.frombuffer(r["unit"])
        drawn.setdefault(len(v), []).append(v)
    books = {
        d: (codebook(np.array(v)[:, : d // 2], size), codebook(np.array(v)[:, d // 2 :], size)) for d, v in drawn.items()
    }
    reach = 2 - 2 * least + 1e-9

    def quantise():
        def each(batch: pa.RecordBatch):
            units = [np.frombuffer(x) for x in batch.column("unit").to_pylist()]
            width, own_a, own_b, rows_a, rows_b = [], [], [], [], []
            for v in units:
                d = len(v)
                first, second = books.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))
                near_a, low_a = _bounds(v[None, : d // 2], first)
                near_b, low_b = _bounds(v[None, d // 2 :], second)
                lists: dict[int, list[int]] = {}
                for a, b in visits(low_a[0], low_b[0], reach):
                    lists.setdefault(a, []).append(b)
                width.append(d)
                own_a.append(int(near_a[0]))
                own_b.append(int(near_b[0]))
                rows_a.append(list(lists))
                rows_b.append(list(lists.values()))
            out = {c: batch.column(c) for c in ("id", "label", "copies", "unit")}
            return out | {"d": width, "a": own_a, "b": own_b, "visit": rows_a, "cells": rows_b}

        return each

    columns = f"id long, label {label}, copies long, unit binary, d int, a int, b int"
    indexed = staged(
        map_batches(
            nodes.select("id", "label", "copies", "unit"),
            f"{columns}, visit array<int>, cells array<array<int>>",
            quantise,
        )
    )
    place = ["label", "d", "a"]
    visitors = indexed.select(
        "id", "label", "d", "unit", F.explode(F.arrays_zip("visit", "cells")).alias("to")
    ).select("id", "label", "d", "unit", F.col("to.visit").alias("a"), F.col("to.cells").alias("cells"))
    members = indexed.select("id", *place, "b", "copies", "unit")
    asked = visitors.groupBy(place).agg(F.count("*").alias("asked"))
    there = members.groupBy(place).agg(F.count("*").alias("there"))
    blocks = staged(
        there.join(asked, place).select(
            *place,
            F.ceil(F.col("there") / MEMBERS).cast("int").alias("rows"),
            F.ceil(F.col("asked") / VISITORS).cast("int").alias("columns"),
        )
    )

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def draw(count: str):
        return F.pmod(F.xxhash64("id", F.lit(count)), F.col(count)).cast("int")

    key = [*place, "row", "column"]
    left = visitors.join(blocks, place).withColumn("column", draw("columns")).withColumn("row", every("rows"))
    right = members.join(blocks, place).withColumn("row", draw("rows")).withColumn("column", every("columns"))
    left = left.select(*key, "id", "unit", "cells").toDF(*key, "id", "unit", "cells")
    right = right.select(*key, "id", "unit", "b", "copies").toDF(*key, "id", "unit", "b", "copies")
    schema = "u long, v long, n long"

    def block(key, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "n")})
        return _compare(one, two, least)

    found = staged(left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(block, schema))
    links = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    comps = staged(components(found.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b"))))
    named = nodes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("vec").alias("lowest"))
    summed = (
        named.join(lowest, "component")
        .join(links, F.col("id") == F.col("u"), "left")
        .select("label", "print", "lowest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return prepared.join(summed, ["label", "print"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("lowest", "vec_id")).cast(kind).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("lowest", "vec_id"), F.lit(True)).alias("kept"),
    )
