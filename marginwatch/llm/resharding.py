"""Resharding that moves the fewest bytes, by minimum-cost flow.

Old shards supply their bytes, new shards demand their capacities, and an arc costs what moving a
byte along it costs (nothing from a shard to itself). The flow between shards, a problem as small as
the number of shards, is solved on the driver; its arcs then become ranges of each old shard, cut at
blocks of equal hash, and only the files of shards with a changed range are rewritten.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginwatch.llm.common import staged

# A shard is numbered in parts of about this many bytes, at least 16 of them.
CHUNK_BYTES = 128 << 20


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Cheapest shipment of ``supply`` into ``demand`` (equal sums), by successive shortest paths.

    Rows are sources, columns sinks. Potentials keep reduced costs non-negative, so each path is a
    Dijkstra search over sources and sinks.
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    height = [0.0] * n + [min(cost[i][j] for i in range(n)) for j in range(m)]
    while any(left):
        dist = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back: list[int | None] = [None] * (n + m)
        heap = [(0.0, i) for i in range(n) if left[i]]
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = ((n + j, cost[u][j] + height[u] - height[n + j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n] + height[u] - height[i]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                if d + max(c, 0.0) < dist[v]:
                    dist[v], back[v] = d + max(c, 0.0), u
                    heapq.heappush(heap, (dist[v], v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                amount = min(amount, flow[v][u - n])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
        height = [h + min(d, dist[end]) for h, d in zip(height, dist, strict=True)]
    return flow


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


Arcs = dict[int, list[tuple[int, int]]]


def _arcs(flow: list[list[int]]) -> Arcs:
    """Per old shard the ends of its ranges and their targets; its own part comes first."""
    arcs: Arcs = {}
    for i, row in enumerate(flow):
        at, arcs[i] = 0, []
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                at += row[j]
                arcs[i].append((at, j))
    return arcs


def _place(groups: list[tuple], arcs: Arcs, begun: dict[tuple, int], slack: int) -> tuple[list, list]:
    """Targets of the groups inside one range, or no larger than ``slack``; and the others' starts.

    Groups are (old shard, keys..., bytes) in order; ``begun`` has the start of each parent, that is
    of the same keys without the last.
    """
    placed, split = [], []
    at = dict(begun)
    for *keys, size in groups:
        i, parent = keys[0], tuple(keys[:-1])
        low = at.get(parent, 0)
        at[parent] = high = low + size
        ends = arcs[i]
        first = next((j for end, j in ends if end > low), ends[-1][1])
        last = next((j for end, j in ends if end >= high), ends[-1][1])
        if first == last:
            placed.append((*keys, first))
        elif size <= slack:
            placed.append((*keys, next((j for end, j in ends if 2 * end >= low + high), ends[-1][1])))
        else:
            split.append((*keys, low))
    return placed, split


def reshard(
    docs: DataFrame,
    shards: int,
    *,
    old_shard: Column,
    old_shards: int,
    capacities: list[int] | None = None,
    cost: list[list[float]] | None = None,
    blocks: int = 1024,
    cells: int = 256,
    whole: bool = False,
) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot: one row per row of ``docs``; and ``row``, a
    struct of all its columns, if ``whole`` is asked for, to go to ``rewrite``.

    ``old_shard`` gives each row's present shard, 0 to ``old_shards`` - 1. ``capacities`` are bytes
    per new shard, equal by default; ``cost`` is per byte and pair, 0 to itself and 1 otherwise by
    default. A shard's rows are ranged by block and cell, two hashes of the text, so equal texts lie
    together and move together unless they exceed half a percent of a shard; then grains, hashes of
    id and text, split even a block made of one text's copies. At most ``old_shards * blocks`` block
    sizes, and ``cells`` sizes per range end and level, reach the driver, whatever the number of
    rows. Null ids and texts are rows like others. For the placement texts are read once and never
    shuffled; whole rows are read again, placed by the same hashes, and shuffled once. A row's place
    depends on what it holds alone, so null and repeated ids need no key.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    hashed = [
        "doc_id",
        text_size().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64(text, F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
        F.pmod(F.xxhash64(text, F.lit("cell")), F.lit(cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("doc_id", text, F.lit("grain")), F.lit(cells)).cast("int").alias("grain"),
        F.xxhash64("doc_id", text, F.lit("place")).alias("place"),
    ]
    rows = staged(docs.select(*hashed))
    keys = ["old_shard", "block", "cell", "grain"]
    sums = rows.groupBy(keys[:2]).agg(F.sum("size").alias("n")).orderBy(keys[:2]).collect()
    supply = [0] * old_shards
    for r in sums:
        supply[r["old_shard"]] += r["n"]
    total = sum(supply)
    if capacities is None:
        capacities = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    if cost is None:
        cost = [[float(i != j) for j in range(shards)] for i in range(old_shards)]
    arcs = _arcs(min_cost_flow(supply, capacities, cost))
    slack, found = total // (200 * shards), docs.select(*hashed, F.struct("*").alias("row")) if whole else rows
    found = found.withColumn("shard", F.lit(None).cast("int"))
    begun: dict[tuple, int] = {}
    for level in (2, 3, 4):
        by = keys[:level]
        groups = [(*(r[k] for k in by), r["n"]) for r in sums]
        placed, split = _place(groups, arcs, begun, 0 if level == 2 else slack if level == 3 else total)
        names = ", ".join(f"{k} int" for k in by)
        to = spark.createDataFrame(placed, f"{names}, to int")
        found = found.join(F.broadcast(to), by, "left").withColumn("shard", F.coalesce("shard", "to")).drop("to")
        if not split:
            break
        begun = {tuple(x[:-1]): x[-1] for x in split}
        inner = rows.join(F.broadcast(spark.createDataFrame(split, f"{names}, low long")), by)
        finer = keys[: level + 1]
        sums = inner.groupBy(finer).agg(F.sum("size").alias("n")).orderBy(finer).collect()
    kept = [*(["row"] if whole else []), "doc_id", "size", "text_crc32", "old_shard", "shard", "place"]
    chunks = max(16, -(-max(capacities, default=0) // CHUNK_BYTES))
    return number_rows(found.select(*kept), chunks=chunks)


def number_rows(placed: DataFrame, ranges: int = 4096, chunks: int = 16) -> DataFrame:
    """Adds a gapless slot from 0 within each shard.

    Rows are counted per shard and range of ``place``; the ranges' starts come from a running sum
    over those few counts, and only inside a range are rows numbered, so no shard is one task's.
    Ranges that follow each other, ``chunks`` parts of a shard, stay together; slots do not depend on
    their number, which is at most that of the ranges.
    """
    chunks = min(chunks, ranges)
    placed = placed.withColumn("range", F.pmod("place", F.lit(ranges)).cast("int"))
    placed = placed.withColumn("chunk", F.expr(f"range div {-(-ranges // chunks)}").cast("int"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk", "range").orderBy("place", "doc_id", "text_crc32", "size")
    return (
        placed.repartition("shard", "chunk")
        .withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "range"])
        .withColumn("slot", F.col("start") + F.col("nth") - 1)
        .drop("range", "chunk", "start", "nth", "place")
    )


def rewrite(assigned: DataFrame, path: str, *, apart: bool = False) -> list[int]:
    """Rewrite the shard folders under ``path`` that lose or gain rows, and no others.

    ``assigned`` holds whole rows with old_shard and shard, and maybe slot: then every file is in the
    order of slots. Folders are ``shard=<n>``; those of shards without a move are left untouched.
    ``apart`` says that ``assigned`` is not read from ``path``; otherwise rows are staged before they
    replace what they come from. Returns the shards rewritten.
    """
    spark = assigned.sparkSession
    pairs = assigned.select("old_shard", "shard").distinct().collect()
    changed = sorted({x for r in pairs if r["old_shard"] != r["shard"] for x in r if x is not None})
    if changed:
        rows = assigned.where(F.col("shard").isin(changed))
        rows = rows if apart else staged(rows)
        if "slot" in rows.columns:
            rows = rows.sortWithinPartitions("shard", "slot")
        (
            rows.drop("old_shard")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("shard")
            .parquet(path)
        )
        empty = set(changed) - {r["shard"] for r in pairs}
        for k in sorted(empty):
            spark.createDataFrame([], rows.drop("old_shard", "shard").schema).write.mode("overwrite").parquet(
                f"{path}/shard={k}"
            )
    return changed
