"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Every distinct word of a text is hashed to one of ``2**bits`` features; each structure statistic
(length, repetition, letter classes, line shape, ...) is one more feature per step of its scale. The
pairwise interactions of all features have low rank and are scored in time linear in the number of
features by the identity sum_ij <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import held_out, labelled, map_batches, staged

STEPS = 10
# Weights travel in blocks of so many numbers.
BLOCK = 4096
# Scales of the statistics: (lowest, highest) value, cut into STEPS steps.
SCALES = {
    "words": (0.0, 12.0),
    "unique": (0.0, 1.0),
    "letters": (0.4, 0.9),
    "upper": (0.0, 0.5),
    "digits": (0.0, 0.2),
    "marks": (0.0, 0.4),
    "word_length": (0.0, 10.0),
    "lines": (0.0, 8.0),
    "unique_lines": (0.0, 1.0),
    "top_word": (0.0, 0.5),
    "repeats": (0.0, 0.5),
}
# Byte classes of UTF-8: 0 other, 1 lower or multi-byte letter, 2 upper, 3 digit, 4 white space.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123] = 1
CLASSES[128:] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4


@dataclass
class Machine:
    """Bias, linear weights w (n,) and factors v (n, rank)."""

    b: float
    w: np.ndarray
    v: np.ndarray
    bits: int

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(0)
        return float(self.b + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def size(bits: int) -> int:
    return (1 << bits) + STEPS * len(SCALES)


def features(text: str, bits: int, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; an empty one has its statistics only."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    distinct = set(words)
    n = len(words)
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=5)
    solid = max(1, int(kinds.sum() - kinds[4]))
    lines = [x for x in raw.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    if len(distinct) < n:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stats = {
        "words": math.log1p(n),
        "unique": len(distinct) / n if n else 0.0,
        "letters": kinds[1] / solid,
        "upper": kinds[2] / solid,
        "digits": kinds[3] / solid,
        "marks": kinds[0] / solid,
        "word_length": solid / max(1, n),
        "lines": math.log1p(len(lines)),
        "unique_lines": len(set(lines)) / len(lines) if lines else 0.0,
        "top_word": max(counts.values(), default=min(1, n)) / max(1, n),
        "repeats": repeats / max(1, n),
    }
    base, mask = 1 << bits, (1 << bits) - 1
    at = []
    for k, (name, (low, high)) in enumerate(SCALES.items()):
        step = int((stats[name] - low) / (high - low) * STEPS)
        at.append(base + k * STEPS + max(0, min(STEPS - 1, step)))
    hashed = set()
    for w in distinct:
        h = memo.get(w)
        if h is None:
            h = zlib.crc32(w) & mask
            if len(memo) < 200_000:
                memo[w] = h
        hashed.add(h)
    out = np.fromiter([*at, *sorted(hashed)], np.int32, len(at) + len(hashed))
    x = np.full(len(out), 1.0 / math.sqrt(max(1, len(hashed))))
    x[: len(at)] = 1.0
    return out, x


def _epoch(m: Machine, rows: list, rate: float, decay: float, rng: np.random.Generator) -> None:
    """One pass of stochastic gradient steps, in place."""
    for k in rng.permutation(len(rows)):
        at, x, y, weight = rows[k]
        vx = m.v[at] * x[:, None]
        total = vx.sum(0)
        z = m.b + m.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum())
        g = weight * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
        m.b -= rate * g
        m.w[at] -= rate * (g * x + decay * m.w[at])
        step = g * x[:, None] * (total - vx) + decay * m.v[at]
        m.v[at] -= rate * np.clip(step, -1, 1)


def _mean_of_block(table: pa.Table) -> pa.Table:
    """The mean of one block of weights over all slices, summed in their order."""
    table = table.sort_by("slice")
    total = sum(np.frombuffer(x) for x in table["sums"].to_pylist()) / sum(table["n"].to_pylist())
    return pa.table({"block": table["block"].slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    max_rows: int = 16_000,
    bits: int = 13,
    rank: int = 6,
    rounds: int = 6,
    rate: float = 0.1,
    decay: float = 1e-4,
) -> Machine:
    """Fit on the labelled rows: each round one pass runs over every slice of them from the shared
    weights, and the slices' weights are averaged by their numbers of rows.

    ``max_rows`` bounds the labelled rows. Weights are averaged in the cluster, block by block, so one
    set, whose size is fixed by ``bits`` and ``rank``, reaches the driver. There are at most eight slices.
    Equal labelled rows train once. Rows are dealt to slices by their content and sorted there, so the
    model depends neither on how the input lies nor on the number of tasks. Without labels of both classes the model scores the
    share of label 1 (one half if there is none).
    """
    def extract():
        memo: dict[bytes, int] = {}

        def each(batch):
            at, x, ys = [], [], batch.column("y").to_pylist()
            for text in batch.column("text").to_pylist():
                a, b = features(text, bits, memo)
                at.append(a.astype("<i4").tobytes())
                x.append(b.astype("<f8").tobytes())
            return {"at": at, "x": x, "y": [int(y == 1) for y in ys]}

        return each

    rows = labelled(docs, labels, label, max_rows)
    rows = staged(map_batches(rows, "at binary, x binary, y int", extract).dropDuplicates())
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    machine = Machine(math.log((good + 1) / (bad + 1)), np.zeros(size(bits)), np.zeros((size(bits), rank)), bits)
    if not good or not bad:
        return machine
    machine.v = np.random.default_rng(1).normal(0, 0.02, machine.v.shape)
    weights = {1: (good + bad) / (2 * good), 0: (good + bad) / (2 * bad)}
    machine.b = 0.0
    parts = max(1, min(8, (good + bad) // 500))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("at", "x", "y"), F.lit(parts)))
    order = [(name, "ascending") for name in ("at", "x", "y")]
    for turn in range(rounds):
        shared = machine

        def step(table: pa.Table) -> pa.Table:
            own, held = Machine(shared.b, shared.w.copy(), shared.v.copy(), bits), []
            table = table.sort_by(order)
            for a, b, y in zip(*(table[c].to_pylist() for c in ("at", "x", "y")), strict=True):
                held.append((np.frombuffer(a, "<i4"), np.frombuffer(b, "<f8"), y, weights[y]))
            _epoch(own, held, rate / (1 + turn / 2), decay, np.random.default_rng(turn))
            flat = np.concatenate([[own.b], own.w, own.v.ravel()]) * len(held)
            blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
            k = len(blocks)
            return pa.table(
                {
                    "block": pa.array(range(k), pa.int32()),
                    "slice": pa.array([table["slice"][0].as_py()] * k, pa.int64()),
                    "n": pa.array([len(held)] * k, pa.int64()),
                    "sums": pa.array(blocks, pa.binary()),
                }
            )

        found = rows.groupBy("slice").applyInArrow(step, "block int, slice long, n long, sums binary")
        mean = found.groupBy("block").applyInArrow(_mean_of_block, "block int, mean binary").collect()
        flat = np.concatenate([np.frombuffer(r["mean"]) for r in sorted(mean, key=lambda r: r["block"])])
        cut = 1 + len(machine.w)
        machine = Machine(float(flat[0]), flat[1:cut].copy(), flat[cut:].reshape(-1, rank).copy(), bits)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle; null texts count as empty."""

    def scorer():
        memo: dict[bytes, int] = {}

        def each(batch):
            z = [machine.logit(*features(t or "", bits, memo)) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))}

        return each

    bits = machine.bits
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, score double", scorer)


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **training) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Features come from the text alone. Repeated ids, repeated rows and extra columns are harmless.
    """
    return score(docs, train(docs, labels, **training)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
