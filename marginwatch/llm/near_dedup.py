"""MinHash near-duplicates with circulant permutations.

One permutation, applied once, shuffles a shingle's place; a second one is shifted circularly by
0, 1, 2, ... to give every coordinate of the signature, in place of one permutation per coordinate.
Bands of coordinates propose candidates, and the shingle sets decide them by exact Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.llm.common import map_batches, staged
from marginwatch.llm.components import components

WIDTH = 5
# The least number of bands, coordinates of a band and of the short signature.
BANDS, ROWS, COORDINATES = 16, 4, 64
SHORT = ("q0", "q1", "q2", "q3")
# A pair at exactly the wanted similarity may be missed with these probabilities.
BANDS_MISS, SHORT_MISS = 1e-5, 2e-5
# Counters that order shingles by frequency; their number is fixed and so is what the driver sees.
COUNTERS = 1 << 16
# Fixed odd multipliers of the word combination and of the two permutations.
MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64
)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: ASCII lower case, words between ASCII
    white space; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = max(1, n - width + 1)
    out = np.full(m, n if n < width else width, np.uint64)
    for k in range(min(width, n)):
        out = (out ^ h[k : k + m]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(places: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: min over the set of pi((sigma(x) + k) mod 2**32) for each shift k.

    ``places`` are 64-bit hashes; sigma keeps 32 mixed bits of each, and pi is a fixed bijection of
    32-bit numbers.
    """
    sigma = ((places * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(coordinates, np.uint32)
    step = max(1, (1 << 16) // max(1, len(sigma)))
    for k in range(0, coordinates, step):
        shift = np.arange(k, min(coordinates, k + step), dtype=np.uint32)
        x = sigma[None, :] + shift[:, None]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        out[k : k + len(shift)] = x.min(axis=1)
    return out


def bands_needed(percent: int) -> int:
    """Bands that miss a pair of this similarity with probability below BANDS_MISS."""
    each = 1 - (percent / 100) ** ROWS
    return max(BANDS, math.ceil(math.log(BANDS_MISS) / math.log(each))) if each > 0 else BANDS


def least_agreeing(percent: int) -> int:
    """The most coordinates of the short signature in which a pair of this similarity agrees but for
    probability SHORT_MISS; four bits also agree by chance."""
    agree, missed = percent / 100 + (1 - percent / 100) / 16, 0.0
    for k in range(COORDINATES):
        missed += math.comb(COORDINATES, k) * agree**k * (1 - agree) ** (COORDINATES - k)
        if missed >= SHORT_MISS:
            return k
    return COORDINATES


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    """One hash per band of the signature, with the band's number in it."""
    rows = coordinates.reshape(-1, ROWS).astype(np.uint64)
    out = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * MIX[k]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def nibbles(coordinates: np.ndarray) -> np.ndarray:
    """The low four bits of every coordinate, sixteen to a number."""
    low = (coordinates.reshape(-1, 16) & np.uint32(15)).astype(np.uint64)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64).view(np.int64)


def _sketch(docs: DataFrame, n_bands: int) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint, band hashes and short signature, per row of ``docs``."""

    def make():
        def each(batch: pa.RecordBatch):
            n, prints, bands, short = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                n.append(len(found))
                if len(found):
                    coordinates = signature(found, n_bands * ROWS)
                    prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_hashes(coordinates))
                    short.append(nibbles(coordinates[:COORDINATES]))
                else:
                    for column in (prints, bands, short):
                        column.append(None)
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": n,
                "print": prints,
                "bands": bands,
                **{f"q{k}": [None if q is None else int(q[k]) for q in short] for k in range(4)},
            }

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_shingles long, print binary, bands array<long>, q0 long, q1 long, q2 long, q3 long"
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, {columns}", make)


def _sets(docs: DataFrame) -> DataFrame:
    """(print, members): each distinct set of ``docs`` once."""

    def make():
        def each(batch: pa.RecordBatch):
            found = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            return {"print": [xxhash.xxh3_128_digest(f) for f in found], "members": found}

        return each

    sets = map_batches(docs.select("text"), "print binary, members binary", make)
    return sets.groupBy("print").agg(F.first("members").alias("members"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union, and their similarity."""

    def make():
        def each(batch: pa.RecordBatch):
            keep, similarity = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                union = len(a) + len(b) - both
                keep.append(100 * both >= percent * union)
                similarity.append(both / union)
            rows = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(similarity, pa.float64())], ["a", "b", "similarity"]
            ).filter(pa.array(keep, pa.bool_()))
            return {name: rows.column(i) for i, name in enumerate(rows.schema.names)}

        return each

    kind = pairs.schema["a"].dataType.simpleString()
    held = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return map_batches(held.select("a", "b", "x", "y"), f"a {kind}, b {kind}, similarity double", make)


def _prefixes(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(id, shingle, i): of each ``wanted`` set so many of its rarest shingles that similar sets share one.

    Sets of similarity t have a common shingle among the first n - ceil(t n) + 1 of each, in any
    order of shingles; i is the place in it. Rare ones come first here, by counters of a fixed number
    over all ``sets``, so that passages which many texts share propose nothing.
    """

    def count():
        total = np.zeros(COUNTERS, np.int64)

        def each(batch: pa.RecordBatch):
            for x in batch.column("members").to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
            return []

        def finish():
            at = np.flatnonzero(total)
            yield {"at": at, "n": total[at]}

        each.finish = finish
        return each

    counted = map_batches(sets.select("members"), "at long, n long", count).groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for r in counted.collect():
        counts[r["at"]] = r["n"]

    def first():
        def each(batch: pa.RecordBatch):
            ids, found, places = [], [], []
            for k, x in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist(), strict=True):
                a = np.frombuffer(x, np.uint64)
                n = len(a) - -(-percent * len(a) // 100) + 1
                order = np.lexsort((a, counts[(a % np.uint64(COUNTERS)).astype(np.int64)]))[:n]
                ids.append(np.full(len(order), k, np.int64))
                found.append(a[order].view(np.int64))
                places.append(np.arange(len(order)))
            columns = {"id": ids, "shingle": found, "i": places}
            return {name: np.concatenate([np.empty(0, np.int64), *parts]) for name, parts in columns.items()}

        return each

    of_these = sets.join(wanted, "id", "left_semi")
    return map_batches(of_these.select("id", "members"), "id long, shingle long, i long", first)


def _apart(rows: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """``rows`` with the component of their id, where rows of the same key are in several components."""
    now = rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return staged(now.join(mixed.where("low < high").select(key), key))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` with the components that ``links`` connect made one; only these links are followed."""
    ends = links
    for end in ("a", "b"):
        named = comps.select(F.col("id").alias(end), F.col("component").alias("c"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    moved = components(ends.select("a", "b").distinct()).toDF("component", "to")
    old = comps.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = moved.join(comps.select("id"), moved["component"] == comps["id"], "left_anti")
    return old.union(new.select("component", "to"))


def near_duplicates(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Rows with equal shingle sets form one class, represented by its smallest doc_id; only classes
    are compared. In every bucket of a band the members are compared with one member of the bucket.
    Members of a bucket that are not connected by then are compared if they share one of their
    rarest shingles, which similar sets must, and if sizes, the shingle's places and signatures allow
    similarity: first with one holder of each such shingle, then, where still not connected, with all.
    Links in a bucket whose members are connected already cannot change a component, so none is
    lost, and a group of thousands of near copies costs a few comparisons per member.

    There are so many bands of four coordinates, 16 for 85 and 22 for 80, that they miss a pair at
    exactly ``percent`` with probability below 1e-5. Null and empty texts have no shingles and stay alone; null ids are never linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(_sketch(docs, bands_needed(percent)))
    classes = staged(
        rows.where("print is not null and doc_id is not null")
        .groupBy("print")
        .agg(
            F.min("doc_id").alias("doc"),
            F.first("n_shingles").alias("n"),
            *[F.first(c).alias(c) for c in ("bands", *SHORT)],
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    bands = classes.select("id", "n", F.explode("bands").alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = staged(bands.join(crowded, "bucket"))
    ids = members.select("id").distinct().join(classes.select("id", "doc", "print"), "id")
    ids = staged(ids)
    wanted = docs.join(ids, docs["doc_id"] == ids["doc"], "left_semi")
    sets = staged(_sets(wanted).join(ids.select("print", "id"), "print").select("id", "members"))
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    # the smaller set's first common shingle is early, and what follows both must suffice
    early = f"j <= m - ceil(2 * {percent} * m / {100 + percent})"
    enough = f"{100 + percent} * least(n - i, m - j) >= {percent} * (n + m)"
    other = ["other", "shingle", "j", "m", *[f"r{k}" for k in range(4)], "c"]
    tried = prefixes = None
    found = False
    comps = ids.select("id", F.col("id").alias("component"))
    for turn in ("bucket", "shingle", "rest"):
        apart = _apart(members, comps, "bucket")
        if turn == "bucket":
            order = F.struct(F.xxhash64("id"), "id", "n", "component")
            pivot = apart.groupBy("bucket").agg(F.min(order).alias("p"))
            pivot = pivot.select("bucket", *[F.col(f"p.{x}").alias(y) for x, y in (("id", "other"), ("n", "m"), ("component", "c"))])
            pairs = apart.join(pivot, "bucket").where(f"component <> c and {fits}")
        else:
            if prefixes is None:
                first = _prefixes(sets, apart.select("id").distinct(), percent)
                prefixes = staged(first.join(classes.select("id", "n", *SHORT), "id"))
            left = _apart(prefixes, comps, "shingle")
            right = left.select("id", "shingle", "i", "n", *SHORT, "component").toDF(*other).where(early)
            if turn == "shingle":
                names = [c for c in other if c != "shingle"]
                least = F.min(F.struct("j", F.xxhash64("other").alias("h"), *[c for c in names if c != "j"])).alias("p")
                right = right.groupBy("shingle").agg(least).select("shingle", *[F.col(f"p.{c}").alias(c) for c in names])
                rule = "id <> other"
            else:
                rule = "(n > m or (n = m and id < other))"
            pairs = left.join(right, "shingle").where(f"{rule} and component <> c and {fits} and {enough}").where(_may_agree(percent))
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs)
        if pairs.isEmpty():
            continue
        links = staged(_verified(pairs, sets, percent).select("a", "b"))
        tried = pairs if tried is None else tried.union(pairs)
        if links.isEmpty():
            continue
        comps = staged(_merged(comps, links) if found else components(links))
        found = True
    if found:
        joined = classes.select("id", "print", "doc").join(comps, "id")
        least = joined.groupBy("component").agg(F.min("doc").alias("least"))
        alone = classes.join(comps, "id", "left_anti").select("print", F.col("doc").alias("least"))
        named = joined.join(least, "component").select("print", "least").union(alone)
    else:
        named = classes.select("print", F.col("doc").alias("least"))
    out = rows.join(named, "print", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).cast(kind).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _may_agree(percent: int) -> Column:
    """Whether the short signatures agree in enough of 64 coordinates, 42 for 85 and 38 for 80."""
    differ = "0"
    for k in range(4):
        x = f"(q{k} ^ r{k})"
        any_bit = f"({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3))"
        differ += f" + bit_count({any_bit} & {0x1111111111111111})"
    return F.expr(f"{COORDINATES} - ({differ}) >= {least_agreeing(percent)}")


def keep_one(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id; null ids come last.

    Rows are told apart by a staged key of their own: rows without an id take part, and of rows that
    share an id only copies go. Of copies with the same id any one stays. Null and empty texts stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = staged(docs.select(F.monotonically_increasing_id().alias("key"), row))
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), percent=percent)
    ids = keyed.select("key", F.col("row.doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    kept = (
        found.select(F.col("doc_id").alias("key"), "component_id")
        .join(ids, "key")
        .groupBy("component_id")
        .agg(F.min(order).alias("least"))
        .select("least.key")
    )
    return keyed.join(kept, "key", "left_semi").select("row.*")
