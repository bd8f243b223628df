"""Bounded shards of documents, their tokens as arrays, and counts of words and n-grams.

A *shard* is a run of documents of one task with at most ``SHARD_BYTES`` of text (one longer text is a
shard of its own), so memory does not follow the partition size. Inside a shard words are numbers of
its dictionary; the shards' dictionaries are summed by word, which gives every word one number for the
whole corpus, and n-grams then travel as sorted, delta-coded numbers instead of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

SHARD_BYTES = 16 << 20
# A part of the words or n-grams holds about so many entries, a shard's copy counted each.
PART_ENTRIES = 1 << 21


# numbers as bytes


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers >= 0 as seven-bit groups, low ones first, and where each ends in the bytes."""
    v = np.ascontiguousarray(values).astype(np.uint64)
    width = np.ones(len(v), np.int64)
    top = int(v.max()) if len(v) else 0
    for k in range(1, max(1, -(-top.bit_length() // 7))):
        width += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - width
    for k in range(int(width.max()) if len(v) else 0):
        has = np.flatnonzero(width > k) if k else slice(None)
        low = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & np.uint8(127)
        out[at[has] + k] = low | ((width[has] > k + 1).astype(np.uint8) << np.uint8(7))
    return out, ends


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers >= 0 as compressed byte planes, each as wide as its largest number needs."""
    heads, planes = [len(columns)], []
    for values in columns:
        width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
        heads += [len(values), width]
        whole = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)
        planes.append(whole[:, :width].T.tobytes())
    return zstandard.compress(np.array(heads, "<i8").tobytes() + b"".join(planes), 1)


def unpacked_all(raw: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    heads = data[8 : 8 + 16 * int(data[:8].view("<i8")[0])].view("<i8").reshape(-1, 2)
    at, columns = 8 + heads.size * 8, []
    for n, width in heads.tolist():
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = data[at : at + n * width].reshape(width, n).T
        columns.append(whole.view("<i8").ravel())
        at += n * width
    return columns


def unpacked(raw: bytes) -> np.ndarray:
    """The one column of ``raw``."""
    return unpacked_all(raw)[0]


def unpack(raw: bytes | np.ndarray) -> np.ndarray:
    """The inverse of :func:`pack`."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ends) == len(b):
        return b.astype(np.int64)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    groups = (b & np.uint8(127)).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(groups, starts).astype(np.int64)


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of numbers >= 0: a position of each distinct pair, in order, and each pair's rank."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = int(b.max()) + 1
    if int(a.max()) >= (1 << 62) // span:
        a = np.unique(a, return_inverse=True)[1]
    key = a.astype(np.int64) * span + b
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def dealt(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of each part's entries, in order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return np.split(order, np.cumsum(np.bincount(part, minlength=parts))[:-1])


def binaries(raw: bytes, lengths: np.ndarray) -> pa.Array:
    """Byte strings laid end to end as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def contents(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of an Arrow array of byte strings laid end to end, and their lengths."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None and len(array) else b""
    return raw, np.diff(offsets)


# texts as tokens


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Maximal runs of the bytes ``inside`` in each text, A-Z lower-cased.

    ``code`` numbers the token in ``words`` (an Arrow array of byte strings, in order of first use),
    ``doc`` is the text's place, ``piece`` changes between texts and at bytes of ``breaks``.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None):
        raw, lengths = contents(texts)
        data = _LOWER[np.frombuffer(raw, np.uint8)]
        bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        mask = inside[data]
        before, after = np.zeros_like(mask), np.zeros_like(mask)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        full = lengths > 0
        before[bounds[:-1][full]] = False
        after[bounds[1:][full] - 1] = False
        starts = np.flatnonzero(mask & ~before)
        sizes = np.flatnonzero(mask & ~after) + 1 - starts
        self.doc = np.searchsorted(bounds, starts, "right") - 1
        coded = binaries(data[mask].tobytes(), sizes).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        self.size = np.bincount(self.doc, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
        if breaks is not None:
            self.piece = np.cumsum(breaks[data], dtype=np.int64)[starts] + self.doc if len(starts) else self.doc


def map_shards(
    df: DataFrame,
    schema: str,
    each: Callable[[int, pa.RecordBatch], Iterable[dict]],
    size: int = SHARD_BYTES,
) -> DataFrame:
    """``each`` applied to every shard of the rows (with a string column ``text``, null read as empty).

    It gets a number that no other shard has and the rows with ``text`` as bytes, and gives dicts
    of columns. Write the result before it is used twice: a repeated task may cut shards anew.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        used = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, used
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            for columns in each(number, whole):
                arrays = [
                    c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                    for f, c in ((f, columns[f.name]) for f in target)
                ]
                yield pa.RecordBatch.from_arrays(
                    [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)], schema=target
                )
            number, used = number + 1, 0

        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.binary()), b"")
            batch = batch.set_column(at, "text", texts)
            lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < len(lengths):
                base = int(lengths[first - 1]) if first else 0
                last = int(np.searchsorted(lengths, base + size - used, "right"))
                if last == first and not held:
                    last = first + 1
                if last > first:
                    held.append(batch.slice(first, last - first))
                    used += int(lengths[last - 1]) - base
                if last < len(lengths) or used >= size:
                    yield from close()
                first = last
        if held:
            yield from close()

    return df.mapInArrow(run, StructType.fromDDL(schema))


# words of all shards


def parts_for(entries: int | None) -> int:
    return max(1, -(-(entries or 0) // PART_ENTRIES))


WORD_BLOCK = "shard long, part int, words binary, lengths binary, sums binary"


def word_blocks(shards: DataFrame, parts: int, sums: int) -> DataFrame:
    """A block for each shard and part, a range of hashes: its words there, and ``sums`` numbers each.

    ``shards`` holds ``shard`` and the dictionary in hash order: ``words`` laid end to end, packed ``lengths``, and
    ``sums``, packed, all first numbers before all second ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = binaries(row["words"], unpacked(row["lengths"]))
                numbers = unpacked(row["sums"]).reshape(sums, -1)
                bounds = np.searchsorted(hashes(words) * parts >> 32, np.arange(parts + 1))
                for part, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if low < high:
                        raw, lengths = contents(words.slice(low, high - low))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "shard": [row["shard"]],
                                "part": pa.array([part], pa.int32()),
                                "words": [raw],
                                "lengths": [packed(lengths)],
                                "sums": [packed(numbers[:, low:high].ravel())],
                            }
                        )

    return shards.select("shard", "words", "lengths", "sums").mapInArrow(run, WORD_BLOCK)


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words))


def in_hash_order(words: pa.Array, code: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """A dictionary sorted by hash, so that a part's words are a run of it, and the codes that go with it."""
    order = np.argsort(hashes(words), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), place[code]


def united_words(table: pa.Table, sums: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Of one part's blocks: the distinct words, their summed numbers, and each block's places in them."""
    blocks = [binaries(w.as_py(), unpacked(n.as_py())) for w, n in zip(table["words"], table["lengths"])]
    coded = pa.concat_arrays(blocks).dictionary_encode()
    codes = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(b) for b in blocks])[:-1])
    totals = np.zeros((sums, len(coded.dictionary)), np.int64)
    for code, numbers in zip(codes, table["sums"]):
        totals[:, code] += unpacked(numbers.as_py()).reshape(sums, -1)
    return coded.dictionary, totals, codes


# n-grams


class Grams:
    """Distinct two- and three-token grams as a trie of two levels: a weighted acyclic automaton.

    ``a``, ``b`` are the tokens of the paths to the second level, sorted; ``children`` their numbers of
    arcs to the third, ``c`` the labels of these, sorted within a parent. ``w2`` and ``w3`` hold one or
    more weights for every state of the two levels, one row per kind of weight.
    """

    def __init__(self, a, b, children, c, w2, w3):
        self.a, self.b, self.children, self.c, self.w2, self.w3 = a, b, children, c, w2, w3

    def parents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.a)), self.children)

    def split(self, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places on both levels of the states of each part, by ranges of the scrambled prefix (a, b)."""
        part = range_of(self.a, self.b, parts)
        return list(zip(dealt(part, parts), dealt(part[self.parents()], parts)))

    def taken(self, two: np.ndarray, three: np.ndarray) -> Grams:
        """The states at these places; ``three`` must be the children of ``two``."""
        return Grams(
            self.a[two], self.b[two], self.children[two], self.c[three], self.w2[:, two], self.w3[:, three]
        )

    def weights(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """First weights of the states that these paths lead to, 0 where there is none."""
        known = len(self.a)
        rank = pairs(np.concatenate([self.a, first]), np.concatenate([self.b, second]))[1]
        table = np.zeros(int(rank.max()) + 1 if len(rank) else 0, np.int64)
        table[rank[:known]] = self.w2[0]
        return table[rank[known:]]

    def to_bytes(self) -> bytes:
        """Labels as steps from the sibling before, which sorted siblings keep small."""
        a = np.diff(self.a, prepend=0)
        return packed(
            a,
            _deltas(self.b, self._same_first(self.a)),
            self.children,
            _deltas(self.c, self._siblings(self.children, len(self.c))),
            *self.w2,
            *self.w3,
        )

    @classmethod
    def of_bytes(cls, raw: bytes) -> Grams:
        a, b, children, c, *weights = unpacked_all(raw)
        a = np.cumsum(a)
        b = _summed(b, cls._same_first(a))
        c = _summed(c, cls._siblings(children, len(c)))
        kinds = len(weights) // 2
        return cls(a, b, children, c, np.stack(weights[:kinds]), np.stack(weights[kinds:]))

    @staticmethod
    def _same_first(a: np.ndarray) -> np.ndarray:
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        return same

    @staticmethod
    def _siblings(children: np.ndarray, n: int) -> np.ndarray:
        """Whether each of ``n`` states of the third level has the parent of the state before."""
        same = np.ones(n, bool)
        same[(np.cumsum(children) - children)[children > 0]] = False
        return same

    @classmethod
    def counted(
        cls,
        first: np.ndarray,
        second: np.ndarray,
        two: np.ndarray,
        third: np.ndarray,
        w2: np.ndarray,
        w3: np.ndarray,
    ) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The trie of occurrences, built from the sorted grams, and the state of every occurrence.

        ``first``, ``second`` are the tokens of each two-token occurrence; ``two`` are the places among
        these that a ``third`` token follows. ``w2``, ``w3`` hold what an occurrence adds to a weight.
        """
        at2, state2 = pairs(first, second)
        at3, state3 = pairs(state2[two], third)
        children = np.bincount(state2[two][at3], minlength=len(at2))
        weights2 = np.array([np.bincount(state2, w, len(at2)) for w in w2], np.int64).reshape(len(w2), -1)
        weights3 = np.array([np.bincount(state3, w, len(at3)) for w in w3], np.int64).reshape(len(w3), -1)
        return cls(first[at2], second[at2], children, third[at3], weights2, weights3), state2, state3

    @classmethod
    def united(cls, tries: list[Grams]) -> tuple[Grams, list[tuple[np.ndarray, np.ndarray]]]:
        """The union, weights of equal paths summed, and each trie's states in it."""
        a, b = (np.concatenate([getattr(t, x) for t in tries]) for x in "ab")
        offsets = np.cumsum([0] + [len(t.a) for t in tries])
        two = np.concatenate([t.parents() + k for t, k in zip(tries, offsets)])
        third = np.concatenate([t.c for t in tries])
        whole, state2, state3 = cls.counted(
            a,
            b,
            two,
            third,
            np.concatenate([t.w2 for t in tries], axis=1),
            np.concatenate([t.w3 for t in tries], axis=1),
        )
        cut2, cut3 = offsets[1:-1], np.cumsum([len(t.c) for t in tries])[:-1]
        return whole, list(zip(np.split(state2, cut2), np.split(state3, cut3)))


def range_of(a: np.ndarray, b: np.ndarray, ranges: int) -> np.ndarray:
    """Which of the equal ranges of the scrambled pairs each pair is in."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.int64) * ranges >> 32


def _deltas(values: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Steps from the entry before where ``same``, else the values."""
    out = values.copy()
    out[1:] -= np.where(same[1:], values[:-1], 0)
    return out


def _summed(steps: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The inverse of :func:`_deltas`."""
    total = np.cumsum(steps)
    starts = np.flatnonzero(~same)
    lengths = np.diff(np.append(starts, len(steps)))
    return total - np.repeat(total[starts] - steps[starts], lengths)


def entries(shards: DataFrame, column: str) -> int:
    """The sum of a column of counts; one row reaches the driver."""
    return shards.agg(F.sum(column)).first()[0] or 0
