"""Benchmark decontamination by shared pieces and exact edit distance, without loss.

An item is cut into more pieces than it may have edits, so every occurrence holds a known number of
the pieces unchanged and at nearly the same displacement. All places of a text where that many
pieces meet are candidates, and exact edit distance decides them: what is found equals a search of
every window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import map_batches, staged

PLAIN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
# A piece is at most a machine word.
PIECE = 8
# Bytes of text searched together, positions per step, and pieces met that are held at once.
RUN, STEP, HELD = 1 << 22, 1 << 17, 1 << 22
SPREAD, BITS = np.uint64(0x9E3779B97F4A7C15), 22


def normal(text: str | None) -> tuple[bytes, list[bytes]]:
    """UTF-8 words joined by single blanks, and the words: ASCII letters in lower case, every ASCII
    character that is neither letter nor digit a blank."""
    words = (text or "").encode("utf-8", "replace").translate(PLAIN).split()
    return b" ".join(words), words


def best_match(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, end) of the substring of ``text`` nearest to ``item``, None above ``most`` edits.

    Bit-parallel dynamic programming with free start and end in the text.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << k)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, edits, best = full, 0, n, (n, 0)
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(d | plus) & full), plus & d
        edits += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | (~(x | up) & full)) & full, up & x
        if edits < best[0]:
            best = (edits, end)
    return best if best[0] <= most else None


def locate(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the nearest substring, or None above ``most`` edits."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    found = best_match(item, text, most)
    if found is None:
        return None
    edits, end = found
    back = best_match(item[::-1], text[:end][::-1], most)
    return edits, end - (back[1] if back else len(item)), end


def cut(size: int, share: float) -> tuple[int, int]:
    """Length of the pieces of an item of ``size`` bytes, and how many of them every occurrence holds.

    The longest pieces of which three remain, or as many as possible; short pieces only where an
    item must have them.
    """
    edits = int(share * size)
    if not edits:
        piece = min(PIECE, size)
        return piece, size // piece
    remain = {q: size // q - edits for q in range(1, min(PIECE, size) + 1)}
    fair = [q for q, n in remain.items() if n > 0 and q >= 4]
    piece = max(fair, key=lambda q: (min(remain[q], 3), q)) if fair else max(q for q, n in remain.items() if n > 0)
    return piece, remain[piece]


def _words(data: bytes, piece: int) -> np.ndarray:
    """The ``piece`` bytes from every place of ``data`` on, each as one number."""
    whole = np.ndarray((len(data) - PIECE + 1,), "<u8", data, 0, (1,))
    return whole & np.uint64((1 << 8 * piece) - 1)


class Pieces:
    """The pieces of one length: distinct ones in order, and the items and offsets that own each."""

    def __init__(self, piece: int, items: list[tuple[int, bytes]]):
        words, owners, offsets = [], [], []
        for k, text in items:
            at = np.arange(len(text) // piece) * piece
            words.append(_words(text + bytes(PIECE), piece)[at])
            owners.append(np.full(len(at), k, np.int64))
            offsets.append(at)
        word, owner, offset = np.concatenate(words), np.concatenate(owners), np.concatenate(offsets)
        order = np.lexsort((offset, owner, word))
        self.piece, self.owner, self.offset = piece, owner[order], offset[order]
        self.words, self.first, self.n = np.unique(word[order], return_index=True, return_counts=True)
        self.filter = None

    def met(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``data`` where a piece lies, and which."""
        if self.filter is None:
            self.filter = np.zeros(1 << BITS, bool)
            self.filter[(self.words * SPREAD) >> np.uint64(64 - BITS)] = True
        places, pieces = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin in range(0, len(data) - PIECE + 1, STEP):
            words = _words(data[begin : begin + STEP + PIECE - 1], self.piece)
            at = np.flatnonzero(self.filter[(words * SPREAD) >> np.uint64(64 - BITS)])
            which = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
            same = self.words[which] == words[at]
            places.append(at[same] + begin)
            pieces.append(which[same])
        return np.concatenate(places), np.concatenate(pieces)


def _spans(
    found: Pieces, places: np.ndarray, pieces: np.ndarray, starts: np.ndarray, limits: tuple, items: tuple[int, int]
) -> Iterator[tuple[int, int, int | None, int | None]]:
    """(item, text, first, last displacement) wherever enough pieces of an item meet; None for a whole text.

    Only items of the range ``items`` count. It is halved as long as too many pieces met would be
    held; an item that alone meets so many is left to a search of the whole texts.
    """
    low, high = items
    chosen = np.flatnonzero((found.owner >= low) & (found.owner < high))
    first = np.searchsorted(chosen, found.first)
    n = (np.searchsorted(chosen, found.first + found.n) - first)[pieces]
    total = int(n.sum())
    if not total:
        return
    if total > HELD and high - low > 1:
        for half in ((low, (low + high) // 2), ((low + high) // 2, high)):
            yield from _spans(found, places, pieces, starts, limits, half)
        return
    texts = np.searchsorted(starts, places, side="right") - 1
    if total > HELD:
        yield from ((low, int(k), None, None) for k in np.unique(texts[n > 0]))
        return
    own = chosen[np.repeat(first[pieces] - (np.cumsum(n) - n), n) + np.arange(total)]
    sizes, edits, least = limits
    text, item, room = np.repeat(texts, n), found.owner[own], int(sizes.max())
    moved = np.repeat(places, n) - starts[text] - found.offset[own] + room
    width = int(np.diff(starts).max()) + 2 * room
    keys = np.sort((item * (len(starts) - 1) + text) * width + moved)
    group = keys // width
    item = group // (len(starts) - 1)
    last = np.arange(total) + least[item] - 1
    inside = np.flatnonzero(last < total)
    enough = inside[keys[last[inside]] - keys[inside] <= edits[item[inside]]]
    enough = enough[group[enough] == group[last[enough]]]
    for k, g, i in zip(enough.tolist(), group[enough].tolist(), item[enough].tolist(), strict=True):
        yield i, g % (len(starts) - 1), int(keys[k] % width) - room, int(keys[last[k]] % width) - room


def candidates(
    texts: list[bytes], groups: list[Pieces], sizes: np.ndarray, edits: np.ndarray, least: np.ndarray
) -> dict[tuple[int, int], list[list[int]]]:
    """(text, item) with the parts of the text, apart from each other, that hold all its occurrences."""
    data = b"\0".join(texts) + bytes(PIECE)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    parts: dict[tuple[int, int], list[list[int]]] = {}
    for found in groups:
        places, pieces = found.met(data)
        for item, text, first, last in _spans(found, places, pieces, starts, (sizes, edits, least), (0, len(sizes))):
            begin, end = 0, len(texts[text])
            if first is not None:
                begin = max(0, first - int(edits[item]))
                end = min(end, last + int(sizes[item]) + 2 * int(edits[item]))
            before = parts.setdefault((text, item), [])
            if before and begin <= before[-1][1]:
                before[-1][1] = max(before[-1][1], end)
            else:
                before.append([begin, end])
    return parts


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    share: float = 0.1,
    most_items: int = 20_000,
    most_bytes: int = 1 << 24,
    min_length: int = 1,
    inside_words: bool = True,
) -> DataFrame:
    """doc_id, item_id, edits, start, end: the best occurrence of every item in every row of ``docs``.

    An item occurs where a passage lies within ``share`` of its length in edits, both taken as UTF-8
    bytes of their words (see ``normal``); start and end are bytes of that form of the text. Every
    occurrence is found, and the best has the fewest edits, then the first end. Items are searched in
    blocks of about ``most_items`` and ``most_bytes``, or of one item that is longer; a task holds a
    few times these bytes, whatever the size of the benchmark.
    Items with no edits to spare (shorter than ten bytes by default) are found as they are, also inside
    words; without ``inside_words`` only where no ASCII letter or digit adjoins one of theirs. A larger
    ``min_length`` leaves the shortest out. Null and empty items are never found; equal items
    are found separately. Every document is read whole, once per block, without a shuffle.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, edits int, start int, end int"
    wanted = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / most_items), math.ceil((size["bytes"] or 0) / most_bytes))
    out = None
    for block in range(blocks):
        chosen = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct()
        items = sorted(
            {(r["item_id"], normal(r["text"])[0]) for r in chosen.collect() if len(normal(r["text"])[0]) >= min_length}
        )
        if items:
            found = map_batches(docs.select("doc_id", "text"), schema, _searcher(items, share, inside_words))
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _whole(item: bytes, text: bytes, begin: int, end: int) -> tuple[int, int, int] | None:
    """(0, start, end) of the first place of ``item`` from ``begin`` on that cuts no word at either side."""

    def cuts(at: int) -> bool:
        return 0 < at < len(text) and text[at - 1 : at + 1].isalnum()

    at = text.find(item, begin, end)
    while at >= 0 and (cuts(at) or cuts(at + len(item))):
        at = text.find(item, at + 1, end)
    return (0, at, at + len(item)) if at >= 0 else None


def _searcher(items: list[tuple[int, bytes]], share: float, inside_words: bool = True):
    def make():
        sizes = np.array([len(t) for _, t in items], np.int64)
        edits = np.array([int(share * n) for n in sizes.tolist()], np.int64)
        cuts = [cut(n, share) for n in sizes.tolist()]
        least = np.array([n for _, n in cuts], np.int64)
        groups = [
            Pieces(q, [(k, items[k][1]) for k, (piece, _) in enumerate(cuts) if piece == q])
            for q in sorted({piece for piece, _ in cuts})
        ]

        def run(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
            for (k, item), parts in sorted(candidates(texts, groups, sizes, edits, least).items()):
                best = None
                for begin, end in parts:
                    if edits[item] == 0 and not inside_words:
                        best = best or _whole(items[item][1], texts[k], begin, end)
                        continue
                    found = locate(items[item][1], texts[k][begin:end], int(edits[item]))
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], begin + found[1], begin + found[2])
                if best:
                    yield k, item, *best

        def each(batch: pa.RecordBatch):
            ids, rows = batch.column("doc_id").to_pylist(), []
            begin, texts, held = 0, [], 0
            for k, text in enumerate(batch.column("text").to_pylist(), 1):
                texts.append(normal(text)[0])
                held += len(texts[-1])
                if held >= RUN or k == batch.num_rows:
                    rows.extend((begin + at, *rest) for at, *rest in run(texts))
                    begin, texts, held = k, [], 0
            return {
                "doc_id": [ids[k] for k, *_ in rows],
                "item_id": [items[item][0] for _, item, *_ in rows],
                "edits": [e for _, _, e, _, _ in rows],
                "start": [s for _, _, _, s, _ in rows],
                "end": [e for *_, e in rows],
            }

        return each

    return make


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their ids; equal rows go together.

    Items with no edits to spare count only as whole words unless ``inside_words`` is set, so that a
    short one does not empty the corpus. Null and empty texts stay.
    """
    options.setdefault("inside_words", False)
    texts = docs.select(F.md5("text").alias("doc_id"), "text")
    found = staged(find_items(texts, benchmark, **options).select(F.col("doc_id").alias("found__")).distinct())
    return docs.join(found, F.md5("text") == F.col("found__"), "left_anti")
