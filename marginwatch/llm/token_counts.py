"""Edit-aware token counts.

Each document keeps its pre-tokens in leaves of a segment tree whose nodes hold sums of characters and
tokens. An edit is located by descending the character sums; only the pre-tokens it touches, and the
boundary context that can change with them, are cut and encoded anew, and the sums above the changed
leaves follow. Trees are kept as columns beside the text (:func:`build_trees`); :func:`update` opens
only the leaves that an edit reaches and returns the trees to keep next. What no edit touches is
encoded once, however often the corpus changes.
"""

from __future__ import annotations

import public_tokenizers
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from marginwatch.llm.bpe import encoding
from marginwatch.llm.common import map_batches, staged

LEAF = 128
# Characters beyond its end that decide where a pre-token stops.
CONTEXT = 4
EDIT = "array<struct<at:int,drop:int,put:string>>"
# A kept tree: pre-tokens, characters and tokens per leaf; characters and tokens per pre-token.
KEPT = ["leaves__", "lengths__", "tokens__"]
COUNTS = ["n_before", "n_after", "n_edits", "n_recut"]
# Rows of a batch that are held as trees at once.
ROWS = 500


def _narrow(numbers: np.ndarray) -> bytes:
    """Little-endian numbers of the least width that holds them all."""
    most = int(numbers.max(initial=0))
    return numbers.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // n if n else 1])


def keep(lengths: np.ndarray, tokens: np.ndarray, sizes: list[int]) -> tuple[bytes, bytes, bytes]:
    """The columns of ``KEPT``: leaves hold ``sizes`` pre-tokens each, none of them empty."""
    starts = np.cumsum([0, *sizes])[:-1]
    sums = [np.add.reduceat(x.astype(np.int64), starts) if sizes else np.zeros(0) for x in (lengths, tokens)]
    return np.stack([sizes, *sums]).astype("<u4").tobytes(), _narrow(lengths), _narrow(tokens)


class Counter:
    """Tokens per pre-token, with a memory of those met."""

    def __init__(self, ranks: bytes, pattern: str, most: int = 300_000):
        self.find = regex.compile(pattern).findall
        self.search = regex.compile(pattern).search
        self.one = encoding(ranks, pattern).encode_ordinary
        self.memo: dict[str, int] = {}
        self.most = most

    def counts(self, words: list[str]) -> list[int]:
        memo, out = self.memo, []
        for w in words:
            n = memo.get(w)
            if n is None:
                n = len(self.one(w))
                if len(memo) < self.most:
                    memo[w] = n
            out.append(n)
        return out


class Tree:
    """A document's pre-tokens under a segment tree of (characters, tokens) sums."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.recut = counter, 0
        words = counter.find(text)
        tokens = counter.counts(words)
        self._build([[words[i : i + LEAF], tokens[i : i + LEAF]] for i in range(0, len(words), LEAF)] or [[[], []]])

    @classmethod
    def load(cls, text: str, leaves: bytes, lengths: bytes, tokens: bytes, counter: Counter) -> Tree:
        """A kept tree, its leaves still closed: nothing is cut or encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.recut, tree.kept_text = counter, 0, text
        sizes, chars, sums = np.frombuffer(leaves, "<u4").reshape(3, -1).astype(np.int64)
        tree.begins, tree.starts = np.cumsum([0, *sizes]).tolist(), np.cumsum([0, *chars]).tolist()
        tree.kept = _wide(lengths, tree.begins[-1]), _wide(tokens, tree.begins[-1])
        tree.leaves = [None] * len(sizes) or [[[], []]]
        base = 1
        while base < len(tree.leaves):
            base *= 2
        tree.base = base
        nodes = np.zeros((2, 2 * base), np.int64)
        nodes[:, base : base + len(sizes)] = chars, sums
        while base > 1:
            nodes[:, base // 2 : base] = nodes[:, base : 2 * base : 2] + nodes[:, base + 1 : 2 * base : 2]
            base //= 2
        tree.chars, tree.tokens = nodes.tolist()
        return tree

    def _leaf(self, k: int) -> list[list]:
        """Words and tokens of a leaf, opened when first needed."""
        leaf = self.leaves[k]
        if leaf is None:
            low, high, at, words = self.begins[k], self.begins[k + 1], self.starts[k], []
            for n in self.kept[0][low:high].tolist():
                words.append(self.kept_text[at : at + n])
                at += n
            leaf = self.leaves[k] = [words, self.kept[1][low:high].tolist()]
        return leaf

    def pack(self) -> tuple[str, bytes, bytes, bytes]:
        """The text and the columns of ``KEPT``; closed leaves are copied as they are."""
        texts, lengths, tokens, sizes = [], [], [], []
        for k, leaf in enumerate(self.leaves):
            if leaf is None:
                low, high = self.begins[k], self.begins[k + 1]
                texts.append(self.kept_text[self.starts[k] : self.starts[k + 1]])
                lengths.append(self.kept[0][low:high])
                tokens.append(self.kept[1][low:high])
                sizes.append(high - low)
                continue
            texts += leaf[0]
            for begin in range(0, len(leaf[0]), LEAF):
                lengths.append(np.array([len(w) for w in leaf[0][begin : begin + LEAF]], np.int64))
                tokens.append(np.array(leaf[1][begin : begin + LEAF], np.int64))
                sizes.append(len(lengths[-1]))
        none = [np.zeros(0, np.int64)]
        return "".join(texts), *keep(np.concatenate(lengths or none), np.concatenate(tokens or none), sizes)

    def _build(self, leaves: list[list[list]]) -> None:
        self.leaves = leaves
        self.base = 1
        while self.base < len(leaves):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (words, tokens) in enumerate(leaves):
            self.chars[self.base + k] = sum(map(len, words))
            self.tokens[self.base + k] = sum(tokens)
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, where that starts) of the character ``at``, or of the last one."""
        node, begun = 1, 0
        while node < self.base:
            node *= 2
            if at - begun >= self.chars[node] and self.chars[node + 1]:
                begun += self.chars[node]
                node += 1
        words = self._leaf(node - self.base)[0]
        for k, w in enumerate(words):
            if at < begun + len(w) or k == len(words) - 1:
                return node - self.base, k, begun
            begun += len(w)
        return node - self.base, 0, begun

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replace ``drop`` characters at ``at`` by ``put``; both are cut to the text's length."""
        length = self.chars[1]
        at = max(0, min(at, length))
        drop = max(0, min(drop, length - at))
        leaf, k, begun = self._find(max(0, at - CONTEXT))
        while begun > max(0, at - CONTEXT) and (leaf or k):
            leaf, k, begun = self._find(begun - 1)
        # old pre-tokens from here on, read as far as needed
        first, here = (leaf, k), begun
        text, old_at, shift = "", begun, len(put) - drop
        fresh: list[str] = []
        done = begun
        reading = self._read(leaf, k)
        held: list[tuple[int, int, int]] = []
        raw = ""
        more = True
        while more and begun + len(raw) < at + drop + 64:
            more, raw, old_at = self._pull(reading, raw, held, old_at)
        while True:
            cut = at - here
            text = raw[:cut] + put + raw[cut + drop :]
            pos = done - here
            ends = {start for _, _, start in held if start >= at + drop}
            synced = None
            while pos < len(text):
                m = self.counter.search(text, pos)
                if more and m.end() + CONTEXT > len(text):
                    break
                fresh.append(m.group())
                pos = m.end()
                if here + pos - shift in ends and here + pos >= at + len(put):
                    synced = here + pos - shift
                    break
            done = here + pos
            if synced is not None or not more:
                break
            for _ in range(2 * LEAF):
                if more:
                    more, raw, old_at = self._pull(reading, raw, held, old_at)
        last = next(((i, j) for i, j, start in held if start == synced), None) if synced is not None else None
        self._splice(first, last, fresh)
        self.recut += len(fresh)

    def _read(self, leaf: int, k: int):
        for i in range(leaf, len(self.leaves)):
            words = self._leaf(i)[0]
            for j in range(k if i == leaf else 0, len(words)):
                yield i, j, words[j]

    def _pull(self, reading, raw: str, held: list, at: int) -> tuple[bool, str, int]:
        found = next(reading, None)
        if found is None:
            return False, raw, at
        i, j, w = found
        held.append((i, j, at))
        return True, raw + w, at + len(w)

    def _splice(self, first: tuple[int, int], last: tuple[int, int] | None, fresh: list[str]) -> None:
        """Replace the pre-tokens from ``first`` up to ``last`` (None: the end) by ``fresh``."""
        i, k = first
        end, j = last if last is not None else (len(self.leaves) - 1, len(self._leaf(len(self.leaves) - 1)[0]))
        words, tokens = self._leaf(i)
        tail = (self._leaf(end)[0][j:], self._leaf(end)[1][j:])
        self.leaves[i] = [words[:k] + fresh, tokens[:k] + self.counter.counts(fresh)]
        if end == i:
            self.leaves[i] = [self.leaves[i][0] + tail[0], self.leaves[i][1] + tail[1]]
        else:
            for x in range(i + 1, end):
                self.leaves[x] = [[], []]
            self.leaves[end] = [list(tail[0]), list(tail[1])]
        if len(self.leaves[i][0]) > 8 * LEAF:
            flat = [(w, t) for x in range(len(self.leaves)) for w, t in zip(*self._leaf(x), strict=True)]
            parts = [flat[x : x + LEAF] for x in range(0, len(flat), LEAF)]
            self._build([[[w for w, _ in p], [t for _, t in p]] for p in parts])
            return
        for x in range(i, end + 1):
            node = self.base + x
            self.chars[node], self.tokens[node] = sum(map(len, self.leaves[x][0])), sum(self.leaves[x][1])
            while node > 1:
                node //= 2
                self._sum(node)

    def text(self) -> str:
        return "".join(w for k in range(len(self.leaves)) for w in self._leaf(k)[0])


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the column edits: those of ``edits`` (doc_id, seq, at, drop, put) in order of seq.

    A column of that name is replaced. Rows that share an id get the same edits; a null id names no row,
    so rows without an id have none and edits without one apply to nothing.
    """
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "at", "drop", "put"))),
        lambda e: F.struct(e["at"].cast("int").alias("at"), e["drop"].cast("int").alias("drop"), e["put"].alias("put")),
    )
    return docs.drop("edits").join(edits.groupBy("doc_id").agg(listed.alias("edits")), "doc_id", "left")


def derived_edits() -> Column:
    """Three edits per text, drawn from hashes of id and text: an insertion, a deletion, and a
    replacement that repeats the text's first word elsewhere."""

    def draw(salt: str, below: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.greatest(below, F.lit(1)).cast("long")).cast("int")

    size = F.length("text")
    word = F.substring(F.substring_index("text", " ", 1), 1, 40)
    edit = [
        F.struct(draw("a", size).alias("at"), F.lit(0).alias("drop"), F.concat(F.lit(" "), word).alias("put")),
        F.struct(draw("b", size).alias("at"), draw("c", F.lit(24)).alias("drop"), F.lit("").alias("put")),
        F.struct(draw("d", size).alias("at"), draw("e", F.lit(9)).alias("drop"), word.alias("put")),
    ]
    return F.array(*edit)


def build_trees(docs: DataFrame, ranks: bytes, *, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with the columns of ``KEPT``, the tree of every text. To be written; one pass, no shuffle.

    Column names ending in two underscores are reserved. A null text has the tree of an empty one.
    """
    kind = StructType([f for f in docs.schema if f.name not in KEPT] + [StructField(c, BinaryType()) for c in KEPT])

    def make():
        counter = Counter(ranks, pattern)

        def each(batch: pa.RecordBatch):
            for begin in range(0, batch.num_rows, ROWS):
                part, kept = batch.slice(begin, ROWS), []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words = counter.find(text or "")
                    sizes = [min(LEAF, len(words) - i) for i in range(0, len(words), LEAF)]
                    lengths = np.fromiter(map(len, words), np.int64, len(words))
                    kept.append(keep(lengths, np.array(counter.counts(words), np.int64), sizes))
                yield {name: part.column(i) for i, name in enumerate(part.schema.names)} | {
                    name: [row[k] for row in kept] for k, name in enumerate(KEPT)
                }

        return each

    return map_batches(docs.drop(*KEPT), kind, make)


def update(trees: DataFrame, ranks: bytes, *, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Kept trees after their ``edits``, an array of (at, drop, put) applied one after the other.

    The result has the columns of ``trees`` but edits, with text and tree as they are now, and
    n_before, n_after, n_edits, n_recut, which replace columns of these names. Positions beyond the text
    mean its end; null edits mean none and leave the row as it is. ``n_recut`` counts the pre-tokens
    encoded anew. One pass without a shuffle; memory is bounded by the longest text.
    """
    fields = [f for f in trees.schema if f.name not in ("edits", *COUNTS)]
    counts = [StructField(c, IntegerType() if c == "n_edits" else LongType()) for c in COUNTS]

    def make():
        counter = Counter(ranks, pattern)

        def each(batch: pa.RecordBatch):
            names = batch.schema.names
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                columns = {name: part.column(i) for i, name in enumerate(names)}
                texts, *kept = [columns[c].to_pylist() for c in ("text", *KEPT)]
                found = {c: [] for c in COUNTS}
                for k, edits in enumerate(columns.pop("edits").to_pylist()):
                    edits = [e for e in edits or [] if e is not None and e["at"] is not None]
                    tree = Tree.load(texts[k] or "", *(c[k] for c in kept), counter)
                    found["n_before"].append(tree.total)
                    for e in edits:
                        tree.edit(e["at"], e["drop"] or 0, e["put"] or "")
                    if edits:
                        texts[k], kept[0][k], kept[1][k], kept[2][k] = tree.pack()
                    found["n_after"].append(tree.total)
                    found["n_edits"].append(len(edits))
                    found["n_recut"].append(tree.recut)
                yield columns | found | {"text": texts} | dict(zip(KEPT, kept, strict=True))

        return each

    given = trees.drop(*COUNTS).withColumn("edits", F.col("edits").cast(EDIT))
    return map_batches(given, StructType(fields + counts), make)


def count_tokens(docs: DataFrame, ranks: bytes, *, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_before, n_after, n_edits, n_recut: one row per row of ``docs``.

    ``docs`` has doc_id, text and edits. Trees are written to the shared folder first; the counts come
    from :func:`update` of what was written.
    """
    trees = staged(build_trees(docs.select("doc_id", "text", "edits"), ranks, pattern=pattern))
    return update(trees, ranks, pattern=pattern).select("doc_id", *COUNTS)
