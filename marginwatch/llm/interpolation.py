"""Language-model scores by deleted interpolation of one-, two- and three-token counts.

The probability of a token is a mixture, from the longest context down:

    p3 = l3 * c(u v w) / c(u v) + (1 - l3) * p2        where c(u v) > 0, else p2
    p2 = l2 * c(v w) / c(v) + (1 - l2) * p1            where c(v) > 0, else p1
    p1 = l1 * c(w) / N + (1 - l1) / (V + 1)

``l2`` and ``l3`` depend on the bucket of the context's count, its power of two. All weights are learnt by
expectation-maximisation: a sixteenth of the training documents is *deleted*, that is, taken out of
the counts by subtraction, and the weights are those under which its tokens are likeliest. The scores
then use all training counts.

Nothing is gathered from the corpus on the driver but totals and a few dozen weights. Shards of
documents hold their tokens as numbers. Their words are summed by word, which numbers them for the
whole corpus; their two- and three-token grams travel as tries, cut by ranges of the prefix, are summed
by range, and every shard gets the counts of its own grams back in the order it sent them. A shard asks
for each gram once however often it occurs in it, so a common word or passage is no hot key.

Documents are lower-cased in A-Z and split at blanks and control blanks (9 to 13); each ends with one end
token, which is also the context of its first word. Null and empty texts are the end token alone. A
null doc_id is not held out and trains. Repeated rows count and are scored each for itself. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from marginwatch.llm.common import staged
from marginwatch.llm.token_shards import (
    Grams,
    Tokens,
    byte_set,
    contents,
    entries,
    in_hash_order,
    map_shards,
    packed,
    pairs,
    parts_for,
    united_words,
    unpacked,
    unpacked_all,
    word_blocks,
)

INSIDE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
# No word holds a blank.
END = b" "
# Three numbers a token are at work at a time in a task, and their sorted copies.
SHARD_BYTES = 8 << 20
BUCKETS = 48
ROUNDS = 15
HELD_OUT, TRAINS, DELETED = 0, 1, 2

SHARD = """shard long, deleted boolean, ids array<long>, kinds array<tinyint>, sizes array<int>, words binary,
    lengths binary, sums binary, n_words long, code binary, n_tokens long"""
NUMBERS = "shard long, part int, numbers binary, sums binary, train_tokens long, train_words long"


def _sums(code: np.ndarray, kind: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` numbers occurs in training, and how often in its deleted part."""
    return np.stack([np.bincount(code[kind >= TRAINS], minlength=n), np.bincount(code[kind == DELETED], minlength=n)])


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """By shard, the deleted documents apart from the others: tokens as numbers of the shard's words."""

    def each(shard: int, batch: pa.RecordBatch) -> Iterator[dict]:
        kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy(zero_copy_only=False)
        for deleted in (False, True):
            rows = np.flatnonzero((kinds == DELETED) == deleted)
            if len(rows):
                yield from one(2 * shard + deleted, deleted, batch.take(pa.array(rows)), kinds[rows])

    def one(shard: int, deleted: bool, batch: pa.RecordBatch, kinds: np.ndarray) -> Iterator[dict]:
        tokens = Tokens(batch.column(batch.schema.get_field_index("text")), INSIDE)
        sizes = tokens.size + 1
        words = pa.concat_arrays([tokens.words.cast(pa.binary()), pa.array([END], pa.binary())])
        code = np.full(int(sizes.sum()), len(words) - 1)
        inner = np.ones(len(code), bool)
        inner[np.cumsum(sizes) - 1] = False
        code[inner] = tokens.code
        words, code = in_hash_order(words, code)
        raw, lengths = contents(words)
        yield {
            "shard": [shard],
            "deleted": [deleted],
            "ids": [batch.column(batch.schema.get_field_index("doc_id")).to_pylist()],
            "kinds": [kinds],
            "sizes": [sizes],
            "words": [raw],
            "lengths": [packed(lengths)],
            "sums": [packed(_sums(code, np.repeat(kinds, sizes), len(words)).ravel())],
            "n_words": [len(words)],
            "code": [packed(code)],
            "n_tokens": [len(code)],
        }

    crc = F.crc32(F.col("doc_id").cast("string"))
    kind = F.when(crc % 7 == 2, HELD_OUT).when(F.floor(crc / 7) % 16 == 0, DELETED).otherwise(TRAINS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kind.cast("tinyint").alias("kind"))
    return staged(map_shards(rows, SHARD, each, shard_bytes))


def _numbered(shards: DataFrame, parts: int) -> DataFrame:
    """For each shard and part the numbers (from 1) and the training counts of its words; and for each part, in
    a row without a shard, its training tokens and distinct training words."""

    def run(table: pa.Table) -> pa.Table:
        words, totals, codes = united_words(table, 2)
        part, k = table["part"][0].as_py(), len(codes)
        number = np.arange(len(words)) * parts + part + 1
        return pa.table(
            {
                "shard": [None, *table["shard"].to_pylist()],
                "part": pa.array([part] * (k + 1), pa.int32()),
                "numbers": pa.array([None, *[packed(number[c]) for c in codes]], pa.binary()),
                "sums": pa.array([None, *[packed(totals[:, c].ravel()) for c in codes]], pa.binary()),
                "train_tokens": pa.array([int(totals[0].sum()), *[None] * k], pa.int64()),
                "train_words": pa.array([int((totals[0] > 0).sum()), *[None] * k], pa.int64()),
            }
        )

    return staged(word_blocks(shards, parts, 2).groupBy("part").applyInArrow(run, NUMBERS))


class _Shard:
    """A shard's tokens and its grams; every document's first token has the end token as context."""

    def __init__(self, row: dict, words: pa.Table):
        """Of a row of the shard and the blocks of its words' numbers and counts."""
        words = words.sort_by("part")
        self.number = np.concatenate([unpacked(x) for x in words["numbers"].to_pylist()])
        self.sums = np.concatenate([unpacked(x).reshape(2, -1) for x in words["sums"].to_pylist()], axis=1)
        self.code = unpacked(row["code"])
        sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.kind = np.repeat(np.array(row["kinds"], np.int64), sizes)
        self.end = int(self.code[-1])
        before = np.roll(self.code, 1)
        before[self.starts] = self.end
        second = np.ones(len(self.code), bool)
        second[self.starts] = False
        # an occurrence of two tokens at every token; of three at every token but the first ones
        followed = np.flatnonzero(second) - 1
        self.before, self.third = before, followed + 1
        # deleted documents have shards of their own, so one weight is enough here
        trains = (self.kind >= TRAINS).astype(np.int64)[None]
        self.grams, self.state2, self.state3 = Grams.counted(
            self.number[before], self.number[self.code], followed, self.number[self.code[self.third]], trains, trains[:, self.third]
        )
        self.followed = followed

    def counts(self, c2: np.ndarray, c3: np.ndarray, less_deleted: bool) -> tuple[np.ndarray, ...]:
        """For every token the counts c(w), c(v), c(v w), c(u v), c(u v w)."""

        def of(two_rows: np.ndarray) -> np.ndarray:
            return two_rows[0] - two_rows[1] if less_deleted else two_rows[0]

        one, two, three = of(self.sums), of(c2)[self.state2], of(c3)[self.state3]
        context3, gram3 = np.zeros(len(self.code), np.int64), np.zeros(len(self.code), np.int64)
        context3[self.third], gram3[self.third] = two[self.followed], three
        return one[self.code], one[self.before], two, context3, gram3


def _asked(shards: DataFrame, words: DataFrame, ranges: int) -> DataFrame:
    """(range, shard, deleted, trie): the grams of every shard, with their training counts."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        grams = _Shard(row, found).grams
        cut = [(k, grams.taken(*places)) for k, places in enumerate(grams.split(ranges)) if len(places[0])]
        return pa.table(
            {
                "range": pa.array([k for k, _ in cut], pa.int32()),
                "shard": pa.array([row["shard"]] * len(cut), pa.int64()),
                "deleted": pa.array([row["deleted"]] * len(cut), pa.bool_()),
                "trie": pa.array([t.to_bytes() for _, t in cut], pa.binary()),
            }
        )

    kind = "range int, shard long, deleted boolean, trie binary"
    return shards.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(run, kind)


def _counted(asked: DataFrame) -> DataFrame:
    """(range, shard, sums): the corpus counts of the grams that a shard sent to a range, in its order."""

    def run(table: pa.Table) -> pa.Table:
        tries = [Grams.of_bytes(t) for t in table["trie"].to_pylist()]
        for trie, gone in zip(tries, table["deleted"].to_pylist()):
            trie.w2, trie.w3 = (np.concatenate([w, w if gone else np.zeros_like(w)]) for w in (trie.w2, trie.w3))
        whole, states = Grams.united(tries)
        return pa.table(
            {
                "range": table["range"],
                "shard": table["shard"],
                "sums": pa.array(
                    [packed(*whole.w2[:, two], *whole.w3[:, three]) for two, three in states],
                    pa.binary(),
                ),
            }
        )

    return staged(asked.groupBy("range").applyInArrow(run, "range int, shard long, sums binary"))


def _with_counts(shards: DataFrame, words: DataFrame, counted: DataFrame, ranges: int, each: Callable, kind: str) -> DataFrame:
    """``each`` applied to every shard's row, tokens, and the counts of its grams of two and three tokens."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        of_words = pc.is_valid(found["numbers"])
        shard = _Shard(row, found.filter(of_words))
        c2 = np.zeros((2, len(shard.grams.a)), np.int64)
        c3 = np.zeros((2, len(shard.grams.c)), np.int64)
        of_grams = found.filter(pc.invert(of_words))
        got = dict(zip(of_grams["part"].to_pylist(), of_grams["sums"].to_pylist()))
        for k, (two, three) in enumerate(shard.grams.split(ranges)):
            if len(two):
                sums = unpacked_all(got[k])
                c2[:, two], c3[:, three] = sums[:2], sums[2:]
        return each(row, shard, c2, c3)

    grams = counted.select("shard", F.col("range").alias("part"), F.lit(None).cast("binary").alias("numbers"), "sums")
    blocks = words.unionByName(grams)
    return shards.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(run, kind)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(count, 1))[1] - 1, BUCKETS - 1)


def _probability(counts, tokens: int, words: int, l1: float, l2: np.ndarray, l3: np.ndarray) -> np.ndarray:
    one, context2, two, context3, three = counts
    l1 = l1 if tokens else 0.0
    p = l1 * one / max(tokens, 1) + (1 - l1) / (words + 1)
    for context, gram, weights in ((context2, two, l2), (context3, three, l3)):
        weight = np.where(context > 0, weights[_bucket(context)], 0.0)
        p = weight * gram / np.maximum(context, 1) + (1 - weight) * p
    return p


def _deleted_counts(shards: DataFrame, words: DataFrame, counted: DataFrame, ranges: int) -> DataFrame:
    """(one, context2, two, context3, three, n): how many deleted tokens have these counts without the deleted part."""

    def each(row: dict, shard: _Shard, c2: np.ndarray, c3: np.ndarray) -> pa.Table:
        counts = shard.counts(c2, c3, less_deleted=True)
        rank = np.zeros(len(shard.code), np.int64)
        for column in counts:
            first, rank = pairs(rank, column)
        return pa.table(dict(zip((*COUNTS, "n"), (*[c[first] for c in counts], np.bincount(rank)))))

    kind = ", ".join(f"{name} long" for name in (*COUNTS, "n"))
    # shards of deleted documents have odd numbers
    tables = [t.where("shard % 2 = 1") for t in (shards, words, counted)]
    rows = _with_counts(*tables, ranges, each, kind)
    return staged(rows.groupBy(*COUNTS).agg(F.sum("n").alias("n")))


COUNTS = ("one", "context2", "two", "context3", "three")


def fit_weights(counts: DataFrame, tokens: int, words: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """The mixture weights l1, l2 and l3 (by bucket) that expectation-maximisation reaches in ``rounds`` rounds.

    ``counts`` holds the counts of held-out tokens without the held-out part, and how many tokens have
    them. A round is one aggregation over it; a row per order and bucket comes back. A token more for
    either side of each weight keeps it between 0 and 1; buckets without held-out tokens keep a half.
    """
    weights = {1: np.full(1, 0.5), 2: np.full(BUCKETS, 0.5), 3: np.full(BUCKETS, 0.5)}
    for k in (2, 3):
        counts = counts.withColumn(f"b{k}", F.least(F.floor(F.log2(F.col(f"context{k}") + F.lit(0.5))).cast("int"), F.lit(BUCKETS - 1)))
    for _ in range(rounds):

        def weight(k: int):
            table = F.array(*[F.lit(float(x)) for x in weights[k]])
            return F.when(F.col(f"context{k}") > 0, F.get(table, F.col(f"b{k}"))).otherwise(F.lit(0.0))

        own1 = F.lit(float(weights[1][0])) * F.col("one") / F.lit(float(max(tokens, 1)))
        rows = counts.select(
            "n",
            "b2",
            "b3",
            "context2",
            "context3",
            own1.alias("own1"),
            (own1 + F.lit((1 - float(weights[1][0])) / (words + 1))).alias("p1"),
            weight(2).alias("l2"),
            F.coalesce(F.try_divide("two", "context2"), F.lit(0.0)).alias("f2"),
            weight(3).alias("l3"),
            F.coalesce(F.try_divide("three", "context3"), F.lit(0.0)).alias("f3"),
        )
        rows = rows.withColumn("p2", F.expr("l2 * f2 + (1 - l2) * p1"))
        rows = rows.withColumn("p3", F.expr("l3 * f3 + (1 - l3) * p2"))
        # the share of a token that order 3 explains, that is left to order 2, and so on
        rows = rows.withColumn("n3", F.expr("n * l3 * f3 / p3"))
        rows = rows.withColumn("left2", F.expr("n - n3"))
        rows = rows.withColumn("n2", F.expr("left2 * l2 * f2 / p2"))
        rows = rows.withColumn("left1", F.expr("left2 - n2"))
        shares = F.array(
            *[
                F.struct(F.lit(k).alias("k"), b.alias("b"), F.expr(own).alias("own"), F.expr(everything).alias("all"))
                for k, b, own, everything in (
                    (3, F.when(F.col("context3") > 0, F.col("b3")), "n3", "DOUBLE(n)"),
                    (2, F.when(F.col("context2") > 0, F.col("b2")), "n2", "left2"),
                    (1, F.lit(0), "left1 * own1 / p1", "left1"),
                )
            ]
        )
        found = rows.select(F.inline(shares)).where("b IS NOT NULL").groupBy("k", "b").agg(F.sum("own"), F.sum("all"))
        for k, b, own, everything in found.collect():
            weights[k][b] = (own + 1) / (everything + 2)
    return float(weights[1][0]), weights[2], weights[3]


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    ``base_score`` is that of add-one unigrams, ``score`` that of the mixture. Documents whose crc32 of
    doc_id leaves 2 modulo 7 are held out and teach nothing.
    """
    shards = _shards(docs, shard_bytes)
    word_parts, ranges = parts_for(entries(shards, "n_words")), parts_for(2 * entries(shards, "n_tokens"))
    numbers = _numbered(shards, word_parts)
    tokens, words = numbers.agg(
        F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_words"), F.lit(0))
    ).first()
    shards = shards.drop("words", "lengths", "sums", "n_words", "n_tokens")
    numbers = numbers.where("shard IS NOT NULL").select("shard", "part", "numbers", "sums")
    counted = _counted(_asked(shards, numbers, ranges))
    deleted = _deleted_counts(shards, numbers, counted, ranges)
    rest = tokens - (deleted.agg(F.sum("n")).first()[0] or 0)
    weights = fit_weights(deleted, rest, words, rounds)

    def each(row: dict, shard: _Shard, c2: np.ndarray, c3: np.ndarray) -> pa.Table:
        counts = shard.counts(c2, c3, less_deleted=False)
        base = np.log10((counts[0] + 1) / (tokens + words + 1))
        score = np.log10(_probability(counts, tokens, words, *weights))
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": np.array(row["kinds"]) == HELD_OUT,
                "n_tokens": pa.array(row["sizes"], pa.int64()),
                "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), shard.starts),
                "train_tokens": np.full(len(row["ids"]), tokens),
                "base_score": np.add.reduceat(base, shard.starts),
                "score": np.add.reduceat(score, shard.starts),
            }
        )

    kind = """doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double,
        score double"""
    return _with_counts(shards, numbers, counted, ranges, each, kind)
