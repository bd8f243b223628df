"""Phrase collocation mining with weighted acyclic automata.

Words are numbered per language over the whole corpus; only those that occur ``least`` times can be
part of a phrase, since a phrase occurs no more often than its words. Every shard of documents sorts the
windows of up to three such words inside its pieces and builds a trie of them, an acyclic automaton in
which a state's weight is the number of windows that pass it. Tries are cut by ranges of the scrambled
prefix (first two words), so that no frequent first word makes a range heavy; the tries of a range are
united and weights of equal paths summed. What is left of a range, states of weight ``least`` and more,
answers part lookups: the sorted parts of candidate phrases form an acceptor, which is composed with
the range's trie and gets the weights.

Text is lower-cased in A-Z, cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at
blanks and tabs. Null text is empty; null languages count as ``und``. Repeated rows count each time.
Empty texts add nothing, an empty table gives no rows. Other columns are not read. Counts are exact
below 1e16 (scores are computed in 38-digit decimals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from marginwatch.llm.common import staged
from marginwatch.llm.token_shards import (
    SHARD_BYTES,
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
    range_of,
    united_words,
    unpacked,
    word_blocks,
)

BREAKS = byte_set((0x0A, 0x0D), *[(b, b) for b in b".,;:!?"])
RANKING_SLICES = 64
INSIDE = ~BREAKS & ~byte_set((0x20, 0x20), (0x09, 0x09))
SHARD = """shard long, words binary, lengths binary, sums binary, n_words long, code binary, go_on binary,
    n_tokens long, langs array<string>, lang_tokens array<long>"""
VOCABULARY = "shard long, part int, numbers binary, id long, lang string, word string, f long"


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """By shard: its words (language, tab, word) with their counts, and its tokens as numbers of these.

    ``go_on`` has a bit for every token, set if the token before is in the same piece.
    """

    def each(shard: int, batch: pa.RecordBatch) -> Iterator[dict]:
        tokens = Tokens(batch.column(batch.schema.get_field_index("text")), INSIDE, BREAKS)
        if not len(tokens.code):
            return
        lang = pc.fill_null(batch.column(batch.schema.get_field_index("lang")), "und").dictionary_encode()
        of_doc = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of_token = of_doc[tokens.doc]
        first, code = pairs(of_token, tokens.code)
        words = pc.binary_join_element_wise(
            lang.dictionary.cast(pa.binary()).take(pa.array(of_token[first])),
            tokens.words.take(pa.array(tokens.code[first])),
            pa.scalar(b"\t", pa.binary()),
        )
        words, code = in_hash_order(words, code)
        raw, lengths = contents(words)
        go_on = np.zeros(len(code), bool)
        go_on[1:] = tokens.piece[1:] == tokens.piece[:-1]
        yield {
            "shard": [shard],
            "words": [raw],
            "lengths": [packed(lengths)],
            "sums": [packed(np.bincount(code))],
            "n_words": [len(first)],
            "code": [packed(code)],
            "go_on": [np.packbits(go_on).tobytes()],
            "n_tokens": [len(code)],
            "langs": [lang.dictionary.to_pylist()],
            "lang_tokens": [np.bincount(of_token, minlength=len(lang.dictionary))],
        }

    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return staged(map_shards(rows, SHARD, each, shard_bytes))


def _vocabulary(shards: DataFrame, parts: int, least: int) -> DataFrame:
    """Rows of two kinds: without a shard, a word that occurs ``least`` times or more, with its number from
    1 and its count; and for each shard and part the numbers of its words, 0 for the rarer ones."""

    def run(table: pa.Table) -> pa.Table:
        words, totals, codes = united_words(table, 1)
        part, count = table["part"][0].as_py(), totals[0]
        often = np.flatnonzero(count >= least)
        number = np.zeros(len(words), np.int64)
        number[often] = np.arange(len(often)) * parts + part + 1
        named = [w.rpartition(b"\t") for w in words.take(pa.array(often)).to_pylist()]
        n, k = len(often), len(codes)
        return pa.table(
            {
                "shard": [None] * n + table["shard"].to_pylist(),
                "part": pa.array([part] * (n + k), pa.int32()),
                "numbers": [None] * n + [packed(number[c]) for c in codes],
                "id": pa.array([*number[often].tolist(), *[None] * k], pa.int64()),
                "lang": pa.array([lang.decode() for lang, _, _ in named] + [None] * k, pa.string()),
                "word": pa.array([word.decode() for _, _, word in named] + [None] * k, pa.string()),
                "f": pa.array([*count[often].tolist(), *[None] * k], pa.int64()),
            }
        )

    return staged(word_blocks(shards, parts, 1).groupBy("part").applyInArrow(run, VOCABULARY))


def _tries(shards: DataFrame, numbers: DataFrame, ranges: int) -> DataFrame:
    """(range, trie): each shard's automaton, cut by prefix ranges."""

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        found = found.sort_by("part")["numbers"].to_pylist()
        number = np.concatenate([unpacked(x) for x in found])
        token = number[unpacked(row["code"])]
        go_on = np.unpackbits(np.frombuffer(row["go_on"], np.uint8), count=len(token)).astype(bool)
        followed = np.zeros(len(token) + 1, bool)
        followed[: len(token) - 1] = go_on[1:] & (token[:-1] > 0) & (token[1:] > 0)
        at = np.flatnonzero(followed)
        two = np.flatnonzero(followed[at + 1])
        one = np.ones((1, len(at)))
        trie, _, _ = Grams.counted(token[at], token[at + 1], two, token[at[two] + 2], one, one[:, : len(two)])
        cut = [(k, trie.taken(*places)) for k, places in enumerate(trie.split(ranges)) if len(places[0])]
        return pa.table(
            {
                "range": pa.array([k for k, _ in cut], pa.int32()),
                "trie": pa.array([t.to_bytes() for _, t in cut], pa.binary()),
            }
        )

    needed = shards.select("shard", "code", "go_on")
    sent = numbers.where("shard IS NOT NULL").select("shard", "part", "numbers")
    return needed.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(run, "range int, trie binary")


def _united(tries: DataFrame, least: int) -> DataFrame:
    """(range, trie): the union of each range's tries, without states of a weight below ``least``."""

    def run(table: pa.Table) -> pa.Table:
        whole, _ = Grams.united([Grams.of_bytes(t) for t in table["trie"].to_pylist()])
        two, three = np.flatnonzero(whole.w2[0] >= least), np.flatnonzero(whole.w3[0] >= least)
        whole.children = np.bincount(whole.parents()[three], minlength=len(whole.a))
        return pa.table({"range": table["range"].slice(0, 1), "trie": [whole.taken(two, three).to_bytes()]})

    return staged(tries.groupBy("range").applyInArrow(run, "range int, trie binary"))


def _phrases(united: DataFrame, ranges: int) -> DataFrame:
    """(x, y, z, xy, a, range): phrases of two words (z null) and three, the count of the first two words,
    the phrase's count, and the range in which the last two words of three are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                t = Grams.of_bytes(raw)
                up, n = t.parents(), len(t.a)
                yield pa.RecordBatch.from_pydict(
                    {
                        "x": np.concatenate([t.a, t.a[up]]),
                        "y": np.concatenate([t.b, t.b[up]]),
                        "z": pa.array([*[None] * n, *t.c.tolist()], pa.int64()),
                        "xy": np.concatenate([t.w2[0], t.w2[0][up]]),
                        "a": np.concatenate([t.w2[0], t.w3[0]]),
                        "range": pa.array(
                            [*[None] * n, *range_of(t.b[up], t.c, ranges).tolist()], pa.int32()
                        ),
                    }
                )

    kind = "x long, y long, z long, xy long, a long, range int"
    return staged(united.select("trie").mapInArrow(run, kind))


def _with_rest(phrases: DataFrame, united: DataFrame) -> DataFrame:
    """Phrases of three words with ``yz``, the count of the last two: the acceptor of these parts composed
    with the trie of their range."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        trie = Grams.of_bytes(found["trie"][0].as_py()) if len(found) else None
        y, z = (asked[name].to_numpy() for name in "yz")
        yz = trie.weights(y, z) if trie else np.zeros(len(y), np.int64)
        return asked.select(["x", "y", "z", "xy", "a"]).append_column("yz", pa.array(yz))

    three = phrases.where("z IS NOT NULL")
    kind = "x long, y long, z long, xy long, a long, yz long"
    return three.groupBy("range").cogroup(united.groupBy("range")).applyInArrow(run, kind)


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exact: products may pass 64 bits, the quotient may not."""
    big = "CAST({} AS DECIMAL(18,0))".format
    return F.expr(f"(CAST({big(a)} * {big(a)} AS DECIMAL(32,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV ({big(left)} * {big(right)})")


def collocations(
    docs: DataFrame,
    least: int = 10,
    top: int = 2000,
    inside_pct: int = 50,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    A phrase occurs ``a`` >= ``least`` times. Cut after its first word or words it has parts that occur
    ``l`` and ``r`` times; the cut of the lowest score counts, the first of equal ones. Phrases inside a
    longer one that occurs at least ``inside_pct`` % as often are dropped.
    """
    shards = _shards(docs, shard_bytes)
    ranges = parts_for(2 * entries(shards, "n_tokens"))
    vocabulary = _vocabulary(shards, parts_for(entries(shards, "n_words")), least)
    united = _united(_tries(shards, vocabulary, ranges), least)
    phrases = _phrases(united, ranges)
    three = staged(_with_rest(phrases, united))

    longer = (
        three.select(F.inline(F.array(F.struct("x", "y", "a"), F.struct(F.col("y").alias("x"), F.col("z").alias("y"), "a"))))
        .groupBy("x", "y")
        .agg(F.max("a").alias("most"))
    )
    two = (
        phrases.where("z IS NULL")
        .join(longer, ["x", "y"], "left")
        .where(100 * F.coalesce("most", F.lit(0)) < inside_pct * F.col("a"))
    )
    rows = two.select("x", "y", "z", "xy", "a", F.lit(None).cast("long").alias("yz")).unionByName(three)
    named = vocabulary.where("id IS NOT NULL")

    def word(k: str, *more: str) -> DataFrame:
        return named.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"), F.col("f").alias(f"f_{k}"), *more)

    rows = rows.join(word("x", "lang"), "x").join(word("y"), "y").join(word("z"), "z", "left")
    rows = rows.withColumns(
        {
            "after_one": F.when(F.col("z").isNull(), _score("a", "f_x", "f_y")).otherwise(_score("a", "f_x", "yz")),
            "after_two": F.when(F.col("z").isNotNull(), _score("a", "xy", "f_z")),
        }
    )
    second = F.coalesce(F.col("after_two") < F.col("after_one"), F.lit(False))
    rows = rows.select(
        "lang",
        F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"),
        "a",
        F.when(second, F.col("xy")).otherwise(F.col("f_x")).alias("l"),
        F.when(second, F.col("f_z")).otherwise(F.coalesce("yz", "f_y")).alias("r"),
        F.when(second, F.col("after_two")).otherwise(F.col("after_one")).alias("score"),
    )
    # First within slices of a language, so that no task ranks all phrases of a common one.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKING_SLICES))).orderBy(*order)
    best = rows.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("rank") <= top)
    sizes = (
        shards.select(F.inline(F.arrays_zip(F.col("langs").alias("lang"), F.col("lang_tokens").alias("n"))))
        .groupBy("lang")
        .agg(F.sum("n").alias("n"))
    )
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
