"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

:func:`build_index` cuts the documents into shards. A shard numbers its documents by ascending id and
holds, for every term, a list of postings: blocks of ``BLOCK`` documents, gaps and frequencies packed,
and beside them a head with the block's last document, its largest frequency and its shortest document.
Heads bound a block's best score without unpacking it, whatever the corpus statistics turn out to be.

:func:`search` sums documents, tokens and document frequencies over all shards, weighs the terms, and
lets every shard answer every item. Lists are ordered by their bounds. Those whose bounds together
cannot lift a document over the threshold, the tenth best score so far, are non-essential: candidates
come from the others only, and a candidate is looked up in a non-essential list only while its score so
far, the bound of the block it would be in, and the bounds of the lists left can still beat the
threshold; other blocks stay packed. The shards' heaps are merged per item.

Scores are exact integers. Equal scores rank by ascending id, null ids last. Null and empty texts have no
terms: they count nowhere and are never found. Items without terms, and items of which no term scores,
have no rows; repeated items and repeated documents are ranked each for itself. An empty corpus or item
table gives an empty result. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from marginwatch.llm.common import staged
from marginwatch.llm.token_shards import Tokens, byte_set, map_shards, pack, unpack

# Letters, digits and everything beyond ASCII.
INSIDE = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BLOCK = 128
# Documents examined between two looks at the threshold: few at first, so that it rises early.
FIRST_SPAN, SPAN = 256, 2048
SHARD_BYTES = 16 << 20
# Items are answered in blocks of about so many terms; that bounds what is sent to the shards.
ITEM_TERMS = 200_000
INDEX = "shard long, term string, df int, heads binary, body binary, ids array<long>, sizes array<int>"


def _postings(shard: int, batch: pa.RecordBatch) -> Iterator[dict]:
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    order = pc.sort_indices(ids, null_placement="at_end")
    ids = ids.take(order)
    tokens = Tokens(batch.column(batch.schema.get_field_index("text")).take(order), INSIDE)
    docs = len(ids)
    none = [None]
    yield {"shard": [shard], "term": none, "df": none, "heads": none, "body": none, "ids": [ids.to_pylist()], "sizes": [tokens.size]}
    if not len(tokens.code):
        return
    by_term = pc.sort_indices(tokens.words).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    key, tf = np.unique(rank[tokens.code] * docs + tokens.doc, return_counts=True)
    term, doc = key // docs, key % docs
    new = np.ones(len(key), bool)
    new[1:] = term[1:] != term[:-1]
    lists = np.flatnonzero(new)
    df = np.diff(np.append(lists, len(key)))
    place = np.arange(len(key)) - np.repeat(lists, df)
    gap = doc - np.where(new, -1, np.roll(doc, 1))
    body, ends = pack(np.stack([gap, tf], 1).ravel())
    ends = ends[1::2]
    begins = np.concatenate([[0], ends[np.append(lists[1:], len(key)) - 1]])
    blocks = np.flatnonzero(place % BLOCK == 0)
    lasts = np.append(blocks[1:], len(key)) - 1
    heads = np.stack(
        [
            doc[lasts],
            np.maximum.reduceat(tf, blocks),
            np.minimum.reduceat(tokens.size[doc], blocks),
            ends[lasts] - np.repeat(begins[:-1], -(-df // BLOCK)),
        ],
        axis=1,
    ).astype("<i4")
    head_ends = np.concatenate([[0], np.cumsum(-(-df // BLOCK))]) * 16

    def cut(raw: bytes, bounds: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer(bounds.astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(df), [None, offsets, pa.py_buffer(raw)])

    yield {
        "shard": pa.array(np.full(len(df), shard)),
        "term": tokens.words.take(pa.array(by_term)).cast(pa.string()),
        "df": pa.array(df.astype(np.int32)),
        "heads": cut(heads.tobytes(), head_ends),
        "body": cut(body.tobytes(), begins),
        "ids": pa.nulls(len(df), pa.list_(pa.int64())),
        "sizes": pa.nulls(len(df), pa.list_(pa.int32())),
    }


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder: a row per shard and term, and
    a row per shard, without a term, with its documents' ids and numbers of terms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(map_shards(rows, INDEX, _postings, shard_bytes))


def _terms_of(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): what every item asks for."""

    def each(_: int, batch: pa.RecordBatch) -> Iterator[dict]:
        tokens = Tokens(batch.column(batch.schema.get_field_index("text")), INSIDE)
        if len(tokens.code):
            n = len(tokens.words)
            key, times = np.unique(tokens.doc * n + tokens.code, return_counts=True)
            yield {
                "item": batch.column(batch.schema.get_field_index("item")).take(pa.array(key // n)),
                "item_id": batch.column(batch.schema.get_field_index("item_id")).take(pa.array(key // n)),
                "term": tokens.words.take(pa.array(key % n)).cast(pa.string()),
                "times": pa.array(times),
            }

    kind = items.schema["item_id"].dataType.simpleString()
    return map_shards(
        items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"),
        f"item long, item_id {kind}, term string, times long",
        each,
    )


class _List:
    """A term's postings in one shard."""

    def __init__(self, heads: bytes, body: bytes, impact, sizes: np.ndarray):
        head = np.frombuffer(heads, "<i4").reshape(-1, 4).astype(np.int64)
        self.last, self.ends, self.body = head[:, 0], head[:, 3], np.frombuffer(body, np.uint8)
        self.bounds = impact(head[:, 1], head[:, 2])
        self.bound = int(self.bounds.max())
        self.impact, self.sizes = impact, sizes
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of one block, unpacked once per shard."""
        if k not in self.opened:
            raw = unpack(self.body[self.ends[k - 1] if k else 0 : self.ends[k]])
            docs = np.cumsum(raw[::2]) + (self.last[k - 1] if k else -1)
            self.opened[k] = docs, self.impact(raw[1::2], self.sizes[docs])
        return self.opened[k]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(int(np.searchsorted(self.last, low)), len(self.last)):
            docs, impacts = self.block(k)
            if docs[0] >= high:
                return
            yield (docs, impacts) if docs[0] >= low and docs[-1] < high else _cut(docs, impacts, low, high)

    def look_up(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of ascending ``docs``, 0 where the term does not occur; ``blocks`` would hold them."""
        out = np.zeros(len(docs), np.int64)
        edges = np.flatnonzero(np.diff(blocks, prepend=-1))
        for low, high in zip(edges, np.append(edges[1:], len(docs))):
            own, impacts = self.block(int(blocks[low]))
            at = np.minimum(np.searchsorted(own, docs[low:high]), len(own) - 1)
            out[low:high] = np.where(own[at] == docs[low:high], impacts[at], 0)
        return out


def _cut(docs: np.ndarray, impacts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.searchsorted(docs, [low, high])
    return docs[a:b], impacts[a:b]


def _best(lists: list[tuple[int, _List]], documents: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's ``top`` documents and scores for one item's (weight, list) pairs."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    upto = np.cumsum([0] + [w * one.bound for w, one in lists])
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold, low, span = 0, 0, FIRST_SPAN
    while low < documents:
        high = min(documents, low + span)
        essential = int(np.searchsorted(upto[1:], threshold, "right"))
        if essential == len(lists):
            break
        gathered = np.zeros(high - low, np.int64)
        for w, one in lists[essential:]:
            for docs, impacts in one.between(low, high):
                gathered[docs - low] += w * impacts
        docs = np.flatnonzero(gathered)
        score, docs = gathered[docs], docs + low
        for k in range(essential - 1, -1, -1):
            w, one = lists[k]
            keep = score + upto[k + 1] > threshold
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            block = np.searchsorted(one.last, docs)
            inside = block < len(one.last)
            bound = np.where(inside, w * one.bounds[np.minimum(block, len(one.last) - 1)], 0)
            keep = score + bound + upto[k] > threshold
            docs, score, block, inside = docs[keep], score[keep], block[keep], inside[keep]
            if inside.any():
                score[inside] += w * one.look_up(docs[inside], block[inside])
        keep = score > threshold
        if keep.any():
            found, scores = np.concatenate([found, docs[keep]]), np.concatenate([scores, score[keep]])
            order = np.lexsort((found, -scores))[:top]
            found, scores = found[order], scores[order]
            threshold = int(scores[-1]) if len(scores) == top else 0
        low, span = high, min(SPAN, 2 * span)
    return found, scores


def _answer(lists: DataFrame, weighed: list, documents: int, tokens: int, top: int) -> DataFrame:
    """(item, doc_id, score): each shard's best documents for every item of a block."""

    def impact(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * size * documents) // tokens
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def run(table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        about = next(r for r in own if r["term"] is None)
        sizes = np.array(about["sizes"], np.int64)
        opened = {r["term"]: _List(r["heads"], r["body"], impact, sizes) for r in own if r["term"] is not None}
        out: tuple[list, list, list] = ([], [], [])
        for item, asked in weighed:
            here = [(w, opened[term]) for term, w in asked if term in opened]
            if here:
                docs, scores = _best(here, len(sizes), top)
                out[0].extend([item] * len(docs))
                out[1].extend(about["ids"][d] for d in docs.tolist())
                out[2].extend(scores.tolist())
        kinds = [pa.int64()] * 3
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["item", "doc_id", "score"])

    return lists.groupBy("shard").applyInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, top: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item, item_id, rank, doc_id, score: the ``top`` documents of every row of ``items`` (item_id, text).

    ``item`` numbers the rows of ``items``, so that repeated ids stay apart. Items are taken in blocks
    of about ``item_terms`` terms, by a hash of their number; a block's terms and weights go to the
    shards, and only its lists leave the index.
    """
    spark = index.sparkSession
    asked = staged(_terms_of(items))
    documents, tokens = (
        index.where("term IS NULL")
        .select(F.explode("sizes").alias("sizes"))
        .agg(F.count_if(F.col("sizes") > 0), F.coalesce(F.sum("sizes"), F.lit(0)))
        .first()
    )
    blocks = -(-asked.count() // item_terms)
    best = None
    for block in range(blocks if tokens else 0):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        wanted = staged(own.select("term").distinct())
        none = spark.createDataFrame([(None,)], "term string")
        sent = F.broadcast(wanted.union(none).withColumnRenamed("term", "wanted"))
        # df first, without the lists themselves
        seen = index.select("term", "df").join(F.broadcast(wanted), "term")
        df = F.col("df").cast("double")
        weight = F.floor(1000 * F.log((2 * F.lit(float(documents)) + 2) / (2 * df + 1)))
        weights = seen.groupBy("term").agg(F.sum("df").alias("df")).withColumn("w", weight)
        weighed: dict[int, list] = {}
        for row in own.join(weights, "term").where("w > 0").select("item", "term", F.col("w") * F.col("times")).collect():
            weighed.setdefault(row[0], []).append((row[1], row[2]))
        lists = index.join(sent, F.col("term").eqNullSafe(F.col("wanted"))).drop("wanted", "df")
        found = _answer(lists, sorted(weighed.items()), documents, tokens, top)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = asked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item", "item_id", "rank", "doc_id", "score")


def digests(found: DataFrame) -> DataFrame:
    return found.select("item_id", "rank", "doc_id", "score")
