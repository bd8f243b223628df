"""Training-order materialisation by a keyed Feistel permutation.

Sequences are numbered as they lie in the corpus, and the permutation, made to fit any number of
sequences by cycle walking, gives each its global slot. A shard is a range of slots, and every record
has the same number of bytes, so the place of a slot is arithmetic and reading can resume anywhere.
Tasks hold ranges of shards; written files hold blocks of records end to end, in order of slots.
"""

from __future__ import annotations

import public_tokenizers
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marginwatch.llm.bpe import encoding
from marginwatch.llm.common import map_batches, staged

ROUNDS = 6
# Records that are written and read as one row.
BLOCK = 256


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        k = (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
        if back:
            left, right = right ^ (_scramble(left, k) & mask), left
        else:
            left, right = right, left ^ (_scramble(right, k) & mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """The keyed bijection of 0 .. size - 1, or its inverse.

    Values that leave the range are permuted again until they return (cycle walking); the Feistel
    domain is less than four times ``size``.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            out[todo] = _feistel(out[todo], half, key, back)
            todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def materialise(
    docs: DataFrame,
    ranks: bytes,
    *,
    key: int = 2026,
    length: int = 512,
    per_shard: int = 4096,
    pad: int = 0,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset, doc_id, seq, n_tokens, record.

    A text's tokens are cut into sequences of ``length``; a record holds ``length`` little-endian
    ids of two bytes (four if the vocabulary needs them), the last of a document filled with ``pad``.
    Sequence numbers follow the order of the input's splits, which is fixed for given files and
    split sizes; tokens are staged once with their numbers inside the split, and only one total per
    split reaches the driver. Every task gets a range of whole shards, its rows sorted by slot. A null or empty text
    has no sequence; repeated rows have sequences of their own.
    """
    width = 2 if max(map(int, (line.split()[1] for line in ranks.splitlines() if line)), default=0) < 1 << 16 else 4
    form = f"<u{width}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenise():
        encode = encoding(ranks, pattern).encode_to_numpy
        part, done = TaskContext.get().partitionId(), 0

        def each(batch: pa.RecordBatch):
            nonlocal done
            tokens, n, first = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "", disallowed_special=())
                tokens.append(ids.astype(form).tobytes())
                n.append(len(ids))
                first.append(done)
                done += -(-len(ids) // length)
            return {
                "doc_id": batch.column("doc_id"),
                "part": [part] * len(n),
                "first": first,
                "n": n,
                "tokens": tokens,
            }

        return each

    cut = map_batches(
        docs.select("doc_id", "text"), f"doc_id {kind}, part int, first long, n long, tokens binary", tokenise
    )
    cut = staged(cut.where("n > 0"))
    totals = cut.groupBy("part").agg(F.sum(F.ceil(F.col("n") / length)).alias("n")).orderBy("part").collect()
    begins, size = {}, 0
    for r in totals:
        begins[r["part"]] = size
        size += r["n"]

    def place():
        def each(batch: pa.RecordBatch):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "first", "n", "tokens")]
            for begin in range(0, batch.num_rows, 500):
                ids, seqs, counts, records, numbers = [], [], [], [], []
                for doc, part, first, n, tokens in zip(*(c[begin : begin + 500] for c in columns), strict=True):
                    for k in range(-(-n // length)):
                        record = tokens[k * length * width : (k + 1) * length * width]
                        m = len(record) // width
                        if m < length:
                            record += np.full(length - m, pad, form).tobytes()
                        ids.append(doc)
                        seqs.append(k)
                        counts.append(m)
                        records.append(record)
                        numbers.append(begins[part] + first + k)
                slots = permute(np.array(numbers, np.int64), size, key)
                yield {
                    "slot": slots,
                    "shard": (slots // per_shard).astype(np.int32),
                    "byte_offset": slots % per_shard * (length * width),
                    "doc_id": ids,
                    "seq": seqs,
                    "n_tokens": counts,
                    "record": records,
                }

        return each

    rows = map_batches(
        cut,
        f"slot long, shard int, byte_offset long, doc_id {kind}, seq int, n_tokens int, record binary",
        place,
    )
    shards = max(1, -(-size // per_shard))
    parts = min(shards, 100_000)
    part = F.floor(F.col("shard").cast("long") * parts / shards).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("slot")


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK`` consecutive records: shard, first_slot, n, payload, docs, seqs, counts.

    ``rows`` are those of :func:`materialise`, as they lie. The payload is the records end to end; the
    three arrays say for each whose it is. A block lies in one shard; a gap in the slots is an error.
    """
    columns = ["shard", "slot", "record", "doc_id", "seq", "n_tokens"]

    def make():
        held: list[list] = [[] for _ in columns]
        last = None

        def give(n: int) -> dict:
            block = [column[:n] for column in held]
            for column in held:
                del column[:n]
            return {
                "shard": block[0][:1],
                "first_slot": block[1][:1],
                "n": [n],
                "payload": [b"".join(block[2])],
                "docs": [block[3]],
                "seqs": [block[4]],
                "counts": [block[5]],
            }

        def full(least: int):
            """Blocks that are complete: of ``BLOCK`` records, or followed by another shard."""
            while len(held[0]) >= least:
                shards = held[0][:BLOCK]
                n = len(shards) if shards[-1] == shards[0] else shards.index(next(x for x in shards if x != shards[0]))
                yield give(n)

        def each(batch: pa.RecordBatch):
            nonlocal last
            for name, column in zip(columns, held, strict=True):
                column += batch.column(batch.schema.get_field_index(name)).to_pylist()
            slots = held[1][-batch.num_rows :] if batch.num_rows else []
            for slot in slots:
                if last is not None and slot != last + 1:
                    raise ValueError(f"slot {slot} follows {last}")
                last = slot
            yield from full(BLOCK)

        each.finish = lambda: full(1)
        return each

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(
        rows.select(*columns),
        "shard int, first_slot long, n int, payload binary, "
        f"docs array<{kind}>, seqs array<int>, counts array<int>",
        make,
    )


def write(rows: DataFrame, path: str) -> None:
    """Write the packed blocks: a file for each task's range of shards, in order of slots.

    The files' statistics tell a reader which of them hold the slots it wants, so it opens no others.
    """
    pack(rows).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_records(spark: SparkSession, path: str, per_shard: int = 4096) -> DataFrame:
    """The rows of :func:`materialise`, from written blocks: one per record, with its place in its shard."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def make():
        def each(batch: pa.RecordBatch):
            names = ("shard", "first_slot", "n", "payload", "docs", "seqs", "counts")
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for shard, first, n, payload, docs, seqs, counts in zip(*columns, strict=True):
                width = len(payload) // n
                slots = np.arange(first, first + n)
                ends = pa.py_buffer(np.arange(0, len(payload) + 1, width, dtype=np.int32))
                yield {
                    "slot": slots,
                    "shard": [shard] * n,
                    "byte_offset": slots % per_shard * width,
                    "doc_id": docs,
                    "seq": seqs,
                    "n_tokens": counts,
                    "record": pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(payload)]),
                }

        return each

    schema = f"slot long, shard int, byte_offset long, doc_id {kind}, seq int, n_tokens int, record binary"
    return map_batches(blocks, StructType.fromDDL(schema), make)


def resume(spark: SparkSession, path: str, slot: int, per_shard: int = 4096) -> DataFrame:
    """The blocks from ``slot`` on in order, the payload of the first without the slots before.

    ``shard`` is compared first, so that files of earlier shards are not opened.
    """
    rows = spark.read.parquet(path).where((F.col("shard") >= slot // per_shard) & (F.col("first_slot") > slot - BLOCK))
    rows = rows.where(F.col("first_slot") + F.col("n") > slot)
    width = F.length("payload") / F.col("n")
    skip = F.greatest(F.lit(slot) - F.col("first_slot"), F.lit(0))
    return rows.select(
        "shard",
        (F.col("first_slot") + skip).alias("first_slot"),
        (F.col("n") - skip).cast("int").alias("n"),
        F.expr("payload").substr((skip * width + 1).cast("int"), F.length("payload")).alias("payload"),
    ).orderBy("first_slot")
