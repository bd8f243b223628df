"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens and every pre-token is replaced by its number in the dictionary of its
chunk, a bounded run of documents; that list of numbers is the document's positions. The chunks'
dictionary words are shuffled by word, each distinct word is encoded once where it arrives, and its
ids go back to the chunks, where documents are put together by position. Documents themselves are
not shuffled: they lie in buckets of their chunks, which the ids come to. Decoding looks every id up in
the table of token bytes, which holds one row per id of the vocabulary and goes with the tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from marginwatch.llm.common import map_batches, staged_buckets

DEFAULT = "byte_bpe_multi_50k.tiktoken"
# A vocabulary is sent with the tasks only up to this size.
MOST_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> bytes:
    """The rank file as it is: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        raw = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encoding(raw: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})


def token_bytes(raw: bytes) -> list[bytes]:
    """The bytes of every id; ids without a token are empty."""
    ranks = parse_ranks(raw)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: the high planes of small numbers cost next to nothing."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4").ravel()


def pack_all(*arrays: np.ndarray, rest: bytes = b"") -> bytes:
    """Arrays of one length, and bytes, as one compressed block."""
    n = np.array([len(arrays[0])], "<u4").tobytes()
    planes = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.compress(n + b"".join(planes) + rest, 3)


def unpack_all(packed: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(packed)
    n, at, out = int(np.frombuffer(raw[:4], "<u4")[0]), 4, []
    for _ in range(arrays):
        planes = np.frombuffer(raw[at : at + 4 * n], np.uint8).reshape(4, -1)
        out.append(planes.T.copy().view("<u4").ravel())
        at += 4 * n
    return out, raw[at:]


def _cut(docs: DataFrame, pattern: str, parts: int, chunk_pretokens: int, chunk_words: int) -> DataFrame:
    """By chunk, rows of documents (``packed__``) and of dictionary words (``words__``): a block for each
    of ``parts`` parts of all words, with the words of the chunk in it and their numbers."""
    names = [f.name for f in docs.schema if f.name != "text"]
    others = [StructField(f.name, f.dataType) for f in docs.schema if f.name != "text"]
    extra = StructType.fromDDL("chunk__ long, packed__ binary, part__ int, words__ binary").fields

    def make():
        find = regex.compile(pattern).findall
        chunk = TaskContext.get().partitionId() << 24
        numbers: dict[str, int] = {}
        used = 0

        def close() -> Iterator[dict]:
            nonlocal chunk, used
            dealt: list[tuple[list[bytes], list[int]]] = [([], []) for _ in range(parts)]
            for at, word in enumerate(numbers):
                raw = word.encode("utf-8", "surrogatepass")
                words, ats = dealt[zlib.crc32(raw) % parts]
                words.append(raw)
                ats.append(at)
            for k, (words, ats) in enumerate(dealt):
                if words:
                    lengths, steps = np.array([len(w) for w in words]), np.diff(np.array(ats), prepend=0)
                    yield {
                        **dict.fromkeys(names, [None]),
                        "chunk__": [chunk],
                        "packed__": [None],
                        "part__": [k],
                        "words__": [pack_all(lengths, steps, rest=b"".join(words))],
                    }
            numbers.clear()
            chunk, used = chunk + 1, 0

        def each(batch: pa.RecordBatch):
            nonlocal used
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            begun, packed = 0, []
            for k, text in enumerate(texts):
                words = find(text or "")
                packed.append(pack(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint32)))
                used += len(words)
                if used >= chunk_pretokens or len(numbers) >= chunk_words or k == len(texts) - 1:
                    part, n = batch.slice(begun, k + 1 - begun), k + 1 - begun
                    yield {
                        **{name: part.column(part.schema.get_field_index(name)) for name in names},
                        "chunk__": [chunk] * n,
                        "packed__": packed,
                        "part__": [None] * n,
                        "words__": [None] * n,
                    }
                    begun, packed = k + 1, []
                    if used >= chunk_pretokens or len(numbers) >= chunk_words:
                        yield from close()

        each.finish = close
        return each

    return map_batches(docs, StructType(others + extra), make)


def encode(
    docs: DataFrame,
    ranks: bytes,
    *,
    pattern: str = public_tokenizers.PATTERN,
    decoded: bool = False,
    chunk_pretokens: int = 2_000_000,
    chunk_words: int = 400_000,
) -> DataFrame:
    """``docs`` with ``ids`` array<int> in place of text, and ``decoded`` binary if asked for.

    Both replace columns of these names.
    A null or empty text has no ids. Column names ending in two underscores are reserved. A chunk is
    closed at ``chunk_pretokens`` pre-tokens or ``chunk_words`` distinct ones, or after the document
    that exceeds them, so memory is bounded by these and by the longest document. A word arrives at
    most once per chunk, however frequent it is. Repeated rows are separate rows throughout.
    """
    docs = docs.drop("ids", *["decoded"] * decoded)
    fields = [StructField(f.name, f.dataType) for f in docs.schema if f.name != "text"]
    names = [f.name for f in fields]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = staged_buckets(_cut(docs, pattern, parts, chunk_pretokens, chunk_words), "chunk__", parts)
    packed = pieces.where("packed__ is not null").select(*names, "chunk__", "packed__")
    words = pieces.where("words__ is not null").select("chunk__", "part__", "words__")

    def encoder():
        one = encoding(ranks, pattern).encode_ordinary
        memo: dict[bytes, list[int]] = {}

        def each(batch):
            chunks, out = batch.column("chunk__"), []
            for block in batch.column("words__").to_pylist():
                (lengths, steps), raw = unpack_all(block, 2)
                at, counts, ids = 0, [], []
                for n in lengths.tolist():
                    word = raw[at : at + n]
                    at += n
                    found = memo.get(word)
                    if found is None:
                        found = memo[word] = one(word.decode("utf-8", "surrogatepass"))
                    counts.append(len(found))
                    ids += found
                out.append(pack_all(np.array(counts), steps, rest=pack(np.array(ids, np.uint32))))
            return {"chunk__": chunks, "coded__": out}

        return each

    # every occurrence of a word is in the same part, so it is encoded once
    coded = map_batches(words.repartition(parts, "part__"), "chunk__ long, coded__ binary", encoder)

    result = StructType([*fields, StructField("ids", ArrayType(IntegerType(), False))])
    if decoded:
        result.add("decoded", BinaryType())

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(result)

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        table = token_bytes(ranks) if decoded else []
        held: dict[int, bytes] = {}
        for block in right.column("coded__").to_pylist():
            (counts, steps), raw = unpack_all(block, 2)
            ids, ends = unpack(raw).astype("<i4"), np.cumsum(counts).tolist()
            for at, low, high in zip(np.cumsum(steps).tolist(), [0, *ends], ends, strict=False):
                held[at] = ids[low:high].tobytes()
        ids_of = [held[k] for k in range(len(held))]
        counts = np.array([len(x) // 4 for x in ids_of], np.int64)
        bytes_of = [b"".join([table[i] for i in np.frombuffer(x, "<i4").tolist()]) for x in ids_of] if decoded else []
        flat, lengths, texts = [], [], []
        for code in left.column("packed__").to_pylist():
            numbers = unpack(code)
            order = numbers.tolist()
            flat.extend([ids_of[i] for i in order])
            lengths.append(int(counts[numbers].sum()))
            if decoded:
                texts.append(b"".join([bytes_of[i] for i in order]))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32())
        columns = [left.column(n).cast(target.field(n).type) for n in names]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values).cast(target.field("ids").type))
        if decoded:
            columns.append(pa.array(texts, pa.binary()))
        return pa.Table.from_arrays(columns, schema=target)

    return packed.groupBy("chunk__").cogroup(coded.groupBy("chunk__")).applyInArrow(assemble, result)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``encoded`` with ``decoded`` binary, the bytes of its ``ids`` by the table of token bytes.

    It replaces a column of that name; null ids are no bytes.
    """
    encoded = encoded.drop("decoded")

    def make():
        table = token_bytes(ranks)

        def each(batch):
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            columns["decoded"] = [b"".join([table[i] for i in ids or []]) for ids in columns["ids"].to_pylist()]
            return columns

        return each

    kind = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return map_batches(encoded, kind, make)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
