"""Token ids packed into rows of fixed length.

Texts become ids of a public byte-level vocabulary (never trained here; its path is a parameter), an end mark closes
each document, and documents longer than a row are cut into pieces of at most a row: no id is lost or padded away
inside. Pieces are packed by best fit decreasing: from the longest on, each piece goes into the open row whose free
space is the smallest that suffices, which a segment tree over free-space values finds in log2(row length) steps.

Packing works on pools of about POOL ids that a task gathers in the order of its rows, so that memory is bounded and
nothing is shuffled; within a pool, waste is the last rows' free space. Row ids hold the task's number and a running
number, which a repeated task gives again as long as the table is split in the same way.

Each result row is one row of the id matrix (`ids`, little-endian, padded with the end mark to `row_length`), with
the cumulative segment lengths, the places where positions start anew, and each segment's doc_id and offset within
its document, from which unpack() restores every document.

Defined results: a null or empty text is a lone end mark; repeated rows are packed as often as they occur; a null
doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW, POOL = 2048, 1 << 20
#: Fixed value: the pattern that cuts texts for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids are remembered in a worker; the memory is emptied when it is full.
REMEMBER = 400_000


class Tokenizer:
    """Ids of texts; the end mark is the first id after the vocabulary's own."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.end, self.kind = max(ranks.values()) + 1, np.dtype("<u2" if len(ranks) < 1 << 16 else "<u4")
        self.code = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.code.encode_ordinary(text), self.kind).tobytes()

    def _learn(self, word: str) -> bytes | None:
        """The ids of a space and that word, which stand by themselves if no white space touches the word's ends."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if len(self.words) >= REMEMBER:
            self.words.clear()
        self.words[word] = out = self._ids(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._ids(text)
        found = list(map(self.words.get, rest))
        for k, ids in enumerate(found):
            if ids is None:
                ids = self.words.get(rest[k]) or self._learn(rest[k])
                if ids is None:
                    return self._ids(text)
                found[k] = ids
        return self._ids(first) + b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        return self.code.decode(ids[:-1].tolist())


@lru_cache(maxsize=2)
def tokenizer(vocabulary: bytes) -> Tokenizer:
    return Tokenizer(vocabulary)


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each bin. Ties go to the earlier item and the bin opened last."""
    lengths = list(lengths)
    width = 1 << capacity.bit_length()
    tree, free, bins = [0] * (2 * width), [[] for _ in range(capacity + 1)], []

    def add(at: int, by: int) -> None:
        at += width
        while at:
            tree[at] += by
            at >>= 1

    def smallest(least: int) -> int | None:
        """The smallest free space of at least that much which some bin has."""
        at = least + width
        if tree[at]:
            return least
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < width:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - width
            at >>= 1
        return None

    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        if not 0 < n <= capacity:
            raise ValueError(f"lengths must be from 1 to {capacity}")
        space = smallest(n)
        if space is None:
            b, space = len(bins), capacity
            bins.append([i])
        else:
            b = free[space].pop()
            add(space, -1)
            bins[b].append(i)
        if space > n:
            free[space - n].append(b)
            add(space - n, 1)
    return bins


def pieces(ids: bytes, width: int) -> list[tuple[int, bytes]]:
    """(offset in bytes, ids) of each piece of at most width bytes."""
    return [(k, ids[k : k + width]) for k in range(0, len(ids), width)]


SCHEMA = pa.schema([("row_id", pa.int64()), ("ids", pa.binary()), ("row_length", pa.int32()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])
DDL = "row_id long, ids binary, row_length int, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, offsets array<long>"


def pack_pool(pool: list[tuple[int | None, int, bytes]], row: int, size: int, end: bytes) -> list[tuple]:
    """(ids, number of ids, cumulative lengths, doc_ids, offsets) of each packed row of a pool of pieces."""
    out = []
    for members in best_fit_decreasing([len(p[2]) // size for p in pool], row):
        cum = np.cumsum([0] + [len(pool[i][2]) // size for i in members])
        data = b"".join(pool[i][2] for i in members)
        out.append((data + end * (row - int(cum[-1])), int(cum[-1]), cum.tolist(), [pool[i][0] for i in members], [pool[i][1] // size for i in members]))
    return out


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, pool: int = POOL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One result row for each packed row; see above for its columns."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shared.value)
        size, made, number = tok.kind.itemsize, 0, TaskContext.get().partitionId()
        end = np.array([tok.end], tok.kind).tobytes()
        waiting, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            rows = pack_pool(waiting, row, size, end)
            waiting.clear()
            held = 0
            for k in range(0, len(rows), 2048):
                part = rows[k : k + 2048]
                ids, n, cum, of, at = zip(*part, strict=True)
                names = [number << 40 | made + i for i in range(len(part))]
                made += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((names, ids, [row] * len(part), n, cum, [c[:-1] for c in cum], of, at), SCHEMA, strict=True)], schema=SCHEMA)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, ids in pieces(tok.encode(body.as_py() or "") + end, row * size):
                    waiting.append((name, at, ids))
                    held += len(ids) // size
                    if held >= pool:
                        yield from flush()
        if waiting:
            yield from flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DDL)


def unpack(rows: Iterable, vocabulary: bytes) -> dict[int | None, list[str]]:
    """The texts of packed rows by doc_id, for rows that hold whole documents whose ids are unique."""
    tok, found = tokenizer(vocabulary), {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), tok.kind)
        for a, b, name, at in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["offsets"], strict=False):
            found.setdefault(name, []).append((at, ids[a:b]))
    return {name: tok.decode(np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])])) for name, parts in found.items()}


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet."""
    packed.write.mode("errorifexists").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents as packed rows of ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
