"""Byte-level BPE encoding and decoding by the ranks of a local file, through the tiktoken library.

The rank file (some MB at most, read on the driver) is broadcast, and each Python worker builds one encoder from it.
Texts are encoded whole. One of more than PIECE characters is split before that, because the library's pattern matching
needs stack for each character of a run of white space. The splits are at boundaries that every match respects:

* between a character that is no white space and white space: white space within a match is only its first character,
  and what the pattern looks ahead for matters at the end of white space alone;
* before the last character of a run of white space that something follows, and at the end of one that nothing does:
  such a run of RUN characters or more is one match, and is given to the library as one piece.

So the ids are those of the whole text. Special tokens are not known: their strings are ordinary text. Ids are decoded
to bytes, which need not be whole characters where a part of the ids is decoded.

Defined results: null and empty texts have no ids; bytes that are not UTF-8 are read as U+FFFD; null ids decode to no
bytes; rows are coded one by one, so repeated rows and ids give equal results; an empty table gives an empty result;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from axolin.llm.common import quoted, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a text that is not split, and of white space that is one piece in a longer text.
PIECE, RUN = 1 << 16, 1 << 10
#: Bytes of results after which a batch is handed on.
BATCH = 4 << 20
#: The characters that Unicode calls white space, as the library's pattern does.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splits(text: str, piece: int = PIECE, run: int = RUN) -> Iterator[tuple[bool, str]]:
    """(whether it is one match, part) of the parts of a text, which are safe to encode one by one."""
    border = re.compile(f"[^{SPACE}](?=[{SPACE}])")

    def words(at: int, stop: int) -> Iterator[tuple[bool, str]]:
        while stop - at > piece and (m := border.search(text, at + piece - 1, stop)):
            yield False, text[at : m.end()]
            at = m.end()
        if at < stop:
            yield False, text[at:stop]

    at = 0
    for m in re.finditer(f"[{SPACE}]{{{run},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield from words(at, m.start())
        if end > m.start():
            yield True, text[m.start() : end]
        at = end
    yield from words(at, len(text))


class Coder:
    """The library's encoder for the content of a rank file and a pattern."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in lines}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE:
            return np.array(self.library.encode_ordinary(text), np.int32)
        parts = [self.library._encode_single_piece(part) if whole else self.library.encode_ordinary(part) for whole, part in splits(text)]
        return np.concatenate([np.array(p, np.int32) for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


@lru_cache(maxsize=2)
def coder(ranks: bytes, pattern: str) -> Coder:
    return Coder(ranks, pattern)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in found])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))


def _appended(df: DataFrame, source: str, kind: str, name: str, type_: DataType, ranks: str, pattern: str, code: Callable, size: Callable, array: Callable) -> DataFrame:
    """df with a column of code(coder, value) for each value of the column `source`, cast to `kind`."""
    with open(ranks, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, pattern)
        for batch in batches:
            values, kept = batch.column(batch.num_columns - 1), [batch.column(k) for k in range(batch.num_columns - 1)]
            done, held, at = [], 0, 0
            for k in range(batch.num_rows):
                done.append(code(own, values[k]))
                held += size(done[-1])
                if held >= BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(done)) for c in kept], array(done)], names=names)
                    done, held, at = [], 0, k + 1

    # plain names within the map, as columns may have any
    names = [f"c{k}" for k in range(len(df.columns) + 1)]
    wide = df.select(*[quoted(c).alias(n) for c, n in zip(df.columns, names, strict=False)], quoted(source).cast(kind).alias(names[-1]))
    out = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=False)]).add(names[-1], type_)
    return wide.mapInArrow(run, out).toDF(*df.columns, name)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """df with the ids of the column `text` as a column of arrays of int."""
    read = lambda own, v: own.encode(v.as_py().decode("utf-8", "replace")) if v.is_valid else np.zeros(0, np.int32)
    return _appended(df, text, "binary", ids, ArrayType(IntegerType()), ranks, pattern, read, lambda x: 4 * len(x), _lists)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """df with the bytes of the column `ids` as a column of binary."""
    read = lambda own, v: own.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else b""
    return _appended(df, ids, "array<int>", decoded, BinaryType(), ranks, pattern, read, len, lambda found: pa.array(found, pa.binary()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: number and digest of every document's ids, and the digest of what they decode to."""
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
