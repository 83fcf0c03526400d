"""SimHash near-duplicates by Golay-code fuzzy hashing.

The fingerprint of a text has bit b set if more than half of its shingle hashes have it. Two fingerprints link if they
differ in 4 bits at most. To find all links without comparing all pairs, the 64 bits are cut into three segments (22,
21 and 21 bits). Four errors leave at least two segments with two errors at most. Each segment is read as a word of
the perfect binary Golay code of length 23: its keys are the codewords within distance 4, which are one codeword, or
six where the nearest is at distance 3. Two words at distance 2 or less always share one of these codewords (a test
checks it over all cosets). So every link shares, for one of the three pairs of segments, a key made of two codewords
(12 + 12 bits). Fingerprints are spread by these keys, compared bit by bit within a key, and only links within the
radius leave, as a spanning forest of each key's links: components need no more, and a dense group emits no squares.

Copies collapse before anything is compared: the search runs over different fingerprints. At most 108 rows a
fingerprint are shuffled (85 on average), of two longs each. Frequent fingerprints and large components are dealt to
several tasks where rows get the names of their components.

Defined results: null and blank texts have fingerprint zero and link like any other; texts of fewer than 4 words have
the hash of the whole sequence; equal texts are in one component; a component whose rows have no doc_id has none; rows
that repeat a doc_id each have their own text's fingerprint and component; long texts are hashed whole; an empty table
gives an empty result; other columns, whatever their names, are ignored by near_duplicates and kept by keep_one, which
leaves one row of each component: the smallest doc_id, rows without one last, any one of equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import cut, fresh, quoted, table
from axolin.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101
_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash over shingles of lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, n = ends - sizes, max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK].tolist(), stops[k : k + _CHUNK].tolist(), strict=False)], np.uint64)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight counters of one byte in each number
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


@cache
def _near() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: six error words (unused ones repeat the first) and how many of them count."""
    errors = np.zeros((2048, 6), np.int64)
    filled = np.zeros(2048, np.int64)
    words = np.arange(1 << 23, dtype=np.int64)
    weight = np.bitwise_count(words)
    for w in range(5):
        of = words[weight == w]
        for s, e in zip(_syndrome(of).tolist(), of.tolist(), strict=True):
            if filled[s] == 0:
                errors[s, :] = e
            if filled[s] == 0 or w == 4:
                errors[s, filled[s]] = e
                filled[s] += 1
    return errors, filled


def segment_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of up to 23 bits: their codeword indices (n x 6; twelve information bits) and which of the six count."""
    errors, filled = _near()
    s = _syndrome(x)
    return (x[:, None] ^ errors[s]) >> 11, np.arange(6)[None] < filled[s][:, None]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint."""
    parts = [segment_keys((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, ok_a), (b, ok_b) = parts[i], parts[j]
        both = pair << 24 | a[:, :, None] << 12 | b[:, None, :]
        r, p, q = np.nonzero(ok_a[:, :, None] & ok_b[:, None, :])
        rows.append(r)
        keys.append(both[r, p, q])
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among different fingerprints: each is visited once, against the rest."""
    a, b, left = [], [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                front += list(found)
                left = left[~near]
    return a, b


def links_of_runs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each run of equal keys: all of them for short runs, a forest for long ones."""
    n = len(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [n]]))
    out_a, out_b = [], []
    short = edge[(size > 1) & (size <= 8)]
    length = size[(size > 1) & (size <= 8)]
    for d in range(1, 8):
        for start in range(0, 8 - d):
            at = short[length > start + d] + start
            ok = np.bitwise_count(fps[at] ^ fps[at + d]) <= radius
            out_a.append(fps[at][ok])
            out_b.append(fps[at + d][ok])
    for s, m in zip(edge[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        a, b = _forest(fps[s : s + m], radius)
        out_a.append(np.array(a, np.uint64))
        out_b.append(np.array(b, np.uint64))
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by key; a run is held back until its end is seen."""

    def emit(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links_of_runs(k, f)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys, fps, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy().view(np.uint64))
        held += batch.num_rows
        if held >= 1 << 19 and keys[-1][0] != keys[-1][-1]:
            k, f = np.concatenate(keys), np.concatenate(fps)
            at = np.searchsorted(k, k[-1])
            yield emit(k[:at], f[:at])
            keys, fps, held = [k[at:]], [f[at:]], len(k) - at
    if keys:
        yield emit(np.concatenate(keys), np.concatenate(fps))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, fp), fp as a signed long; with a column row, also (row)."""
    names = ["doc_id", *["row"] * bool(row)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], [*names, "fp"])

    given = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), *[F.col(c).alias("row") for c in [row] if c])
    return given.mapInArrow(run, ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in names) + ", fp long")


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of the column fp, enough to connect all that are linked."""
    keyed = fps.select("fp").mapInArrow(_key_rows, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long").distinct()


#: Up to so many rows to drop are broadcast (about 16 bytes each).
BROADCAST_ROWS = 1_000_000


#: Rows of one fingerprint, or fingerprints of one component, that meet in one task; more are dealt to several.
TOGETHER = 1000


def _named(reps: DataFrame) -> DataFrame:
    """(fp, id, salts): for each fingerprint of reps (fp, first, n) the least `first` of its component, once for each
    TOGETHER of its n rows. Only fingerprints with links are shuffled by component; each component's name is laid out
    for as many groups as it has TOGETHER fingerprints, so a large component is joined in many tasks."""
    parts = connected_components(near_links(reps)).select(F.col("node").alias("fp"), "component")
    linked = cut(reps.join(parts, "fp"))
    names = linked.groupBy("component").agg(F.min("first").alias("id"), F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("groups"))
    names = cut(names)
    many = names.where("groups > 1").select("component", "groups")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    dealt = linked.join(many, "component", "left").withColumn("group", F.pmod(F.xxhash64("fp"), F.coalesce("groups", F.lit(1)).cast("bigint"))).drop("groups")
    laid = names.select("component", "id", F.explode(F.expr("sequence(0L, groups - 1L)")).alias("group"))
    joined = dealt.join(laid, ["component", "group"]).select("fp", "n", "id")
    alone = reps.join(parts.select("fp"), "fp", "left_anti").select("fp", "n", F.col("first").alias("id"))
    return joined.unionByName(alone).select("fp", "id", F.explode(F.expr(f"sequence(0L, (n - 1) div {TOGETHER})")).alias("salt"))


def _with_names(of: DataFrame, first: Column) -> DataFrame:
    """The rows of a checkpointed table with a column fp, and in id the least `first` of their component. Rows of a
    frequent fingerprint are dealt to several tasks by their place in the table."""
    reps = cut(of.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    hot = reps.where(F.col("n") > TOGETHER).select("fp", F.expr(f"(n - 1) div {TOGETHER} + 1").alias("salts"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    dealt = of.withColumn("turn", F.monotonically_increasing_id()).join(hot, "fp", "left")
    dealt = dealt.withColumn("salt", F.pmod("turn", F.coalesce("salts", F.lit(1).cast("bigint")))).drop("turn", "salts")
    return dealt.join(_named(reps), ["fp", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    of = cut(fingerprints(docs, doc_id, text))
    return _with_names(of, F.col("doc_id")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component. Rows are told apart by a key that is checkpointed with them."""
    row, key = fresh(docs, "row", "key")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    of = cut(fingerprints(keyed, row=row).select("fp", "row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("of")))
    gone = cut(_with_names(of, F.struct("of", "row")).where("row != id.row").select(F.col("row").alias(key)))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return keyed.join(side, F.col(row) == F.col(key), "left_anti").select(*[quoted(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
