"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every byte is removed that a string of LENGTH bytes covers which also starts earlier: in a document of smaller doc_id,
or earlier in the same one. Strings are judged on the input; matches stay within documents.

Copies of whole documents are found first (by SHA-256) and searched no further: all their windows start earlier in the
copy of smallest doc_id. Of the other documents each window (string of LENGTH bytes) has an anchor that its bytes
alone determine (see anchors.py), so equal windows have equal anchors. Anchors that occur once can have no repeated
window. The windows of a repeated anchor's occurrence lie side by side in a piece of text, its context. Contexts are
dealt out by anchor, so that all equal windows meet in one task and no two tasks need to compare.

A task takes contexts in order of (anchor, doc_id, place). Contexts of equal bytes collapse to the first one before
anything else. Over the rest it builds a Burrows-Wheeler transform (contexts end in marks of their own) and expands
intervals breadth first: from the interval of all suffixes, each step prepends every symbol that occurs before an
interval, and the right end of each interval so found gets, if it has none yet, the step's number as its common prefix
with its neighbour. Common prefixes are thus found by increasing value, each of them once, and after LENGTH steps the
ends without a value are those where neighbours share LENGTH bytes or more: windows between two ends with a value are
equal. All but the first of them are repeats.

Equal anchors and equal contexts that one task reads collapse before they are shuffled: one of them goes to its
anchor's task, the others go elsewhere as known repeats. A line that stands in every document so sends a row or two
from each batch to its task, not one from each document.

The text is shuffled once, by doc_id, and that exchange is read again for the contexts and for the final cut. A task
holds the different contexts of about CHUNK bytes of anchors. An anchor with more than CHUNK bytes of them (a common
line between other texts) passes its windows on to longer anchors, 64 bytes and at last the window itself, whose
contexts are all equal; so memory is bounded whatever repeats.

Defined results: null text is empty; texts shorter than LENGTH keep everything; a null doc_id counts as smaller than
all others; rows that repeat a doc_id, or have none, are documents of their own, in the order of their texts' digests
(where there are such rows, all rows are numbered in that order first, which costs one more copy of the table); long
texts are searched whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.anchors import owned_windows
from axolin.llm.common import cut, table

LENGTH, GRAM, CHUNK = 100, 32, 1 << 20
#: Lengths of the anchors that take over from those with too many contexts; the last one makes each window its own anchor.
DEEPER = (64, LENGTH)
_NULL_ID = -(2**63)
#: Copies of one text that meet in one task; more are dealt to several. Up to so many such texts are broadcast.
TOGETHER, BROADCAST_TEXTS = 1000, 1_000_000


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in the order of their first `depth` symbols or more, by doubling."""
    n = len(symbols)
    rank, k = symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key)
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        k *= 2
        if k >= depth or rank[order[-1]] == n - 1:
            return order


def expand_intervals(bwt: np.ndarray, steps: int) -> np.ndarray:
    """For each place i in suffix order, the length of the prefix common to the suffixes i - 1 and i, where it is less than `steps`, else -1; 0 at place 0."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    same = bwt[order[1:]] == bwt[order[:-1]]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    common = np.full(n + 1, -1, np.int16)
    common[0] = common[n] = 0
    left, right = np.array([0]), np.array([n - 1])
    for step in range(steps):
        size = right - left + 1
        total = int(size.sum())
        if not total:
            break
        at = np.arange(total) + np.repeat(left - (np.cumsum(size) - size), size)
        # the first and the last place of a symbol in an interval lead to the ends of the interval it extends to
        low, high = lf[at[before[at] < np.repeat(left, size)]], lf[at[after[at] > np.repeat(right, size)]]
        low.sort()
        high.sort()
        fresh = common[high + 1] < 0
        left, right = low[fresh], high[fresh]
        common[right + 1] = step
    return common[:n]


def window_classes(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of every window of the contexts; windows of a class are equal strings."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes) - 1
    symbols = np.empty(int(sizes.sum()), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    symbols[ends] = 256 + np.arange(len(contexts))
    order = suffix_order(symbols, length)
    common = expand_intervals(symbols[order - 1], length)
    cls = np.cumsum(common >= 0)
    of = np.searchsorted(ends, order)
    offset = order - (ends[of] - sizes[of] + 1)
    ok = offset <= sizes[of] - 1 - length
    return of[ok], offset[ok], cls[ok]


_ANCHORS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("place", pa.int32()), ("again", pa.bool_())])
_CONTEXTS = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("ctx", pa.binary())])


def spread(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that deal rows out by document and place."""
    key = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (places >> 12).astype(np.uint64)
    return (key ^ key >> np.uint64(31)).view(np.int64)


def collapse_anchors(h: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, again): of equal anchors only one keeps its hash as the key, the others get keys that spread them; again marks all of them."""
    order = np.argsort(h, kind="stable")
    equal = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    key, again = h.copy(), np.zeros(len(h), bool)
    rest = order[equal]
    key[rest] = spread(ids[rest], places[rest])
    again[order] = equal | np.append(equal[1:], False)
    return key, again


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, place, again) for every anchor; some 2**18 at a time, those equal among them leave known as repeated."""

    def emit() -> pa.RecordBatch:
        h, i, p = np.concatenate(hs).view(np.int64), np.concatenate(ids), np.concatenate(places).astype(np.int32)
        key, again = collapse_anchors(h, i, p)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, i, p, again)], schema=_ANCHORS)

    hs, ids, places, held = [], [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            h, place, _, _ = owned_windows(np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8), GRAM, LENGTH)
            hs.append(h)
            ids.append(np.full(len(h), i, np.int64))
            places.append(place)
            held += len(h)
            if held > 1 << 18:
                yield emit()
                hs, ids, places, held = [], [], [], 0
    if held:
        yield emit()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, (id, place) of those marked again or whose h occurs more than once; one row is held back between batches."""
    last, last_row, known = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        h, i, p = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        equal = np.concatenate([[last is not None and h[0] == last], h[1:] == h[:-1]])
        keep = equal | np.append(equal[1:], False) | b.column(3).to_numpy(zero_copy_only=False)
        ids, places = i[keep], p[keep]
        if equal[0] and not known:
            ids, places = np.append(ids, last_row[0]), np.append(places, last_row[1])
        last, last_row, known = h[-1], (i[-1], p[-1]), bool(keep[-1])
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(places.astype(np.int32))], ["id", "place"])


def _collapsed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """(h, id, lo, hi, ctx) of contexts (h, id, lo, ctx). Of equal ones the first stays; the others, all of whose windows are repeats, become marks: null for ctx, a key that spreads them."""
    best: dict[tuple[int, bytes], tuple[int, int]] = {}
    for h, i, lo, ctx in rows:
        first = best.get((h, ctx))
        if first is None or (i, lo) < first:
            best[h, ctx] = i, lo
    out = [(h, i, lo, lo + len(ctx) - LENGTH, ctx) for (h, ctx), (i, lo) in best.items()]
    marks = sorted({(i, lo, lo + len(ctx) - LENGTH) for h, i, lo, ctx in rows if best[h, ctx] != (i, lo)})
    joined: list[tuple[int, int, int]] = []
    for i, lo, hi in marks:
        if joined and joined[-1][0] == i and joined[-1][2] + 1 == lo:
            joined[-1] = i, joined[-1][1], hi
        else:
            joined.append((i, lo, hi))
    return _marks_and([x for x, _, _ in joined], [x for _, x, _ in joined], [x for _, _, x in joined], out)


def _marks_and(ids: list[int], first: list[int], last: list[int], contexts: list[tuple]) -> pa.RecordBatch:
    key = spread(np.array(ids, np.int64), np.array(first, np.int32)).tolist() if ids else []
    cols = [[c[k] for c in contexts] for k in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(a + c, f.type) for a, c, f in zip((key, ids, first, last, [None] * len(ids)), cols, _CONTEXTS, strict=True)], schema=_CONTEXTS)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the repeated anchors of each document, collapsed some 2**15 at a time; the windows start at lo..hi."""
    rows: list[tuple] = []
    for b in batches:
        for i, t, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            h, place, first, last = owned_windows(np.frombuffer(raw, np.uint8), GRAM, LENGTH)
            at = np.flatnonzero(np.isin(place, wanted.values.to_numpy()))
            rows += [(x, i, lo, raw[lo : hi + LENGTH]) for x, lo, hi in zip(h[at].view(np.int64).tolist(), first[at].tolist(), last[at].tolist(), strict=True)]
            if len(rows) > 1 << 15:
                yield _collapsed(rows)
                rows = []
    if rows:
        yield _collapsed(rows)


def repeats_among(h: list[int], ids: list[int], los: list[int], contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of every window that is not the first of its class; contexts are in the order of (h, id, lo) and differ."""
    run = np.array(h)
    alone = np.concatenate([[True], run[1:] != run[:-1]]) & np.concatenate([run[1:] != run[:-1], [True]])
    use = np.flatnonzero(~alone)
    if not len(use):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, offset, cls = window_classes([contexts[k] for k in use.tolist()], length)
    doc, start = np.array(ids, np.int64)[use][of], np.array(los, np.int64)[use][of] + offset
    order = np.lexsort((start, doc, cls))
    doc, start, cls = doc[order], start[order], cls[order]
    head = np.concatenate([[True], cls[1:] != cls[:-1]])
    group = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = (doc != doc[group]) | (start != start[group])
    return doc[again], start[again]


def narrower(rows: list[tuple[int, int, int, bytes]], gram: int) -> list[tuple[int, int, int, bytes]]:
    """The same windows, in contexts of anchors of that many bytes."""
    out = []
    for _, i, lo, ctx in rows:
        h, _, first, last = owned_windows(np.frombuffer(ctx, np.uint8), gram, LENGTH)
        out += [(x, i, lo + a, ctx[a : b + LENGTH]) for x, a, b in zip(h.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)]
    return out


def classifier(deeper: int | None, limit: int):
    """A map from rows sorted by (h, id, lo) to marks, null for ctx: windows that start at lo..hi are repeats. An anchor with more than `limit` bytes of different contexts passes them on, cut by anchors of `deeper` bytes."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, start = repeats_among(*map(list, zip(*held, strict=True)))
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
            yield _marks_and(doc[np.append(0, cut + 1)].tolist(), start[np.append(0, cut + 1)].tolist(), start[np.append(cut, len(doc) - 1)].tolist(), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed, size = [], [], 0
        anchor, begin, own, over, seen = None, 0, 0, False, {}
        ids, a, b = [], [], []
        for batch in batches:
            for x, i, lo, hi, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                again = ctx is None
                if not again:
                    if x != anchor:
                        if size >= CHUNK:
                            yield from solve(held)
                            held, size = [], 0
                        anchor, begin, own, over, seen = x, len(held), 0, False, {}
                    first = seen.get(ctx)
                    again = first is not None and first != (i, lo)
                    if over:
                        passed.append((x, i, lo, ctx))
                    elif first is None:
                        seen[ctx] = (i, lo)
                        held.append((x, i, lo, ctx))
                        own += len(ctx)
                        size += len(ctx)
                        if deeper and own > limit:
                            passed += held[begin:]
                            del held[begin:]
                            size, over, seen = size - own, True, {}
                    if len(passed) >= 1 << 13:
                        yield _collapsed(narrower(passed, deeper))
                        passed = []
                if again:
                    ids.append(i)
                    a.append(lo)
                    b.append(hi)
                    if len(ids) >= 1 << 15:
                        yield _marks_and(ids, a, b, [])
                        ids, a, b = [], [], []
        if held:
            yield from solve(held)
        if passed:
            yield _collapsed(narrower(passed, deeper))
        if ids:
            yield _marks_and(ids, a, b, [])

    return run


def removed_mask(n: int, spans: list[tuple[int, int]], length: int = LENGTH) -> np.ndarray:
    """Which of n bytes the windows starting in these ranges cover."""
    step = np.zeros(n + 1, np.int32)
    for first, last in spans:
        step[first] += 1
        step[last + length] -= 1
    return np.cumsum(step[:n]) > 0


def _cut(raw: bytes, copy: bool, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes that stay, and how many runs go."""
    n = len(raw)
    if copy and n >= LENGTH:
        return b"", 1
    if not spans:
        return raw, 0
    gone = removed_mask(n, spans)
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _final_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, t, copy, marks in zip(*(c for c in b.columns), strict=True):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            spans = [(m["a"], m["b"]) for m in marks.as_py()] if marks.is_valid else []
            kept, runs = _cut(raw, copy.as_py(), spans)
            rows.append((i.as_py(), len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _without_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _final_rows(batches):
        yield b.drop_columns(["kept"])


def _numbered(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, text), (id, name)) with a new id for each row, in the order of the old ids and then of the texts' digests.
    Rows are sorted over ranges and counted by partition; only the counts come to the driver."""
    keyed = cut(source.withColumn("row", F.monotonically_increasing_id()))
    order = keyed.select("id", F.sha2("text", 256).alias("sha"), "row").repartitionByRange("id", "sha", "row").sortWithinPartitions("id", "sha", "row")
    order = cut(order.select(F.col("id").alias("name"), "row", F.monotonically_increasing_id().alias("at")))
    sizes = order.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    start = F.broadcast(source.sparkSession.createDataFrame(starts, "part long, start long"))
    numbers = order.withColumn("part", F.shiftright("at", 33)).join(start, "part").select("row", "name", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    return keyed.drop("id").join(numbers, "row").select("id", "text"), numbers.select("id", "name")


def _copies(source: DataFrame) -> DataFrame:
    """(copy_id): rows whose whole text a smaller id has. The rows of a frequent text are dealt to several tasks."""
    digests = source.select("id", F.unhex(F.sha2("text", 256)).alias("sha"))
    heads = cut(digests.groupBy("sha").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    many = heads.where(F.col("n") > TOGETHER).select("sha", F.expr(f"(n - 1) div {TOGETHER} + 1").alias("salts"))
    many = F.broadcast(many) if many.count() <= BROADCAST_TEXTS else many
    dealt = digests.join(many, "sha", "left").select("id", "sha", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1).cast("bigint"))).alias("salt"))
    laid = heads.select("sha", "head", F.explode(F.expr(f"sequence(0L, (n - 1) div {TOGETHER})")).alias("salt"))
    return dealt.join(laid, ["sha", "salt"]).where("id != head").select(F.col("id").alias("copy_id"))


def remove_repeats(docs: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text", limit: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with_text, the remaining bytes as kept."""
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = None
    if source.groupBy("id").count().where("count > 1").limit(1).count():
        source, names = _numbered(source)
    copies = _copies(source)
    whole = source.join(copies, F.col("id") == F.col("copy_id"), "left").select("id", "text", F.col("copy_id").isNotNull().alias("copy"))
    single = whole.where(~F.col("copy"))
    anchors = single.select("id", "text").mapInArrow(_anchor_rows, "h long, id long, place int, again boolean")
    again = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "id long, place int")
    wanted = again.groupBy(F.col("id").alias("w_id")).agg(F.collect_set("place").alias("places"))
    row = "h long, id long, lo int, hi int, ctx binary"
    contexts = single.join(wanted, F.col("id") == F.col("w_id")).select("id", "text", "places").mapInArrow(_context_rows, row)
    found = contexts
    for deeper in (*DEEPER, None):
        found = found.repartition("h").sortWithinPartitions("h", "id", "lo").mapInArrow(classifier(deeper, limit), row)
    marks = found.groupBy(F.col("id").alias("m_id")).agg(F.collect_list(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("marks"))
    shape = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = whole.join(marks, F.col("id") == F.col("m_id"), "left").select("id", "text", "copy", "marks")
    out = joined.mapInArrow(_final_rows, shape + ", kept binary") if with_text else joined.mapInArrow(_without_kept, shape)
    out = out if names is None else out.join(names, "id").select(F.col("name").alias("id"), *out.columns[1:])
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: what stays of every document once repeated strings are gone."""
    return remove_repeats(table(spark, sf_dir, "documents"))
