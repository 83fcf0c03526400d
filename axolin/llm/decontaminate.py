"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document is compared with an item if it has the item's length in words (or is the whole document, if
that is shorter). Every window counts; they are found in four steps:

1. Which windows can match at all. Two lists of n and n' shingles, repeats included, whose weighted similarity (sum of
   smaller counts over sum of larger ones) is at least t share t (n + n') / (1 + t) of them. So a window can match an
   item of its length only if at least that many of its places hold a shingle of some item of that length (8/9 of them
   at 0.8). Every place of every document is hashed and looked up; from the places with a hit all windows with enough
   hits follow by arithmetic. This leaves out no window that matches, wherever its shingles stand in the item.
2. These windows and all items get 64-bit SimHashes over their shingles, repeats included. Bits are counted by running
   sums over a document's places, so that every window is the difference of two sums, however long it is.
3. Multi-index Hamming search. The bits are cut into BLOCKS blocks of 10 or 11 bits. Fingerprints within the radius
   R = a BLOCKS + b agree up to a bits on one of the first b + 1 blocks, or up to a - 1 bits on one of the others. Each
   item is entered under all those neighbours of its blocks (at most 732 keys at the given parameters, whatever the
   data), together with its length; a window looks up its BLOCKS own keys. Pairs within R bits stay, each one by the
   first block that yields it.
4. Pairs are verified on the words themselves: the weighted similarity of the shingles must reach the threshold. What
   all windows of a document share with an item follows from one pass over the places of the item's shingles.

R = 19 of 64 bits: at similarity 0.8 fingerprints differ in 9.7 bits on average (deviation 2.9); under 2 in 1,000 such
windows differ in more than 19, and nearly none at 0.85. A leak has many windows; its best one is rarely that far.

All of it is DataFrame code. Only places with a hit leave their row in step 1, as numbers (they are collected by
document, so a passage that many documents share is spread over them); the shingles of the stretches with windows are read
in a second scan, once each, and pairs carry numbers only, so time and space are linear in documents and items. Items
are collapsed to different texts. Their tables are broadcast up to BROADCAST_SHINGLES shingles and BROADCAST_KEYS keys,
and the list of documents with windows up to BROADCAST_ROWS rows of fixed size; beyond these all joins are by shuffle.

Defined results: null or blank texts and items match nothing; an item or document of fewer than five words is one
shingle; items that repeat an item_id or a text each get their rows; rows are told apart by doc_id (null is a value) and
text, so rows that repeat a doc_id with different texts get results of their own, and rows equal in both get one;
empty tables give an empty result; other columns, whatever their names, are ignored by find_leaks and kept by
drop_leaks, which judges each row by its text; letters are compared in lower case; very long texts are searched whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axolin.llm.common import WORD_CHARS, cut, fresh, table

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 6
#: Bounds of the broadcasts: some 30 bytes a shingle, 40 bytes a key, 100 bytes a row.
BROADCAST_SHINGLES, BROADCAST_KEYS, BROADCAST_ROWS = 1_000_000, 1_000_000, 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_CHARS), F.lit(0))


def shingles(w: Column, k: Column) -> Column:
    """The shingles of k words as strings, the whole sequence if it is shorter."""
    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))))
    return F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, k), " "))


def simhash(s: Column, lane: int = 16) -> Column:
    """Bit b is set if more than half of the shingles' hashes have it. Bits are counted in lanes of a long, a few lanes
    at a time; 16 bits a lane suffice for 65,535 shingles, 32 for any array."""
    mask = F.lit(sum(1 << at for at in range(0, 64, lane))).cast("bigint")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def lanes(h: Column, j: int) -> Column:
        return F.aggregate(h, zero, lambda acc, x: acc + F.shiftrightunsigned(x, j).bitwiseAND(mask))

    def bits(counted: Column) -> Column:
        def of(b: Column) -> Column:
            n = F.call_function("shiftrightunsigned", F.get(counted["sums"], F.pmod(b, F.lit(lane))), F.floor(b / lane).cast("int") * lane).bitwiseAND(F.lit((1 << lane) - 1).cast("bigint"))
            return F.when(n * 2 > counted["n"], F.call_function("shiftleft", one, b)).otherwise(zero)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, b: acc.bitwiseOR(of(b)))

    counted = lambda h: F.struct(F.size(h).cast("bigint").alias("n"), F.array(*[lanes(h, j) for j in range(lane)]).alias("sums"))
    return F.transform(F.transform(F.array(F.transform(s, lambda x: F.xxhash64(x))), counted), bits)[0]


def block_plan(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, number of bits, radius) of each block: fingerprints within `radius` agree up to a block's radius on
    one block at least. A block of radius -1 need not be searched."""
    a, b = divmod(radius, blocks)
    at = [64 * k // blocks for k in range(blocks + 1)]
    if any(at[k + 1] - at[k] > 16 for k in range(blocks)):
        raise ValueError("a block may have 16 bits at most")
    return [(at[k], at[k + 1] - at[k], a if k <= b else a - 1) for k in range(blocks)]


def _value(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _key(m: Column, block: int, blocks: int, value: Column) -> Column:
    return (m.cast("bigint") * blocks + block) * 65536 + value


def _flipped(masks: Column, key: Column) -> Column:
    return F.transform(masks, lambda x: key.bitwiseXOR(x))


def item_keys(m: Column, fp: Column, radius: int, blocks: int) -> Column:
    """All keys of an item of m words: for each block the values within its radius."""
    out = []
    for k, (at, bits, r) in enumerate(block_plan(radius, blocks)):
        masks = [sum(1 << x for x in c) for n in range(r + 1) for c in combinations(range(bits), n)]
        if masks:
            listed = F.expr("array(" + ",".join(f"{x}L" for x in masks) + ")")
            out.append(_flipped(listed, _key(m, k, blocks, _value(fp, at, bits))))
    return F.concat(*out)


def window_keys(m: Column, fp: Column, radius: int, blocks: int) -> Column:
    """The keys that a window looks up: structs of block and key."""
    return F.array(*[F.struct(F.lit(k).alias("block"), _key(m, k, blocks, _value(fp, at, bits)).alias("key")) for k, (at, bits, r) in enumerate(block_plan(radius, blocks)) if r >= 0])


def first_block(differ: Column, block: Column, radius: int, blocks: int) -> Column:
    """Whether no block before the given one yields the pair whose fingerprints differ in these bits."""
    ok = F.lit(True)
    for k, (at, bits, r) in enumerate(block_plan(radius, blocks)):
        ok = ok & ((block <= k) | (F.bit_count(_value(differ, at, bits)) > r))
    return ok


def _lanes(h: Column, lane: int) -> list[Column]:
    """The bits of a hash as lanes of longs, 63 // lane of them in each: sums of these count bits while counts fit a lane."""
    per = 63 // lane
    bit = lambda b: F.shiftleft(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("bigint")), b % per * lane)
    return [reduce(Column.bitwiseOR, [bit(b) for b in range(k, min(64, k + per))]) for k in range(0, 64, per)]


def _majority(sums: list[Column], n: Column, lane: int) -> Column:
    """The fingerprint of n hashes from the sums of their lanes: bit b is set if more than half of them have it."""
    per, mask = 63 // lane, F.lit((1 << lane) - 1).cast("bigint")
    bit = lambda b: F.when(F.shiftrightunsigned(sums[b // per], b % per * lane).bitwiseAND(mask) * 2 > n, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return reduce(Column.bitwiseOR, [bit(b) for b in range(64)])


def window_fingerprints(places: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """starts (sid, start, width, ...) with fp, the fingerprint of the `width` shingles from `start` on. places: (sid, pos, x).
    Running sums over each document give every window as the difference of two of them, so a window costs the same
    however long it is."""
    lane = 16 if longest < 65536 else 31
    running = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = [x.alias(f"s{k}") for k, x in enumerate(_lanes(F.xxhash64("x"), lane))]
    n = len(lanes)
    sums = places.select("sid", "pos", *lanes).select("sid", "pos", *[F.sum(f"s{k}").over(running).alias(f"s{k}") for k in range(n)])
    ends = sums.select(F.col("sid").alias("end_sid"), F.col("pos").alias("end"), *[F.col(f"s{k}").alias(f"e{k}") for k in range(n)])
    before = sums.select(F.col("sid").alias("before_sid"), F.col("pos").alias("before"), *[F.col(f"s{k}").alias(f"b{k}") for k in range(n)])
    both = starts.join(ends, (F.col("sid") == F.col("end_sid")) & (F.col("start") + F.col("width") - 1 == F.col("end")))
    both = both.join(before, (F.col("sid") == F.col("before_sid")) & (F.col("start") - 1 == F.col("before")), "left")
    less = [F.col(f"e{k}") - F.coalesce(F.col(f"b{k}"), F.lit(0)) for k in range(n)]
    return both.select(*starts.columns, _majority(less, F.col("width"), lane).alias("fp"))


def window_similarities(near: DataFrame, places: DataFrame, shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """near (sid, start, tk) with sim, the weighted similarity of the window and the item: the sum of the smaller counts of
    each shingle over the sum of the larger ones.

    places: (sid, pos, x); shapes: (sid, width, total), the shingles of a window and of an item; counts: (tk, x, c). A
    shingle that an item has c times counts at its place q in those windows that hold q and not the c-th place after it,
    which are an interval of starts; the running sum of the intervals' ends is the shared number of every window.
    """
    pairs = near.select("sid", "tk").distinct().join(shapes, "sid")
    there = places.join(pairs, "sid").join(counts, ["tk", "x"]).groupBy("sid", "tk", "x", "c", "width").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    w = F.col("width")
    spans = F.transform("at", lambda q, j: F.struct((q - w + 1).alias("a"), F.least(q, F.coalesce(F.get("at", j + F.col("c").cast("int")) - w, q)).alias("b")))
    spans = there.select("sid", "tk", F.explode(spans).alias("s")).where("s.a <= s.b")
    ends = spans.select("sid", "tk", F.col("s.a").alias("start"), F.lit(1).alias("d")).unionByName(spans.select("sid", "tk", (F.col("s.b") + 1).alias("start"), F.lit(-1).alias("d")))
    ends = ends.groupBy("sid", "tk", "start").agg(F.sum("d").alias("d"), F.lit(False).alias("asked"))
    asked = near.select("sid", "tk", "start", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("asked"))
    running = Window.partitionBy("sid", "tk").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shared = ends.unionByName(asked).withColumn("both", F.sum("d").over(running)).where("asked").join(shapes, "sid")
    return shared.select("sid", "start", "tk", (F.col("both") / (F.col("width") + F.col("total") - F.col("both"))).alias("sim"))


def _places(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """The columns to keep, pos and h: the hash of the shingle of k words at each place. The hash is an expression over
    generated rows and not over an array, so that it is part of the compiled stage."""
    at = rows.select(*keep, "w", F.posexplode("w").alias("pos", "x")).where(F.col("pos") <= F.size("w") - k)
    return at.select(*keep, F.size("w").alias("n_words"), "pos", F.xxhash64("x", *[F.get("w", F.col("pos") + j) for j in range(1, k)]).alias("h"))


def _starts(hits: Column, least: Column, width: Column, last: Column) -> Column:
    """Structs (lo, hi) of all window starts up to `last` whose `width` places contain at least `least` of the sorted
    places `hits`, without overlaps: those for which hits[j] is the first place in the window."""

    def of(j: Column) -> Column:
        lo = F.greatest(F.lit(0), F.get(hits, j + least - 1) - width + 1, F.coalesce(F.get(hits, j - 1) + 1, F.lit(0)))
        return F.struct(lo.alias("lo"), F.least(F.get(hits, j), last).alias("hi"))

    return F.filter(F.transform(F.when(F.size(hits) >= least, F.sequence(F.lit(0), F.size(hits) - least)), of), lambda x: x["lo"] <= x["hi"])


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, text_md5, item_id, similarity, start, windows): the best window of each leak (the first of equals; start
    counts words from 0) and how many windows reach the threshold."""
    named = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("tk", F.md5(F.array_join("w", " ")))
    named = cut(named)
    m, k = F.size("w"), F.least(F.lit(shingle), F.size("w"))
    texts = named.select("tk", "w", m.alias("m"), k.alias("k")).dropDuplicates(["tk"])
    texts = texts.withColumn("s", shingles(F.col("w"), F.col("k")))
    facts = texts.agg(F.sum(F.size("s")).alias("n"), F.count(F.lit(1)).alias("texts"), F.max("m").alias("longest"), F.collect_set("k").alias("sizes")).first()  # at most `shingle` sizes
    lane = 16 if (facts["longest"] or 0) < 65536 else 32
    texts = cut(texts.withColumn("fp", simhash(F.col("s"), lane)))
    small = F.broadcast if (facts["n"] or 0) <= BROADCAST_SHINGLES else lambda x: x

    # places with a hit, by document and item length; then all windows with enough of them
    base = docs.select("doc_id", F.md5("text").alias("text_md5"), words(F.col("text")).alias("w"))
    hits = None
    for size in sorted(facts["sizes"] or [shingle]):
        known = _places(texts.where(F.col("k") == size), size, "m", "k").select("h", "m", "k").distinct()
        found = _places(base, size, "doc_id", "text_md5").join(small(known), "h").select("doc_id", "text_md5", "n_words", "m", "k", "pos")
        hits = found if hits is None else hits.unionByName(found)
    spots = hits.groupBy("doc_id", "text_md5", "m", "k", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    width = F.least(F.col("n_words"), F.col("m")) - F.col("k") + 1
    least = F.ceil(F.lit(similarity) * (width + F.col("m") - F.col("k") + 1) / (1 + similarity) - 1e-9).cast("int")
    runs = _starts(F.col("hits"), least, width, F.greatest(F.lit(0), F.col("n_words") - F.col("m")))
    spots = spots.select("doc_id", "text_md5", "m", "k", width.alias("width"), runs.alias("runs")).where(F.size("runs") > 0)
    spots = cut(spots.withColumn("sid", F.monotonically_increasing_id()))
    of = spots.select("sid", F.col("doc_id").alias("spot_id"), F.col("text_md5").alias("spot_md5"), "k", F.get("runs", F.lit(0))["lo"].alias("first"), (F.element_at("runs", -1)["hi"] + F.col("width") - 1).alias("last"))
    of = F.broadcast(of) if spots.count() <= BROADCAST_ROWS else of

    # the shingles of the stretches that hold these windows, once for rows that are equal, and the windows' fingerprints
    read = docs.select("doc_id", F.md5("text").alias("text_md5"), "text").join(of, F.col("doc_id").eqNullSafe(F.col("spot_id")) & (F.col("text_md5") == F.col("spot_md5")))
    read = read.select("sid", "k", "first", words(F.col("text")).alias("w"), F.sequence("first", "last").alias("at")).select("sid", "k", "w", F.explode("at").alias("pos"))
    joined = F.concat_ws(" ", *[F.when(F.col("k") > j, F.get("w", F.col("pos") + j)) for j in range(shingle)])
    places = cut(read.select("sid", "pos", joined.alias("x")).repartition("sid").dropDuplicates(["sid", "pos"]))
    starts = spots.select("sid", "m", "width", F.explode("runs").alias("run")).select("sid", "m", "width", F.explode(F.sequence("run.lo", "run.hi")).alias("start"))
    windows = cut(window_fingerprints(places, starts, facts["longest"] or 0).select("sid", "start", "m", "fp"))

    # windows and items meet by the keys of their blocks
    index = texts.select("tk", F.col("fp").alias("item_fp"), F.explode(item_keys(F.col("m"), F.col("fp"), radius, blocks)).alias("key"))
    fan = sum(sum(comb(bits, n) for n in range(r + 1)) for _, bits, r in block_plan(radius, blocks))
    index = F.broadcast(index) if (facts["texts"] or 0) * fan <= BROADCAST_KEYS else index
    looked = windows.withColumn("b", F.explode(window_keys(F.col("m"), F.col("fp"), radius, blocks))).select("sid", "start", "fp", "b.block", "b.key")
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = cut(looked.join(index, "key").where((F.bit_count(differ) <= radius) & first_block(differ, F.col("block"), radius, blocks)).select("sid", "start", "tk"))

    # their words decide
    counts = texts.select("tk", F.explode("s").alias("x")).groupBy("tk", "x").agg(F.count(F.lit(1)).alias("c"))
    shapes = spots.select("sid", "width", (F.col("m") - F.col("k") + 1).alias("total"))
    found = window_similarities(near, places, shapes, counts).where(F.col("sim") >= similarity)
    best = found.groupBy("sid", "tk").agg(F.max(F.struct("sim", (-F.col("start")).alias("at"))).alias("best"), F.count(F.lit(1)).alias("windows"))
    best = best.join(spots.select("sid", "doc_id", "text_md5"), "sid")
    return best.join(small(named.select("tk", "item_id")), "tk").select("doc_id", "text_md5", "item_id", F.round("best.sim", 6).alias("similarity"), (-F.col("best.at")).cast("bigint").alias("start"), "windows")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in whose text a leak is found."""
    (gone,) = fresh(docs, "gone")
    leaks = cut(find_leaks(docs.select("doc_id", "text"), items).select(F.col("text_md5").alias(gone)).distinct())
    side = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return docs.join(side, F.md5(docs["text"]) == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every leak of a benchmark item into a document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(shingle: int = SHINGLE, similarity: float = SIMILARITY) -> str:
    """All windows that share any shingle with the item (others have similarity 0), by counts, without fingerprints."""
    w = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
    s = "list_transform(range(CAST(greatest(len({0}) - {1}, 0) AS BIGINT) + 1), lambda i: array_to_string({0}[i + 1 : i + {1}], ' '))".format
    return f"""
WITH it AS (SELECT item_id, row_number() OVER () AS r, w, len(w) AS m, least({shingle}, len(w)) AS k FROM (SELECT item_id, {w} AS w FROM benchmark) WHERE len(w) > 0),
its AS (SELECT r, item_id, m, k, x, count(*) AS items FROM (SELECT r, item_id, m, k, unnest({s("w", "k")}) AS x FROM it) GROUP BY ALL),
d AS (SELECT doc_id, md5(text) AS text_md5, any_value(w) AS w FROM (SELECT doc_id, text, {w} AS w FROM documents) WHERE len(w) > 0 GROUP BY doc_id, text),
pos AS (SELECT doc_id, text_md5, words, k, unnest(s) AS x, unnest(range(len(s))) AS pos FROM (SELECT doc_id, text_md5, len(w) AS words, k, {s("w", "k")} AS s FROM d, (SELECT DISTINCT k FROM it))),
hit AS (SELECT doc_id, text_md5, r, item_id, x, items, pos, m - k + 1 AS n, least(m, greatest(words, k)) - k + 1 AS wide, greatest(0, words - m) AS last FROM pos JOIN its USING (x, k)),
win AS (SELECT doc_id, text_md5, r, item_id, x, items, n, wide, unnest(range(greatest(0, pos - wide + 1), least(pos, last) + 1)) AS start FROM hit),
per AS (SELECT doc_id, text_md5, r, item_id, n, wide, start, least(count(*), any_value(items)) AS common FROM win GROUP BY doc_id, text_md5, r, item_id, n, wide, start, x),
ok AS (SELECT doc_id, text_md5, r, item_id, start, sum(common) / (n + wide - sum(common)) AS sim FROM per GROUP BY doc_id, text_md5, r, item_id, n, wide, start HAVING sum(common) / (n + wide - sum(common)) >= {similarity})
SELECT doc_id, text_md5, item_id, round(max(sim), 6) AS similarity, CAST(min(start) FILTER (sim = best) AS BIGINT) AS start, count(*) AS windows
FROM (SELECT *, max(sim) OVER (PARTITION BY doc_id, text_md5, r) AS best FROM ok) GROUP BY doc_id, text_md5, r, item_id"""
