"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words: a share of the total by weight, at most max_copies times its own size, the excess
reshared by weight until no target is above its limit (the water level is found in closed form by a running sum over
sources in order of limit / weight). Every document of a source should then be taken x = target / source size times:
floor(x) times for certain, and once more with the fractional probability p.

The fractions are rounded by pivotal steps. Two documents with probabilities p, q and sizes s, t exchange mass so that
s p + t q stays as it is, until one of them is 0 or 1; which way the mass goes is random, with the chances that keep
both expectations. The other one carries the residual to the next step. Within a block of a source (documents are
dealt to blocks of about FAN by a hash) this is a fold from large documents to small ones; the blocks' residuals are
folded again, FAN at a time, up a tree until a source has one residual, which is rounded to the nearer side. That
leaves half a document at most, which may be long. It is then made up for: a few rows of every size class and choice
are taken from the whole source, and from large to small a choice is reversed if that at least halves what is left, and
once more if it lessens it at all; then the pair of them that leaves least. As sizes go down to the source's smallest, so
does what is left, in some twenty reversals at most, however many documents a source has; these rows do not keep exact
odds. No group in the tree has more than about FAN members, however large the source is. Random numbers are hashes of
the document ids and a seed: reruns agree.

Defined results: null text has size 0; documents of size 0 take 0 words; a null source is a source of its own, ordered
last; rows are documents of their own even where doc_id repeats or is null (over FAN rows of a source that are equal in
doc_id and size are dealt to blocks by a number of the row, which depends on how the table is split); ties in size go
by doc_id; long texts are counted whole; an empty table gives an empty result; other input columns, whatever their
names, are ignored by mix_sources and kept by take_copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axolin.llm.common import WORD_CHARS, cut, fresh, hash_fraction, quoted, table

WEIGHTS, MAX_COPIES, SEED = (5, 2, 1), 3, 7
FAN = 48
#: Rows of a source with one choice and sizes from 2**k to 2**(k + 1) - 1 that may be reversed at the end.
CANDIDATES = 4
#: Up to so many sources their targets are broadcast (some 100 bytes each); beyond that they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CHARS)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, docs, target) from (source, size). The windows run over one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_copies).withColumn("total", F.sum("source_size").over(everything))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("full", F.col("cap") * F.sum("w").over(rest) <= (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) * F.col("w"))
    lam = (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)) / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    per = per.withColumn("lam", lam)
    return per.select("source", "source_size", "docs", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("lam")).alias("target"))


_ITEM = "struct<size:bigint,doc_id:{id},p:double,turn:bigint,row:bigint>"
_PICK = "struct<doc_id:{id},size:bigint,row:bigint,pick:int>"


def _fold(items: Column, id_type: str, seed: int) -> Column:
    """struct(done, r): each step decides one of the residual r and the next item; r is what is left at the end."""
    item = _ITEM.format(id=id_type)
    start = F.struct(F.array().cast(f"array<{_PICK.format(id=id_type)}>").alias("done"), F.lit(None).cast(item).alias("r"))

    def made(doc: Column, pick: int) -> Column:
        return F.array(F.struct(doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), doc["row"].alias("row"), F.lit(pick).alias("pick")))

    def left(doc: Column, p: Column) -> Column:
        return F.struct(doc["size"].alias("size"), doc["doc_id"].alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), doc["turn"].alias("turn"), doc["row"].alias("row"))

    def step(acc: Column, e: Column) -> Column:
        r = acc["r"]
        mass = F.struct(
            (r["size"] * (1 - r["p"])).alias("r_up"), (r["size"] * r["p"]).alias("r_down"), (e["size"] * (1 - e["p"])).alias("e_up"), (e["size"] * e["p"]).alias("e_down"),
            hash_fraction(F.lit(seed), r["doc_id"], r["turn"], e["doc_id"], e["turn"]).alias("u"),
        )

        def moved(m: Column) -> Column:
            a, b = F.least(m["r_up"], m["e_down"]), F.least(m["r_down"], m["e_up"])
            up = m["u"] * (a + b) < b
            keep = lambda done, rest: F.struct(F.concat(acc["done"], done).alias("done"), rest.alias("r"))
            return (
                F.when(up & (m["r_up"] <= m["e_down"]), keep(made(r, 1), left(e, e["p"] - a / e["size"])))
                .when(up, keep(made(e, 0), left(r, r["p"] + a / r["size"])))
                .when(m["r_down"] <= m["e_up"], keep(made(r, 0), left(e, e["p"] + b / e["size"])))
                .otherwise(keep(made(e, 1), left(r, r["p"] - b / r["size"])))
            )

        return F.when(r.isNull(), F.struct(acc["done"].alias("done"), e.alias("r"))).otherwise(F.transform(F.array(mass), moved)[0])

    return F.aggregate(items, start, step)


def _turned(picks: Column, over: Column) -> Column:
    """The rows whose choice is reversed: from large to small those that at least halve what is left, then those that
    lessen it at all, then the pair that leaves least, twice. picks is sorted by size, descending."""
    effect = lambda e: F.when(e["pick"] == 1, -e["size"]).otherwise(e["size"])

    def flipped(e: Column, turn: Column) -> Column:
        return F.struct(e["size"].alias("size"), e["h"].alias("h"), e["row"].alias("row"), F.when(turn, 1 - e["pick"]).otherwise(e["pick"]).alias("pick"), e["was"].alias("was"))

    def sweep(picks: Column, over: Column, share: float) -> Column:
        def step(acc: Column, e: Column) -> Column:
            then = acc["over"] + effect(e)
            turn = F.abs(then) < F.abs(acc["over"]) * share
            return F.struct(F.when(turn, then).otherwise(acc["over"]).alias("over"), F.concat(acc["picks"], F.array(flipped(e, turn))).alias("picks"))

        return F.aggregate(picks, F.struct(over.alias("over"), F.slice(picks, 1, 0).alias("picks")), step)

    def best_pair(x: Column) -> Column:
        """(what is left, i, j) of the best pair, if that is less than before."""
        of = lambda a, i: F.transform(F.slice(x["picks"], i + 2, F.size(x["picks"])), lambda b, j: F.struct(F.abs(x["over"] + effect(a) + effect(b)).alias("left"), i.alias("i"), (i + j + 1).alias("j")))
        return F.array_min(F.flatten(F.transform(x["picks"], of)))

    def exchanged(x: Column) -> Column:
        b = x["best"]
        turn = lambda i: F.coalesce((b["left"] < F.abs(x["over"])) & ((i == b["i"]) | (i == b["j"])), F.lit(False))
        change = F.aggregate(F.transform(x["picks"], lambda e, i: F.when(turn(i), effect(e)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, c: a + c)
        return F.struct((x["over"] + change).alias("over"), F.transform(x["picks"], lambda e, i: flipped(e, turn(i))).alias("picks"))

    out = F.transform(F.array(F.struct(over.alias("over"), picks.alias("picks"))), lambda x: sweep(x["picks"], x["over"], 0.5))
    for _ in range(2):
        out = F.transform(out, lambda x: sweep(x["picks"], x["over"], 1.0))
    for _ in range(2):
        out = F.transform(out, lambda x: F.struct(x["over"].alias("over"), x["picks"].alias("picks"), best_pair(x).alias("best")))
        out = F.transform(out, exchanged)
    return F.transform(F.filter(out[0]["picks"], lambda e: e["pick"] != e["was"]), lambda e: e["row"])


def _repaired(decided: DataFrame, certain: DataFrame, seed: int) -> DataFrame:
    """The decided rows with what rounding left made up for. A source's candidates are up to CANDIDATES rows of each size
    (by powers of two) and choice, found by grouped minima of a hash, which combine before they shuffle."""
    words = lambda d: d.select("source", ((F.col("base") + F.col("pick")) * F.col("size")).alias("words"), "target")
    over = words(decided).unionByName(words(certain)).groupBy("source").agg((F.sum("words") - F.max("target")).alias("over"))
    h = F.xxhash64(F.lit(seed + 1), "doc_id", "size")
    one = F.struct("size", h.alias("h"), "row", "pick", F.col("pick").alias("was"))
    found = decided.groupBy("source", F.floor(F.log2("size")).alias("kind"), "pick", F.pmod(h, F.lit(CANDIDATES)).alias("deal")).agg(F.min_by(one, F.struct(h, "row")).alias("one"))
    lists = found.groupBy("source").agg(F.sort_array(F.collect_list("one"), False).alias("picks")).withColumnRenamed("source", "_s")
    turned = lists.join(over, F.col("source").eqNullSafe(F.col("_s"))).select(F.explode(_turned(F.col("picks"), F.col("over"))).alias("_row"))
    turned = cut(turned)
    turned = F.broadcast(turned) if turned.count() <= BROADCAST_SOURCES else turned
    pick = F.when(F.col("_row").isNull(), F.col("pick")).otherwise(1 - F.col("pick"))
    return decided.join(turned, F.col("row") == F.col("_row"), "left").withColumn("pick", pick).drop("_row")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for documents with doc_id, text and source."""
    return _plan(docs, F.monotonically_increasing_id(), weights, max_copies, seed).drop("row")


def _plan(docs: DataFrame, row: Column, weights, max_copies: int, seed: int) -> DataFrame:
    """The mix with the key of each row, which tells rows apart but decides nothing."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.cast("bigint").alias("row")))
    targets = cut(source_targets(sized, weights, max_copies))
    facts = targets.agg(F.count(F.lit(1)).alias("n"), F.max("docs").alias("most")).first()  # two numbers
    side = targets.select(F.col("source").alias("_source"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("docs") / FAN)).cast("bigint").alias("blocks"))
    side = F.broadcast(side) if facts["n"] <= BROADCAST_SOURCES else side
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("base", F.floor(x).cast("int")).withColumn("p", x - F.floor(x))
    fixed = ["source", "source_size", "target", "base"]
    whole = (F.col("size") == 0) | (F.col("p") == 0)
    certain = rows.where(whole).select(*fixed, "doc_id", "size", "row", F.lit(0).alias("pick"))
    item = F.struct("size", "doc_id", "p", F.xxhash64("doc_id", "size").alias("turn"), "row")
    equal = cut(sized.groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_z")).count().where(F.col("count") > FAN).drop("count"))
    equal = equal.withColumn("many", F.lit(True))
    equal = F.broadcast(equal) if equal.count() <= BROADCAST_SOURCES else equal
    open_ = rows.where(~whole).join(equal, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z")), "left")
    number = F.xxhash64(F.lit(seed), "doc_id", "size", F.when(F.col("many"), F.col("row")))
    level = open_.select(*fixed, F.pmod(number, F.col("blocks")).alias("block"), item.alias("item"))
    out, blocks = [], max(1, -(-(facts["most"] or 0) // FAN))
    while True:
        folded = level.groupBy(*fixed, "block").agg(F.sort_array(F.collect_list("item"), False).alias("items")).select(*fixed, "block", _fold(F.col("items"), id_type, seed).alias("f"))
        folded = cut(folded)
        if blocks == 1:
            break
        out.append(folded.select(*fixed, F.explode("f.done").alias("d")).select(*fixed, "d.*"))
        level = folded.select(*fixed, F.floor(F.col("block") / FAN).cast("bigint").alias("block"), F.col("f.r").alias("item"))
        blocks = -(-blocks // FAN)
    r = F.col("f.r")
    last = F.struct(r["doc_id"].alias("doc_id"), r["size"].alias("size"), r["row"].alias("row"), (r["p"] >= 0.5).cast("int").alias("pick"))
    decided = folded.select(*fixed, F.explode(F.concat("f.done", F.array(last))).alias("d")).select(*fixed, "d.*")
    for part in out:
        decided = decided.unionByName(part)
    done = _repaired(cut(decided), certain, seed).unionByName(certain)
    copies = (F.col("base") + F.col("pick")).cast("bigint")
    return done.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", "row")


def take_copies(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs. Rows are told apart by a key that
    is checkpointed with them, so doc_ids may be null or repeated."""
    row, key, copy = fresh(docs, "row", "key", "copy")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = _plan(keyed, F.col(row), weights, max_copies, seed).where("copies > 0").select(F.col("row").alias(key), F.expr("explode(sequence(1, copies))").alias(copy))
    return keyed.join(plan, F.col(row) == F.col(key)).select(*[quoted(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
