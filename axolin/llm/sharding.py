"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size: start at an offset and step by a
stride, both from the shard's name. Shards take turns; at its turn a shard claims the first slot in its order that is
still free, until no slot is free. Slots are then shared evenly (counts differ by one at most), and when a shard
joins or leaves, few slots change hands. The table is broadcast; placing a row is one hash and one lookup.

The table has as many rows as its size parameter, whatever the data, so its broadcast is bounded. Keys that alone hold
more than one shard's worth of rows are spread: such a key gets ceil(share x shards) positions and its rows choose one
by their row id. At most `shards` keys can be that large, so the list of them is bounded as well.

Defined results: a null key is placed as the empty string, a null row id likewise; repeated rows go to the same place;
an empty table gives an empty result; columns of the input that are named slot or shard (in any case) are replaced, even
where they are the key; all other columns are kept, whatever their names; a long text as a key is hashed whole; of keys
with equally many rows all are spread or none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import fresh, md5_long, quoted, table

SHARDS, SLOTS = 64, 6421
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: int, slots: int) -> tuple[int, int]:
    """(offset, stride) of a shard's permutation of the slots."""
    return _number(f"offset|{shard}") % slots, _number(f"stride|{shard}") % (slots - 1) + 1


def fill_table(shards: int, slots: int) -> list[int]:
    """The shard of each slot. slots must be prime, so that every stride visits all slots."""
    if not 1 <= shards <= slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from {shards} to {MAX_SLOTS}")
    owner, at = [-1] * slots, [preference(s, slots) for s in range(shards)]
    place = [offset for offset, _ in at]
    for turn in range(slots):
        s = turn % shards
        while owner[place[s]] >= 0:
            place[s] = (place[s] + at[s][1]) % slots
        owner[place[s]] = s
    return owner


def lookup_frame(spark: SparkSession, shards: int, slots: int) -> DataFrame:
    """(slot, shard), from one literal."""
    listed = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place_rows(df: DataFrame, key: str, row_id: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard; rows of a key stay together unless the key exceeds one shard's share."""
    k, r, n, total, spread, slot, known, place, shard = fresh(df, "key", "row", "n", "total", "spread", "at", "known", "place", "owner")
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    keyed = df.withColumn(k, text(key)).withColumn(r, text(row_id))
    counts = keyed.groupBy(k).agg(F.count(F.lit(1)).alias(n))
    whole = df.agg(F.count(F.lit(1)).alias(total))
    # one row is joined by broadcast: the total
    hot = counts.join(F.broadcast(whole), F.col(n) * shards > F.col(total)).select(F.col(k).alias(known), F.ceil(F.col(n) * shards / F.col(total)).cast("bigint").alias(spread))
    spread_out = keyed.join(F.broadcast(hot), F.col(k) == F.col(known), "left")
    part = F.pmod(md5_long(F.concat(F.lit("row|"), F.col(r))), F.coalesce(spread, F.lit(1).cast("bigint")))
    placed = spread_out.withColumn(slot, F.pmod(md5_long(F.concat(k, F.lit("#"), part.cast("string"))), F.lit(slots).cast("bigint")))
    owners = lookup_frame(df.sparkSession, shards, slots).select(F.col("slot").alias(place), F.col("shard").alias(shard))
    out = placed.join(F.broadcast(owners), F.col(slot) == F.col(place))
    kept = [quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    return out.select(*kept, F.col(slot).alias("slot"), F.col(shard).alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the shard of every document, keyed by source, hot sources spread by doc_id."""
    return place_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "slot", "shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement over the finished table; filling it is tested against a brute-force version."""
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)".format
    listed = ",".join(map(str, fill_table(shards, slots)))
    return f"""
WITH fill AS (SELECT i - 1 AS slot, CAST(owners[i] AS INTEGER) AS shard FROM (SELECT string_split('{listed}', ',') AS owners), range(1, {slots + 1}) t(i)),
keys AS (SELECT coalesce(source, '') AS k, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1),
hot AS (SELECT k, CASE WHEN n * {shards} > total THEN CAST(ceil(n * {shards} / total) AS BIGINT) ELSE 1 END AS spread FROM keys),
placed AS (
  SELECT doc_id, source, {number("k || '#' || (" + number("'row|' || coalesce(CAST(doc_id AS VARCHAR), '')") + " % spread)")} % {slots} AS slot
  FROM documents JOIN hot ON k = coalesce(source, ''))
SELECT doc_id, source, slot, shard FROM placed JOIN fill USING (slot)"""
