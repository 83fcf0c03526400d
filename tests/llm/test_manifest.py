"""The Merkle manifest against a recursive version, with nulls, repeats, large sources and many sources."""

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from axolin.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    (4, "b", "en", 3, "a\nb"), (None, "b", None, None, None), (4, "b", "en", 3, "a\nb"), (4, "b", "en", 3, "c\n"), (0, None, "fr", 0, ""), (7, "é", "en", 2, "çü\n\n"), (1, "", "en", 1, "x"),
    (2, "b", "en", 300_000, "word\n" * 60_000), (None, "b", "en", 1, "-"), (None, None, None, None, None), (9, "Z", None, 5, "\n"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes):
    """The root of some digests, and for each of them (siblings before, siblings after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            first = place - place % 3
            paths[k].append((nodes[first:place], nodes[place + 1 : first + 3]))
            at[k] = place // 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    told = []
    for row in rows:
        text = row[4]
        now = text.replace("\n", "") if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else text
        told.append((row[1], row[0], leaf_of(row, text), leaf_of(row, now)))
    told.sort(key=lambda t: (t[0] is not None, (t[0] or "").encode(), t[1] is not None, t[1] or 0, t[2], t[3]))
    groups = [(s, list(g)) for s, g in groupby(told, key=lambda t: t[0])]
    grown = [tree([t[2] for t in g]) for _, g in groups]
    root, above = tree([g[0] for g in grown])
    out = []
    for (_, rows_), (subroot, paths), rest in zip(groups, grown, above, strict=True):
        for (_, name, leaf, found), own in zip(rows_, paths, strict=True):
            h = found
            for before, after in own + rest:
                h = sha("".join(before) + h + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in own + rest))
            out.append((name, leaf, subroot, root, proof, h, h == root))
    return sorted(out, key=str)


def found(spark, tmp_path, rows, shape=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(shape)
    docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("id", "leaf", "found", "row", "proof", "a.b"))]).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return merkle.query(spark, str(tmp_path))


def test_small_trees_with_odd_rows(spark, tmp_path):
    assert sorted(map(tuple, found(spark, tmp_path, ODD).collect()), key=str) == brute(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_rows(spark, tmp_path, n):
    rows = [(k, "s", "en", 1, f"{k}\n") for k in range(n)]
    assert sorted(map(tuple, found(spark, tmp_path, rows, 1).collect()), key=str) == brute(rows)


def test_more_than_one_block_of_rows_and_of_sources(spark, tmp_path):
    rows = [(k, "hot", "en", k, f"{k}\n{k}") for k in range(2500)] + [(k, "edge", "en", k, "x\n") for k in range(729)]
    rows += [(k, f"s{k:04d}", "en", k, "y\n") for k in range(760)] + [(3, "hot", "en", 3, "3\n3")] * 40
    got = found(spark, tmp_path, rows, 7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_rows(spark, tmp_path):
    empty = found(spark, tmp_path, [])
    assert empty.collect() == []
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_proof_shows_any_other_change(spark):
    rows = spark.createDataFrame([("s", k, sha(str(k)), sha(str(k)) if k != 5 else sha("other")) for k in range(30)], "source string, id long, leaf string, found string")
    assert {r["id"] for r in merkle.verify(merkle.manifest(rows)).where("NOT verified").collect()} == {5}
    proofs = {r["id"]: r["proof"] for r in merkle.manifest(rows).collect()}
    assert proofs[0][0] == "." + sha("1") + sha("2")
    assert proofs[4][0] == sha("3") + "." + sha("5")


def test_sql_says_the_same(spark, tmp_path):
    rows = ODD + [(100 + k, "b", "en", k, f"{k}\n") for k in range(40)]
    got = sorted(map(tuple, found(spark, tmp_path, rows).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.oracle()).fetchall(), key=str) == got
