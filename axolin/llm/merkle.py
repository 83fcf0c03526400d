"""Merkle manifest of a dataset: one tree of digests for each source, one over their roots, a proof for every row.

Leaves ascend within their source by id; while several nodes of a level remain, every FAN consecutive ones (the last
run may have fewer) are hashed into their parent. The sources' roots, ordered by source, are the leaves of the top tree.

The trees are built by Pregel-style supersteps over RDDs. A vertex is a block of FAN**DEPTH consecutive nodes of a level
and holds the DEPTH levels above them, so only blocks' roots travel: in each superstep children send their digest to
the block above; a block that has its messages hashes them and forwards the digest of its root, until every source is
one node. Then the supersteps run backwards: each block sends every block below it the siblings on the way to the root,
and the lowest blocks hand each leaf its whole path. A superstep shuffles one message for each block, 1/729 of the
nodes; the lowest one shuffles the leaves' digests. No group has more than 729 messages, however large a source is.
Vertices are checkpointed before the next superstep, so a lost executor costs no lineage.

Order: rows are sorted over all partitions by (source, id, digest), ties by a number of the row. A row's place within
its source follows from its place in its partition and from one line for each partition (its first and last source and
how many rows the last one has there), which is all that reaches the driver.

Defined results: null fields hash as `-`; a null source is a source of its own, first; a null id comes first and is
never altered by tampering; rows that repeat an id are leaves of their own, ordered by their digests (equal rows get
different places and proofs); empty and very long texts are hashed whole in the JVM and never shuffled; a lone leaf is
its source's root and a lone source's root is the root, with empty proofs; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from axolin.llm.common import checkpoint_ready, cut, table

FAN, DEPTH = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """The leaf of a row: lowercase hex sha256 of its fields, each as `-` if null, else its length in bytes, `:`, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests: list[str], alone: bool, fan: int = FAN, depth: int = DEPTH) -> list[list[str]]:
    """The levels of a block from its nodes up to its root; a block that is not its tree's only one has depth + 1."""
    out = [digests]
    while len(out[-1]) > 1 or (not alone and len(out) <= depth):
        out.append([_sha("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
    return out


def path(block: list[list[str]], at: int, fan: int = FAN) -> list[str]:
    """For each level of a block, `left.right`: the siblings before and after the node over node `at`, joined."""
    out = []
    for level in block[:-1]:
        first = at - at % fan
        out.append("".join(level[first:at]) + "." + "".join(level[at + 1 : first + fan]))
        at //= fan
    return out


def _settled(rdd: RDD) -> tuple[RDD, int]:
    """The vertices of a superstep, checkpointed, and the greatest number of a block among them."""
    rdd.persist(StorageLevel.MEMORY_AND_DISK)
    rdd.checkpoint()
    last = rdd.map(lambda v: v[0][1]).fold(0, max)
    rdd.unpersist()
    return rdd, last


def _digests(nodes: list) -> list[str]:
    return [n if isinstance(n, str) else n[0] for n in nodes]


def _upward(messages: RDD, tasks: int) -> list[RDD]:
    """Supersteps upward. messages: ((tree, block), (place in the block, node)), where a node is a digest or a tuple that
    begins with one. The result has, for each superstep, ((tree, block), nodes in order)."""
    width, out = FAN**DEPTH, []
    while True:
        vertices, last = _settled(messages.groupByKey(tasks).mapValues(lambda found: [n for _, n in sorted(found, key=lambda m: m[0])]))
        out.append(vertices)
        if last == 0:
            return out
        messages = vertices.map(lambda v: ((v[0][0], v[0][1] // width), (v[0][1] % width, _block(v)[-1][0])))


def _block(vertex: tuple) -> list[list[str]]:
    """The levels of a vertex. Only the first block of a tree can be its only one, and if it is full it makes no
    difference: it has all its levels either way."""
    (_, number), nodes = vertex
    return levels(_digests(nodes), alone=number == 0)


def _downward(steps: list[RDD], messages: RDD, tasks: int) -> RDD:
    """Supersteps downward. messages: ((tree, 0), (proof from there, other values)); the result has the same for the
    lowest blocks, joined to their nodes: ((tree, block), (nodes, (proof, other values)))."""
    width = FAN**DEPTH

    def children(vertex: tuple) -> Iterator[tuple]:
        (tree, number), (nodes, (above, *rest)) = vertex
        block = _block(((tree, number), nodes))
        for k in range(len(nodes)):
            yield (tree, number * width + k), (path(block, k) + above, *rest)

    for vertices in reversed(steps[1:]):
        messages = vertices.join(messages, tasks).flatMap(children)
    return steps[0].join(messages, tasks)


def _places(rows: RDD) -> RDD:
    """((source's number, block), (place in the block, rest of the row)) of sorted rows that begin with their source."""
    width = FAN**DEPTH

    def line(part: int, found: Iterator) -> Iterator[tuple]:
        kinds, here, first, last = 0, 0, None, None
        for row in found:
            if not kinds or row[0] != last:
                kinds, here, last = kinds + 1, 0, row[0]
                first = last if kinds == 1 else first
            here += 1
        if kinds:
            yield part, kinds, here, first, last

    start, tree, held, before = {}, -1, 0, None
    for part, kinds, here, first, last in sorted(rows.mapPartitionsWithIndex(line).collect(), key=lambda x: x[0]):  # one line for each partition
        goes_on = tree >= 0 and first == before
        start[part] = (tree if goes_on else tree + 1, held if goes_on else 0)
        held = here + (held if goes_on and kinds == 1 else 0)
        tree, before = start[part][0] + kinds - 1, last
    starts = rows.context.broadcast(start)

    def number(part: int, found: Iterator) -> Iterator[tuple]:
        tree, rank = starts.value.get(part, (0, 0))
        begun, last = False, None
        for source, *rest in found:
            if begun and source != last:
                tree, rank = tree + 1, 0
            begun, last = True, source
            yield (tree, rank // width), (rank % width, tuple(rest))
            rank += 1

    return rows.mapPartitionsWithIndex(number)


def manifest(leaves: DataFrame) -> DataFrame:
    """(id, leaf, found, subroot, root, proof) of rows (source, id, leaf, found): leaf is a row's recorded digest, found
    what it has now. proof has, from the leaf to the root, `left.right` of each level: the siblings before and after."""
    spark = leaves.sparkSession
    checkpoint_ready(spark)
    slim = cut(leaves.select("source", "id", "leaf", "found", F.monotonically_increasing_id().alias("row")))
    order = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf", "found", "row")]
    rows = cut(slim.orderBy(*order)).select("source", "leaf", "found", "id").rdd
    tasks = max(1, rows.getNumPartitions())
    width = FAN**DEPTH
    steps = _upward(_places(rows), tasks)
    top = _upward(steps[-1].map(lambda v: ((0, v[0][0] // width), (v[0][0] % width, _block(v)[-1][0]))), tasks)
    to_sources = _downward(top, top[-1].map(lambda v: (v[0], ([], _block(v)[-1][0]))), tasks)

    def sources(vertex: tuple) -> Iterator[tuple]:
        (_, number), (subroots, (above, root)) = vertex
        block = _block(((0, number), subroots))
        for k, subroot in enumerate(subroots):
            yield (number * width + k, 0), (path(block, k) + above, subroot, root)

    def proofs(vertex: tuple) -> Iterator[tuple]:
        key, (nodes, (above, subroot, root)) = vertex
        block = _block((key, nodes))
        for k, (leaf, found, name) in enumerate(nodes):
            yield name, leaf, found, subroot, root, path(block, k) + above

    out = _downward(steps, to_sources.flatMap(sources), tasks).flatMap(proofs)
    text = [StructField(c, StringType()) for c in ("leaf", "found", "subroot", "root")]
    schema = StructType([StructField("id", leaves.schema["id"].dataType), *text, StructField("proof", ArrayType(StringType()))])
    return spark.createDataFrame(out, schema, verifySchema=False)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.replace(s, F.lit("."), h), 256))


def verify(proved: DataFrame) -> DataFrame:
    """The rows of manifest() with proof_sha256 (of all siblings, left to right), folded_root and verified."""
    siblings = F.translate(F.array_join("proof", ""), ".", "")
    out = proved.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.col("found"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the decimal id; the given text elsewhere."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaf, roots and proof of every document, held against documents of which some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    now = fields | {"text": tampered(F.col("doc_id"), F.col("text"))}
    leaves = docs.select("source", F.col("doc_id").alias("id"), digest(*fields.values()).alias("leaf"), digest(*now.values()).alias("found"))
    return verify(manifest(leaves)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle(leaf_levels: int = 12, top_levels: int = 6) -> str:
    """The same in SQL, for up to 3**leaf_levels rows of a source and 3**top_levels sources."""
    coded = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(coded(c) for c in (*FIELDS[:-1], text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, codes[(xor(a, b) & 255) + 1])), 4294967295)"
    step = "lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    parts = [
        f"codes AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], {step}) ORDER BY c) codes FROM (SELECT range c FROM range(256)))",
        f"now AS (SELECT *, CASE WHEN ({crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END now FROM documents, codes)",
        f"leaf AS (SELECT doc_id, source, {row('text')} leaf, {row('now')} found FROM now)",
        "f0 AS (SELECT doc_id, leaf, found h, '' p, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 i FROM leaf)",
        "n0 AS (SELECT t, i, leaf d FROM f0)",
    ]

    def climb(name: str, to: str, depth: int) -> None:
        for k in range(depth):
            run = "OVER (PARTITION BY t, i // 3 ORDER BY i ROWS BETWEEN"
            parts.append(f"s{name}{k} AS (SELECT t, i, d, count(*) OVER (PARTITION BY t) m, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') l, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') r FROM n{name}{k})")
            parts.append(f"n{name}{k + 1} AS (SELECT t, i // 3 i, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END d FROM s{name}{k} GROUP BY t, i // 3)")
            parts.append(f"f{name}{k + 1} AS (SELECT f.* REPLACE (f.i // 3 AS i, CASE WHEN m = 1 THEN h ELSE sha256(l || h || r) END AS h, CASE WHEN m = 1 THEN p ELSE p || l || r END AS p) FROM f{name}{k} f JOIN s{name}{k} s ON f.t = s.t AND f.i = s.i)")
        parts.append(f"n{to}0 AS (SELECT 0 t, t i, d FROM n{name}{depth})")
        parts.append(f"f{to}0 AS (SELECT f.* REPLACE (0 AS t, f.t AS i), d up FROM f{name}{depth} f JOIN n{name}{depth} n ON f.t = n.t)")

    climb("", "top", leaf_levels)
    climb("top", "end", top_levels)
    last = f"ftop{top_levels}"
    return "WITH " + ",\n".join(parts[:-2]) + f"\nSELECT doc_id, leaf, up AS subroot, d AS root, sha256(p) AS proof_sha256, h AS folded_root, h = d AS verified FROM {last} f JOIN ntop{top_levels} n ON f.t = n.t"
