"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes (the last one is shorter); a label belongs to the bag. Each passage is
described by its own content: hashed words and hashed runs of three characters (BUCKETS each), shares of character
classes, and figures on its words (length, variety and repetition within the passage); no figure is a constant of the
document. A small tanh layer encodes it. A gated
attention (tanh gate times sigmoid gate) gives every passage a weight; the weighted sum of the encodings is scored by
a logistic unit. Attention is learned from document labels alone and finds the passages that decide.

Training uses at most MAX_TRAIN labels, the first ones in the order of a hash of doc_id, and never rows whose crc32 of
doc_id (as text) leaves remainder 2 when divided by 4; those are held out. Labels, lang, source and doc_id are no
inputs of a score. Training is deterministic and done on the driver, whose data is bounded by the labelled rows: all
passages of MAX_TRAIN texts at most, 1.1 kB each. It takes MIN_STEPS steps at least, so that few labels are learned as
well as many. Scoring reads whole texts, a segment of SEGMENT passages at a time, so that its memory doesn't grow with a
text but for 64 bytes a passage. The weights (40 kB) travel with the scoring map, which needs no shuffle.

Defined results: null text is an empty one, whose bag is one empty passage; without labels of both kinds nothing is
learned and every score is 1 (nothing speaks against a document); null labels and doc_ids teach nothing; labels in
contradiction teach both; of rows that repeat a labelled doc_id the one with the least MD5 of its text is learned from,
and each is scored by its own text; a score of the very threshold is accepted; an empty table gives an empty result;
other columns, whatever their names, are ignored by the query and kept by keep_good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import quoted, table

PASSAGE, MAX_TRAIN, THRESHOLD = 512, 6000, 0.7
SEGMENT, BUCKETS = 2048, 256
HIDDEN, GATE, EPOCHS, RATE, DECAY, SEED = 16, 8, 20, 0.01, 5e-3, 5
#: Total passages of a step of gradient descent, and how many steps there are at least, whatever the number of labels.
STEP, MIN_STEPS = 4096, 400

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "quote", "other", "high")


def _classes() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), np.int64)
    for name, chars in (("digit", b"0123456789"), ("space", b" \t"), ("newline", b"\n\r\x0b\x0c"), ("stop", b".?"), ("comma", b",;:"), ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~=+<>\\"), ("quote", b"'\"()[]{}-_/")):
        out[list(chars)] = _KINDS.index(name)
    out[97:123], out[65:91], out[128:] = _KINDS.index("lower"), _KINDS.index("upper"), _KINDS.index("high")
    return out


_CLASS = _classes()
N_FIGURES = len(_KINDS) + 6
N_FEATURES = N_FIGURES + 2 * BUCKETS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def passage_features(text: str | None) -> Iterator[np.ndarray]:
    """For each segment of the whole text an array with one row of N_FEATURES figures for each passage. A passage's figures
    follow from its own bytes alone (words and runs end with it), so segments decide nothing."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for k in range(0, max(1, len(data)), SEGMENT * PASSAGE):
        yield _segment_features(data[k : k + SEGMENT * PASSAGE])


def _hashed(at: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Root shares of the hash buckets of the codes, by passage."""
    counts = np.bincount(at * BUCKETS + (code % BUCKETS), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def _segment_features(data: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(data) // PASSAGE))
    kind = _CLASS[data]
    at = np.arange(len(data)) // PASSAGE
    counts = np.bincount(at * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    size = np.maximum(1, counts.sum(axis=1))
    share = counts / size[:, None]
    blank = (kind == 3) | (kind == 4)
    edge = np.arange(len(data) + 1) % PASSAGE == 0
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])) if len(data) else np.zeros(0, np.int64)
    of = at[starts]
    words = np.bincount(of, minlength=n).astype(float)
    length = np.bincount(of, ends - starts + 1, minlength=n) / np.maximum(1, words)
    marked = np.bincount(of, (kind[ends] > 4) & (kind[ends] < 12), minlength=n) / np.maximum(1, words)
    low = _LOWER[data].astype(np.uint32)
    three = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA6B) ^ low[2:] * np.uint32(0xC2B2AE35) if len(data) > 2 else low[:0]
    own = at[: len(three)] == at[2:] if len(three) else np.zeros(0, bool)
    grams = _hashed(at[: len(three)][own], (three[own] >> np.uint32(13)).astype(np.int64), n)
    again, variety, fresh_ = np.zeros(n), np.zeros(n), np.ones(n)
    if len(starts):
        place = np.maximum(0, np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([[0], starts[1:], [len(data)]]))))
        mix = (low.astype(np.uint64) + np.uint64(257)) * (place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(0x9E3779B97F4A7C15))
        mix ^= mix >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix, dtype=np.uint64)])
        code = total[ends + 1] - total[starts]
        again = np.bincount(of[1:], (code[1:] == code[:-1]) & (of[1:] == of[:-1]), minlength=n) / np.maximum(1, words)
        mark = of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # tells passages apart
        variety = np.bincount(of[np.unique(code ^ mark, return_index=True)[1]], minlength=n) / np.maximum(1, words)
        named = _hashed(of, (code >> np.uint64(40)).astype(np.int64), n)
        if len(code) > 3:
            whole = of[:-3] == of[3:]
            four, where = (code[:-3] * np.uint64(3) ^ code[1:-2] * np.uint64(5) ^ code[2:-1] * np.uint64(7) ^ code[3:] * np.uint64(11))[whole], of[:-3][whole]
            runs = np.bincount(where, minlength=n)
            fresh_ = np.where(runs > 0, np.bincount(where[np.unique(four ^ mark[:-3][whole], return_index=True)[1]], minlength=n) / np.maximum(1, runs), 1.0)
    else:
        named = np.zeros((n, BUCKETS))
    extra = np.stack([np.minimum(length, 40) / 10, marked, again, np.minimum(words, 200) / 100, fresh_, variety], axis=1)
    return np.concatenate([np.sqrt(share), extra, named, grams], axis=1).astype(np.float32)


class Bags:
    """The attention network: passages in, one score for each bag out."""

    def __init__(self, weights: dict[str, np.ndarray] | None, attention: bool = True):
        self.w, self.attention = weights, attention

    @staticmethod
    def start(n_in: int, mean: np.ndarray, scale: np.ndarray, bias: float, attention: bool) -> Bags:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b: rng.normal(0, a**-0.5, (a, b)).astype(np.float32)
        return Bags({"E": draw(n_in, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(100, GATE)[0], "c": draw(100, HIDDEN)[0], "b": np.float32(bias), "mean": mean, "scale": scale}, attention)

    def encode(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return np.tanh((x - w["mean"]) / w["scale"] @ w["E"] + w["e"])

    def forward(self, h: np.ndarray, at: np.ndarray) -> dict:
        """h: encoded passages; at: the first passage of each bag. Without attention all passages weigh the same."""
        w = self.w
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (t * g) @ w["a"] * self.attention
        sizes = np.diff(np.append(at, len(h)))
        bag = np.repeat(np.arange(len(at)), sizes)
        p = np.exp(s - np.maximum.reduceat(s, at)[bag])
        p /= np.add.reduceat(p, at)[bag]
        m = np.add.reduceat(h * p[:, None], at, axis=0)
        y = 1 / (1 + np.exp(-np.clip(m @ w["c"] + w["b"], -30, 30)))
        return {"t": t, "g": g, "p": p, "m": m, "y": y, "bag": bag}

    def gradient(self, x: np.ndarray, at: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.w, self.encode(x)
        f = self.forward(h, at)
        d = (f["y"] - label) / len(label)
        dm = d[:, None] * w["c"]
        dmb = dm[f["bag"]]
        dp = (dmb * h).sum(axis=1)
        ds = f["p"] * (dp - np.add.reduceat(f["p"] * dp, at)[f["bag"]]) * self.attention
        dt, dg = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = dmb * f["p"][:, None] + dt @ w["V"].T + dg @ w["U"].T
        dz = dh * (1 - h**2)
        return {"E": ((x - w["mean"]) / w["scale"]).T @ dz, "e": dz.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["m"].T @ d, "b": d.sum()}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The scores of whole texts."""
        if self.w is None:
            return np.ones(len(texts))
        bags = [[self.encode(x) for x in passage_features(t)] for t in texts]
        if not bags:
            return np.zeros(0)
        at = np.cumsum([0] + [sum(map(len, b)) for b in bags[:-1]])
        return self.forward(np.concatenate([h for b in bags for h in b]), at)["y"].astype(float)


def train(bags: list[np.ndarray], labels: np.ndarray, attention: bool = True) -> Bags:
    """Adam over shuffled steps; the same input gives the same weights."""
    if len(set(labels.tolist())) < 2:
        return Bags(None)
    size = np.array([len(b) for b in bags])
    total = sum(b.sum(axis=0, dtype=float) for b in bags) / size.sum()
    spread = np.sqrt(np.maximum(0, sum((b.astype(np.float32) ** 2).sum(axis=0, dtype=float) for b in bags) / size.sum() - total**2))
    net = Bags.start(bags[0].shape[1], total.astype(np.float32), (spread + 0.05).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean()))), attention)
    names = ("E", "e", "V", "U", "a", "c", "b")
    m, v = ({k: np.zeros_like(net.w[k]) for k in names} for _ in range(2))
    rng, k = np.random.default_rng(SEED), 0
    labels = labels.astype(np.float32)
    step = int(min(STEP, max(256, size.sum() // 8)))
    epochs = max(EPOCHS, -(-MIN_STEPS * step // int(size.sum())))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // step)) + 1
        for part in np.split(order, cuts):
            g = net.gradient(np.concatenate([bags[i] for i in part]).astype(np.float32), np.cumsum(np.append(0, size[part][:-1])), labels[part])
            k += 1
            for n in names:
                grad = g[n] + np.float32(DECAY) * net.w[n]
                m[n] = np.float32(0.9) * m[n] + np.float32(0.1) * grad
                v[n] = np.float32(0.999) * v[n] + np.float32(0.001) * grad**2
                net.w[n] = net.w[n] - np.float32(RATE * (1 - epoch / epochs) / (1 - 0.9**k)) * m[n] / (np.sqrt(v[n] / np.float32(1 - 0.999**k)) + np.float32(1e-8))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and labels of at most max_train labelled texts of the training folds."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = usable.select("doc_id", "quality", F.md5(F.col("doc_id").cast("string")).alias("turn")).orderBy("turn", "doc_id", "quality").limit(max_train)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bags = []
            for t in b["text"]:
                bags.append(np.concatenate([x.astype(np.float16) for x in passage_features(t)]).tobytes())
            yield pd.DataFrame({"turn": b["turn"], "quality": b["quality"], "bag": bags})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("turn", "doc_id", "quality").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")).alias("least"))
    got = one.select("turn", "quality", "least.text").mapInPandas(run, "turn string, quality int, bag binary")
    # rows go into arrays of some MB as they come, which are freed as a whole
    chunks, loose, held, found = [], [], 0, []
    for r in got.toLocalIterator():
        loose.append(np.frombuffer(r.bag, np.float16).reshape(-1, N_FEATURES))
        found.append((r.turn, r.quality, len(chunks), held, held + len(loose[-1])))
        held += len(loose[-1])
        if held >= STEP:
            chunks.append(np.concatenate(loose))
            loose, held = [], 0
    if loose:
        chunks.append(np.concatenate(loose))
    found.sort()
    return [chunks[c][i:j] for _, _, c, i, j in found], np.array([q for _, q, *_ in found], float)


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, attention: bool = True) -> Bags:
    """The network, from at most max_train labelled texts of the training folds."""
    return train(*training_bags(docs, labels, max_train), attention)


def _scores(net: Bags, texts: pa.Array) -> np.ndarray:
    """The scores of a batch, 64 documents at a time."""
    parts = [net.scores(texts[k : k + 64].to_pylist()) for k in range(0, len(texts), 64)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_documents(docs: DataFrame, net: Bags, keep: list[str]) -> DataFrame:
    """The columns in keep (from docs) and score; a map without a shuffle."""
    given = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *kept, text = b.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array(_scores(net, text), pa.float64())], [*b.schema.names[:-1], "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema[:-1])
    return given.mapInArrow(run, f"{kinds}, score double").toDF(*keep, "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under the threshold; the text passes through the same map that scores it."""
    net, at = learn(docs, labels), docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(net, b.column(at)) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, net, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
