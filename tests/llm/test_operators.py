"""The operators on small tables, with nulls, empty and long texts, repeats, clashing columns and empty tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axolin.llm import decontaminate, html_text, licenses, mixing, mpeg, packing, quality, registry, sharding, simhash, suffix_dedup
from axolin.llm.components import connected_components

WORDS = "ab ba cab dad eel fig gnu hen ink jam kit log".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


LEAK = prose(77, 30)
SHARED = prose(78, 60)
ROWS = [
    (0, prose(0, 80), "a"), (1, prose(0, 80), "a"), (2, None, None), (3, "", "b"), (4, "x", "b"), (5, prose(5, 200) + " " + SHARED + " " + prose(6, 50), "a"),
    (6, prose(7, 90) + " " + SHARED, "c"), (7, prose(8, 20) + " " + LEAK + " " + prose(9, 20), "a"), (8, "aaaa" * 100, "a"), (9, prose(10, 4000), "c"), (10, " \n\t ", "a"),
    (11, "Released under the MIT License.\nçé ü", "b"), (None, prose(12, 30), "a"), (13, prose(0, 80) + " end", "a"), (14, LEAK, "a"),
]
EXTRA = "id h fp SLOT shard size component_id copies turn _n places key _key row _row _spread spread _id copy _copy gone _GONE w m k tk start ws text_md5 total owner known place at a.b"
#: Rows that repeat a doc_id, with the same text and others, and rows without one.
REPEATS = [(5, prose(60, 40), "a"), (5, prose(60, 40), "a"), (5, prose(61, 40), "a"), (None, prose(62, 40), "b"), (None, prose(62, 40), "b"), (None, prose(63, 40), "b"), (None, None, None), (6, "", "b"), (6, "", "b")]


def frame(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return d.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit(k).alias(c) for k, c in enumerate(EXTRA.split())])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_registry_lists_every_operator():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(registry.oracle_sql()) <= set(names)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(((-1 if i is None else i, t or "") for i, t, _ in rows)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[None if i < 0 else i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(spark):
    got = suffix_dedup.remove_repeats(frame(spark), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == brute_repeats(ROWS)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_of_many_copies(spark, monkeypatch):
    rows = [(k, prose(k % 4, 60), "a") for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 3)
    got = suffix_dedup.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == brute_repeats(rows)


def test_suffix_dedup_of_repeated_ids(spark):
    """Rows that repeat a doc_id, or have none, are documents of their own, in the order of their texts' digests."""
    long_ = prose(31, 90)
    rows = [(3, long_, "a"), (3, "short", "a"), (3, long_ + " and more", "a"), (None, prose(32, 80), "a"), (None, prose(32, 80), "a"), (None, None, "a"), (4, long_[50:], "a"), (3, long_, "b"), *REPEATS]
    key = lambda r: (-1 if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())
    ordered = sorted(rows, key=key)
    brute = brute_repeats([(k, t, s) for k, (_, t, s) in enumerate(ordered)])
    want = sorted(((ordered[k][0], *v[:4]) for k, v in brute.items()), key=str)
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want


@pytest.mark.parametrize("limit", [0, 400, 1 << 20])
def test_suffix_dedup_of_a_common_line(spark, limit):
    line = prose(90, 18)[:48] + prose(91, 30)[:70]
    rows = [(k, prose(100 + k, 12) + line + prose(200 + k % 7, 30) + line[:90] + prose(300 + k, 9) * (1 + k % 3), "a") for k in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(5), with_text=True, limit=limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == brute_repeats(rows)


def test_near_duplicates(spark):
    got = by_id(simhash.near_duplicates(frame(spark)))
    fps = {i: simhash.fingerprint(t) for i, t, _ in ROWS}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    parent = dict(enumerate(fps))
    ids, group = list(fps), {i: {i} for i in fps}
    for a in ids:
        for b in ids:
            if bin(fps[a] ^ fps[b]).count("1") <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
    assert parent and all(r["component_id"] == min((k for k in group[i] if k is not None), default=None) for i, r in got.items())
    kept = {r.doc_id for r in simhash.keep_one(frame(spark)).collect()}
    assert {0, None} <= kept and 1 not in kept
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [*ROWS, *REPEATS]
    docs = frame(spark, rows)
    component = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(component) >= len(ROWS) + 4
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    left = [(r.doc_id, r.text) for r in left.collect()]
    fp = {t: simhash.fingerprint(t) for _, t, _ in rows}
    group = {}
    for t, f in fp.items():  # fingerprints within 4 bits, joined up
        near = [g for g in group.values() if any(bin(f ^ x).count("1") <= 4 for x in g)]
        whole = {f}.union(*near)
        group |= {x: whole for x in whole}
    groups = {frozenset(g) for g in group.values()}
    assert len(left) == len(groups) and {frozenset(group[fp[t]]) for _, t in left} == groups
    for i, t in left:
        ids = [k for k, x, _ in rows if fp[x] in group[fp[t]] and k is not None]
        assert i == (min(ids) if ids else None)
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_frequent_fingerprints_and_large_components(spark, monkeypatch):
    """Groups far above what one task takes, in many tasks, give the same."""
    rows = [(k, prose(k % 7, 50) + (" more" if k % 3 else ""), "a") for k in range(300)] + REPEATS
    docs = frame(spark, rows)
    want, kept = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str), simhash.keep_one(docs).count()
    monkeypatch.setattr(simhash, "TOGETHER", 2)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want and simhash.keep_one(docs).count() == kept
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want and len(want) == len(rows)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark):
    many = [(k, " ".join(["w"] * (k % 9 + 1)), "abc"[k % 11 % 3] if k % 50 else None) for k in range(900)]
    got = mixing.mix_sources(frame(spark, many)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_sources(frame(spark, many)).collect()}
    assert again == {r.doc_id: r.taken for r in got} and len(got) == 900
    names = sorted({s for _, _, s in many if s}) + [None]
    sizes = {s: sum(k % 9 + 1 for k, _, t in many if t == s) for s in names}
    weight = dict(zip(names, (5, 2, 1, 5), strict=True))
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:  # water filling by rounds
        level = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if level[s] >= 3 * sizes[s]]
        for s in over or open_:
            target[s] = min(level[s], 3 * sizes[s])
        if not over:
            break
        rest -= sum(3 * sizes[s] for s in over)
        open_ -= set(over)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    odd = by_id(mixing.mix_sources(frame(spark)))
    assert odd[2].taken == odd[3].taken == odd[10].taken == 0 and len(odd) == len(ROWS)
    copies = mixing.take_copies(frame(spark))
    assert copies.columns == frame(spark).columns and copies.count() == sum(r.copies for r in mixing.mix_sources(frame(spark)).collect())


def test_copies_of_null_and_repeated_ids(spark):
    from collections import Counter

    rows = [(k, f"a{k} " * (k % 5 + 1), "a") for k in range(40)] + [(None, f"n{k} " * (k % 5 + 1), "a") for k in range(40)] + [(7, f"r{k} " * 3, "b") for k in range(30)]
    plan = mixing.mix_sources(frame(spark, rows)).collect()
    taken = Counter(r.text for r in mixing.take_copies(frame(spark, rows)).collect())
    assert sum(taken.values()) == sum(r.copies for r in plan) and max(taken.values()) <= 3 and set(taken) <= {t for _, t, _ in rows}
    targets = {r.source: r.target for r in plan}
    for s in "ab":
        assert abs(sum(taken[t] * len(t.split()) for _, t, x in rows if x == s) - targets[s]) <= 5


def test_sharding(spark):
    got = sharding.place_rows(frame(spark), "source", "doc_id", 4, 101).collect()
    owner = sharding.fill_table(4, 101)
    assert len(got) == len(ROWS) and all(r.shard == owner[r.slot] for r in got)
    assert len({r.shard for r in got if r.source == "b"}) == 1
    docs = frame(spark, [*ROWS, *REPEATS])
    placed = sharding.place_rows(docs, "source", "doc_id", 4, 101)
    assert placed.columns == [*[c for c in docs.columns if c.lower() not in ("slot", "shard")], "slot", "shard"] and placed.count() == docs.count()
    at = {}
    for r in placed.collect():
        assert at.setdefault((r.source, r.doc_id), r.slot) == r.slot and r["_key"] == EXTRA.split().index("_key")
    assert sharding.place_rows(docs, "shard", "doc_id", 4, 101).count() == docs.count()
    assert sharding.place_rows(frame(spark, []), "source", "doc_id", 4, 101).count() == 0


def test_licenses(spark):
    mit = licenses.KNOWN[0][1].upper().replace("LICENSE", "licence").replace("<YEAR> <HOLDER>", "2020 Someone")
    rows = [*ROWS, (50, mit, "z"), (51, licenses.KNOWN[0][1] + " extra", "z")]
    got = by_id(licenses.scan_licenses(frame(spark, rows)))
    assert got[50].license_id == "MIT" and got[51].license_id is None and got[11].license_id is None
    assert got[11].notices == "MIT" and got[2].n_words == 0 and len(got) == len(rows)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    assert licenses.scan_licenses(frame(spark, [*ROWS, *REPEATS])).count() == len(ROWS) + len(REPEATS)


def test_licenses_in_any_wrapping(spark):
    import textwrap

    whole = [(i, t) for i, t in licenses.KNOWN if len(t) > 200]
    holders = ("Copyright (c) 2020 Someone", "Copyright 1999-2004 by Some One\nAll rights reserved.", "(c) 2001 Another", "© 2020 Someone", "Copyright © Someone", "# Copyright The Project Authors.")
    rows = []
    for n, (i, t) in enumerate(whole):
        for width in (40, 52, 60, 66, 72, 78):
            lines = "\n".join(f"{' * ' * (width == 60)}{x}" for part in t.split("\n") for x in textwrap.wrap(part, width))
            rows.append((len(rows), f"{holders[(n + width) % len(holders)]}\n\n{lines.replace('license', 'licence')}", i))
    rows.append((1000, whole[0][1] + "\nCopyright notice: none.", None))  # words of a text, not a holder's line
    rows.append((1001, "(c) You must retain all notices\n" + whole[0][1], None))
    rows.append((1002, "licence licence license", None))
    rows.append((1003, "License license licence", None))
    got = by_id(licenses.scan_licenses(frame(spark, rows)))
    assert {k: r.license_id for k, r in got.items()} == {k: i for k, _, i in rows}
    assert got[1002].digest == got[1003].digest


def test_digests_of_published_licenses(spark):
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no published texts here")
    ids = {"BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0-Perl", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "GPL": "GPL-3.0", "LGPL": "LGPL-3.0", "GFDL": "GFDL-1.3"}
    texts = licenses.folder_texts(spark, folder, ids)
    assert {tuple(r) for r in licenses.canonical_digests(spark, texts).collect()} >= set(licenses.DIGESTS)
    rows = [(k, t.upper() if k % 2 else "\n".join(x.strip() for x in t.split("\n")), i) for k, (i, t) in enumerate(texts)]
    got = by_id(licenses.scan_licenses(frame(spark, rows)))
    assert all(got[k].license_id == i for k, _, i in rows) and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= {i for _, _, i in rows}


def test_media(spark):
    got = by_id(mpeg.media_features(frame(spark)))
    for i, t, _ in ROWS:
        raw = (t or "").encode()
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(mpeg.pad(raw)), hashlib.sha256(mpeg.pad(raw)).hexdigest())
    media = mpeg.media_column(frame(spark)).select("doc_id", "media").collect()
    assert all(hashlib.sha256(r.media).hexdigest() == got[r.doc_id].media_sha256 for r in media)
    assert mpeg.media_features(frame(spark, [])).count() == 0
    assert mpeg.media_features(frame(spark, [*ROWS, *REPEATS])).count() == len(ROWS) + len(REPEATS)


def test_packing_round_trip(spark):
    rows = packing.pack_documents(frame(spark), row=256, pool=4096).collect()
    vocabulary = open(packing.VOCABULARY, "rb").read()
    assert packing.unpack([r.asDict() for r in rows], vocabulary) == {i: t or "" for i, t, _ in ROWS}
    for r in rows:
        assert len(r.ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 256 and r.position_resets == r.cu_seqlens[:-1]
    assert len({r.row_id for r in rows}) == len(rows)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def brute_leaks(rows, items):
    """Every item-sized window of every document against every item."""
    from collections import Counter

    cut = lambda w, k: [" ".join(w[p : p + k]) for p in range(max(1, len(w) - k + 1))]
    out = {}
    for item, text in items:
        w = (text or "").lower().split()
        k = min(5, len(w))
        for i, t, _ in rows:
            d = (t or "").lower().split()
            if not w or not d:
                continue
            sims = []
            for s in range(max(0, len(d) - len(w)) + 1):
                a, b = Counter(cut(d[s : s + len(w)], k)), Counter(cut(w, k))
                sims.append((sum((a & b).values()) / sum((a | b).values()), -s))
            if max(sims)[0] >= 0.8:
                out[i, hashlib.md5(t.encode()).hexdigest(), item] = (round(max(sims)[0], 6), -max(sims)[1], sum(x >= 0.8 for x, _ in sims))
    return out


def leaks_found(docs, bench):
    got = decontaminate.find_leaks(docs, bench).collect()
    out = {(r.doc_id, r.text_md5, r.item_id): (r.similarity, r.start, r.windows) for r in got}
    assert len(out) == len(got)
    return out


def test_decontamination(spark):
    items = [(1, LEAK), (2, None), (3, "  "), (4, prose(99, 20)), (5, "x"), (6, LEAK.upper()), (7, LEAK + " tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks_found(frame(spark), bench)
    assert got == brute_leaks(ROWS, items) and {(7, 1), (4, 5), (14, 6)} <= {(i, item) for i, _, item in got}
    assert {r.doc_id for r in decontaminate.drop_leaks(frame(spark), bench).collect()} == {i for i, _, _ in ROWS} - {4, 7, 14}
    assert decontaminate.find_leaks(frame(spark), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0


def test_leaks_wherever_their_shingles_stand(spark):
    """Halves and thirds of an item in another order, deep in a document, at its edges, and with words replaced."""
    items = [(k, prose(500 + k, 20 + 3 * k)) for k in range(14)]
    rows = []
    for k, (_, t) in enumerate(items):
        w = t.split()
        half, third = len(w) // 2, len(w) // 3
        for n, x in enumerate((w[half:] + w[:half], w[third:] + w[:third], w[:-3], w[4:] + prose(700 + k, 4).split(), w[: third + 1] + ["zz"] + w[third + 2 :], w + w)):
            before, after = (80 + k, 9) if n % 3 else (0, 0) if k % 2 else (0, 5)
            rows.append((100 * n + k, " ".join([prose(800 + k, before), *x, prose(900 + k, after)]).strip(), "a"))
    want = brute_leaks(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks_found(frame(spark, rows), bench)
    assert len(want) > 40 and any(v[0] < 0.9 and i < 100 for (i, _, _), v in want.items())
    assert set(got) <= set(want) and all(got[x] <= want[x] for x in got)
    assert sum(v[2] for v in got.values()) >= 0.99 * sum(v[2] for v in want.values()) and len(got) >= 0.99 * len(want)


def test_blocks_find_every_pair_within_the_radius():
    r = random.Random(5)
    for radius, blocks in ((19, 6), (4, 4), (3, 5), (12, 5)):
        plan = decontaminate.block_plan(radius, blocks)
        assert [at for at, _, _ in plan][0] == 0 and sum(n for _, n, _ in plan) == 64
        for _ in range(3000):
            differ = sum(1 << b for b in r.sample(range(64), radius))
            assert any(bin(differ >> at & (1 << n) - 1).count("1") <= least for at, n, least in plan)


def test_simhash_of_windows(spark):
    texts = [prose(k, 4 + k) for k in range(30)] + ["a b c d e f"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(decontaminate.shingles(decontaminate.words(F.col("t")), F.lit(5)).alias("s"))
    rows = d.select(F.transform("s", lambda x: F.xxhash64(x)).alias("h"), decontaminate.simhash(F.col("s")).alias("a"), decontaminate.simhash(F.col("s"), 32).alias("b")).collect()
    for r in rows:
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.a == r.b and r.a & (1 << 64) - 1 == want


def test_leaks_of_null_and_repeated_ids(spark):
    clean = prose(401, 40)
    rows = [(None, clean, "a"), (None, prose(400, 3) + " " + LEAK, "a"), (None, None, "a"), (5, clean, "a"), (5, LEAK, "a"), (5, LEAK, "a"), (5, LEAK + " " + clean, "a"), *REPEATS]
    rows += [(9, prose(402, 5) + " " + LEAK[:40] + " " + prose(403 + k, 25), "a") for k in range(6)] + [(9, prose(402, 5) + " " + LEAK, "a")]
    items = [(1, LEAK), (None, LEAK[:100]), (1, prose(62, 40)), (2, LEAK)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).coalesce(1)
    want = brute_leaks(rows, items[:1]) | brute_leaks(rows, items[1:])
    got = leaks_found(docs, bench)
    assert set(got) == set(want) and {(None, 1), (5, 1), (9, 1), (9, 2)} <= {(i, item) for i, _, item in got}
    left = sorted((str(r.doc_id), str(r.text)) for r in decontaminate.drop_leaks(docs, bench).collect())
    assert left == sorted((str(i), str(t)) for i, t, _ in rows if LEAK[:100] not in (t or "") and t != prose(62, 40))
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(1, LEAK), (2, SHARED)], "item_id long, text string")
    want = leaks_found(frame(spark), bench)
    for name in ("BROADCAST_SHINGLES", "BROADCAST_KEYS", "BROADCAST_ROWS"):
        monkeypatch.setattr(decontaminate, name, -1)
    assert want and leaks_found(frame(spark), bench) == want


def test_quality(spark):
    good = [(k, prose(k, 60) + ".", "a") for k in range(150)]
    bad = [(k, " | ".join(prose(k, 60).split()) + " $$$", "b") for k in range(150, 300)]
    docs = frame(spark, good + bad + [(900, None, "a"), (None, "y", "b")])
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(900, None), (None, 1)], "doc_id long, quality int")
    net = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, net, ["doc_id"]).collect()}
    out = [k for k in range(300) if quality.crc_fold(k) == 2]
    assert out and np.mean([(got[k] >= 0.7) == (k < 150) for k in out]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 302
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.score_documents(frame(spark, []), net, ["doc_id"]).count() == 0
    folds = {r[0]: r[1] for r in docs.select("doc_id", quality.held_out(F.col("doc_id"))).collect()}
    assert all(folds[k] == (quality.crc_fold(k) == 2) for k in range(300)) and folds[None] is False
    plain = quality.learn(docs, labels, attention=False)
    mean = {r.doc_id: r.score for r in quality.score_documents(docs, plain, ["doc_id"]).collect()}
    assert np.mean([(mean[k] >= 0.7) == (k < 150) for k in out]) > 0.97


def test_quality_of_repeated_rows(spark):
    """A labelled doc_id teaches with one text for each label, however many rows bear it; each row has its own score."""
    rows = [(k, prose(k, 60) + ".", "a") for k in range(40)] + [(k, " | ".join(prose(k, 60).split()) + " $$$", "b") for k in range(40, 80)]
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)] * 2 + [(3, 0)], "doc_id long, quality int")
    once = quality.training_bags(frame(spark, rows), labels)
    more = quality.training_bags(frame(spark, rows * 3 + REPEATS), labels)
    folds = [k for k in range(80) if quality.crc_fold(k) != 2]
    assert len(once[0]) == len(more[0]) == len(folds) + (3 in folds) and len(quality.training_bags(frame(spark, rows), labels, 10)[0]) == 10
    net = quality.train(*once)
    got = quality.score_documents(frame(spark, rows + REPEATS), net, ["doc_id", "a.b"]).collect()
    assert len(got) == len(rows) + len(REPEATS) and len({r.score for r in got if r.doc_id == 5}) == 3 and got[0]["a.b"] is not None


def test_long_texts_are_scored_in_segments():
    text = prose(1, 400_000)
    parts = list(quality.passage_features(text))
    size = quality.SEGMENT * quality.PASSAGE
    assert len(parts) == -(-len(text) // size) > 1 and sum(map(len, parts)) == -(-len(text) // quality.PASSAGE)
    assert all(p.shape[1] == quality.N_FEATURES and np.isfinite(p).all() for p in parts)
    assert [len(p) for p in quality.passage_features(None)] == [1]


def test_segments_decide_nothing(monkeypatch):
    """Figures and scores of a long text are those of the text read at once."""
    text = " " + prose(2, 30_000) + "  é\n" + "x" * 3000 + " ab ab " * 300
    whole = np.concatenate(list(quality.passage_features(text)))
    monkeypatch.setattr(quality, "SEGMENT", 3)
    parts = list(quality.passage_features(text))
    assert len(parts) > 10 and np.array_equal(np.concatenate(parts), whole)


@pytest.mark.parametrize("name, least", [("sf0.01", 93), ("sf0.1", 985)])
def test_held_out_labels(name, least):
    """Of 94 and 990 held-out labels; attention does no worse than the mean of all passages."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '/root/testdata/{name}/documents.parquet' JOIN '/root/testdata/{name}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL ORDER BY md5(doc_id::VARCHAR)").fetchall()
    bags = [np.concatenate([x.astype(np.float16) for x in quality.passage_features(t)]) for _, t, _ in rows]
    held, label = np.array([quality.crc_fold(i) == 2 for i, _, _ in rows]), np.array([y for _, _, y in rows], float)
    teach, ask = [b for b, h in zip(bags, held, strict=True) if not h], [b for b, h in zip(bags, held, strict=True) if h]
    right = []
    for attention in (True, False):
        net = quality.train(teach, label[~held], attention)
        at = np.cumsum([0] + [len(b) for b in ask[:-1]])
        y = net.forward(np.concatenate([net.encode(b.astype(np.float32)) for b in ask]), at)["y"]
        right.append(int(((y >= quality.THRESHOLD) == (label[held] == 1)).sum()))
    assert right[0] >= least and right[0] >= right[1]


def test_attention_weighs_passages():
    """Bags with one telling passage among many: attention finds it, the mean of all can't do as well."""
    rng = np.random.default_rng(0)

    def bag(label):
        x = rng.normal(0, 1, (40, 6)).astype(np.float32)
        x[:, 0] = 0
        if label and rng.random() < 0.9:
            x[rng.integers(40), 0] = 3
        return x

    y = np.array([k % 2 for k in range(600)], float)
    bags = [bag(v) for v in y]
    at = np.cumsum([0] + [40] * 199)
    right = []
    for attention in (True, False):
        net = quality.train(bags[:400], y[:400], attention)
        f = net.forward(net.encode(np.concatenate(bags[400:])), at)
        right.append(np.mean((f["y"] >= 0.5) == y[400:]))
        if attention:
            told = np.abs(np.concatenate(bags[400:])[:, 0]) > 0
            assert f["p"][told].mean() > 2 * f["p"][~told].mean()
    assert right[0] > 0.85 and right[0] >= right[1]


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello there, this is the text of the page, and it is long enough.</p></article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got[2] == (None, "", 0) and got[None] == ("v", "", 0) and got[1][1].startswith("Hello") and got[1][2] == len(got[1][1])


@pytest.fixture(scope="module")
def small_dir(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("tables"))
    good = [(k, prose(1000 + k, 60 + k % 40) + ".", "ab"[k % 2]) for k in range(120)]
    bad = [(k, " | ".join(prose(k, 60).split()) + " $$$", "b") for k in range(120, 200)]
    copies = [(200 + k, good[k][1], "a") for k in range(10)]
    leaks = [(300 + k, prose(300 + k, 30) + " " + LEAK + ".", "a") for k in range(5)]
    frame(spark, good + bad + copies + leaks).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120)) for k in range(200)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline(spark, small_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    (_, good), (_, one), (_, clean), (_, mixed), (_, packed) = p.STAGES
    a = good(spark, docs, small_dir)
    ids = {r.doc_id for r in a.collect()}
    assert len(ids & set(range(120))) >= 115 and len(ids & set(range(120, 200))) <= 3 and a.columns == docs.columns
    b = one(spark, docs, small_dir)
    assert not {r.doc_id for r in b.collect()} & set(range(200, 210)) and b.columns == docs.columns
    c = clean(spark, docs, small_dir)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in c.collect()} == set(range(300, 305))
    d = mixed(spark, docs, small_dir)
    assert d.columns == docs.columns
    whole = p.run(spark, small_dir).collect()
    found = {i for r in whole for i in r.doc_ids}
    assert found and not found & set(range(200, 210)) and not found & set(range(300, 305))
    tok = packing.tokenizer(open(packing.VOCABULARY, "rb").read())
    stage = docs
    for _, f in p.STAGES[:4]:
        stage = spark.createDataFrame(f(spark, stage, small_dir).collect(), docs.schema)
    assert sum(r.n_ids for r in whole) == sum(len(tok.encode(r.text)) // 2 + 1 for r in stage.collect())


def test_stages_on_odd_rows(spark, small_dir):
    """Nulls, repeats, ties and clashing columns through every stage, and empty tables."""
    import corpus_pipeline as p
    from collections import Counter

    docs = frame(spark, [*ROWS, *REPEATS]).drop("a.b")
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, small_dir)
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert out.columns == docs.columns and set(got) <= set(rows), name
        assert all(n <= rows[k] * (3 if name.startswith("mixing") else 1) for k, n in got.items()), name
        assert stage(spark, docs.limit(0), small_dir).count() == 0, name
    packed = p.STAGES[4][1](spark, docs, small_dir).collect()
    tok = packing.tokenizer(open(packing.VOCABULARY, "rb").read())
    assert sum(r.n_ids for r in packed) == sum(n * (len(tok.encode(t or "")) // 2 + 1) for (_, t), n in rows.items())
    assert {i for r in packed for i in r.doc_ids} == {i for i, _ in rows} and p.STAGES[4][1](spark, docs.limit(0), small_dir).count() == 0


def test_pipeline_stages_read_parquet(spark, small_dir, monkeypatch):
    import corpus_pipeline as p

    seen = []
    step = lambda s, docs, d: seen.append(docs.inputFiles()) or docs.where("doc_id > 0")
    monkeypatch.setattr(p, "STAGES", [("a", step), ("b", step), ("c", step)])
    assert p.run(spark, small_dir).count() == spark.read.parquet(f"{small_dir}/documents.parquet").where("doc_id > 0").count()
    assert all(f and all(x.endswith(".parquet") for x in f) for f in seen) and not set(seen[1]) & set(seen[2])
