"""Mixing at real sizes, and decontamination by long items and by shuffled joins, against brute-force versions."""

import random
from collections import Counter

import pytest

from axolin.llm import decontaminate, mixing


def sizes(n, seed):
    r = random.Random(seed)
    return [min(20 * n, 1 + int(r.lognormvariate(5.5, 1.4))) for _ in range(n)]


@pytest.mark.parametrize("counts", [(50, 50, 50, 50), (500, 60, 120, 49), (5000, 300, 1200)])
def test_targets_are_met_at_real_sizes(spark, counts):
    """Every source comes within its ten smallest documents of its target, or 0.2 % of it."""
    rows, n = [], 0
    for s, count in enumerate(counts):
        for k in sizes(count, s + 11):
            rows.append((n, "x " * k, f"s{s}"))
            n += 1
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    assert len(got) == n and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    for s, count in enumerate(counts):
        of = [r for r in got if r.source == f"s{s}"]
        taken, target = sum(r.taken for r in of), of[0].target
        assert len(of) == count and of[0].source_size == sum(r.size for r in of)
        assert abs(taken - target) <= max(sum(sorted(r.size for r in of)[:10]) / 10, 0.002 * target), (s, taken, target)
        # each document as often as its share, but for one
        share = target / of[0].source_size
        assert all(int(share) <= r.copies <= int(share) + 1 for r in of)


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n)]


def brute(docs, items, limit=0.8, k=5):
    """(doc, item) -> (best similarity, first start of it, windows) by sliding counts, for items of at least k words."""
    out = {}
    for i, item in items.items():
        want, m = Counter(tuple(item[p : p + k]) for p in range(len(item) - k + 1)), len(item)
        for d, doc in docs.items():
            shingles = [tuple(doc[p : p + k]) for p in range(len(doc) - k + 1)]
            width = min(len(doc), m) - k + 1
            have, both = Counter(), 0
            for p, x in enumerate(shingles):
                have[x] += 1
                both += have[x] <= want[x]
                if p >= width:
                    old = shingles[p - width]
                    both -= have[old] <= want[old]
                    have[old] -= 1
                if p >= width - 1:
                    sim = both / (width + m - k + 1 - both)
                    if sim >= limit:
                        best, start, n = out.get((d, i), (0, 0, 0))
                        out[d, i] = (max(best, sim), p - width + 1 if sim > best else start, n + 1)
    return out


def compare(spark, docs, items):
    frame = lambda rows, ddl: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], ddl).repartition(3)
    got = decontaminate.find_leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start, r.windows) for r in got} == {k: (round(s, 6), at, n) for k, (s, at, n) in want.items()}
    return want


def test_long_items(spark):
    r = random.Random(1)
    item = words(r, 2000)
    changed = [w if r.random() > 0.01 else "zz" for w in item]
    docs = {0: words(r, 900) + item + words(r, 1100), 1: words(r, 50) + changed, 2: words(r, 3000), 3: item[:1900], 4: (["a", "b", "c"] * 700)[:2000]}
    assert {k for k, _ in compare(spark, docs, {0: item, 1: ["a", "b", "c"] * 600})} == {0, 1, 3, 4}


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_many_items_of_one_length_by_shuffled_joins(spark, monkeypatch, bound):
    r = random.Random(2)
    items = {k: words(r, 25) for k in range(60)}
    items[60] = items[0]
    docs = {k: words(r, 40) + items[k] + words(r, r.randint(0, 30)) for k in range(0, 60, 7)} | {100: words(r, 300), 101: items[1] + items[2] + items[1]}
    for name in ("BROADCAST_SHINGLES", "BROADCAST_KEYS", "BROADCAST_ROWS"):
        monkeypatch.setattr(decontaminate, name, bound)
    assert len(compare(spark, docs, items)) == 12


def test_repeated_shingles_count_as_often_as_both_have_them(spark):
    item = ["x", "y"] * 12 + ["end"]
    docs = {0: ["x", "y"] * 40, 1: ["x"] * 5 + item + ["y", "x"] * 9, 2: ["x", "y"] * 3, 3: item}
    compare(spark, docs, {0: item})
