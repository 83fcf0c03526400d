"""The methods against brute force, without Spark."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from axolin.llm import boosting, html_text, mpeg, packing, quality, sharding, simhash, suffix_dedup
from axolin.llm.anchors import owned_windows

WORDS = "ab ba cab dad eel fig gnu hen".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("shards,slots", [(1, 2), (3, 7), (5, 101)])
def test_fill_table_is_turn_taking(shards, slots):
    owner = [None] * slots
    wish = [[(o + k * d) % slots for k in range(slots)] for o, d in (sharding.preference(s, slots) for s in range(shards))]
    turn = 0
    while None in owner:
        owner[next(c for c in wish[turn % shards] if owner[c] is None)] = turn % shards
        turn += 1
    assert sharding.fill_table(shards, slots) == owner


def test_fill_table_needs_a_prime():
    with pytest.raises(ValueError):
        sharding.fill_table(2, 9)


def test_golay_keys_meet_at_distance_two():
    errors, filled = simhash._near()
    assert sorted(set(filled.tolist())) == [1, 6]
    x = errors[:, 0]
    a, ok_a = simhash.segment_keys(x)
    for i in range(23):
        for j in range(i, 23):
            b, ok_b = simhash.segment_keys(x ^ (1 << i) ^ (1 << j if j > i else 0))
            assert ((a[:, :, None] == b[:, None, :]) & ok_a[:, :, None] & ok_b[:, None, :]).any(axis=(1, 2)).all()


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n\t", "One", "a b c", "Ä a b C d e", prose(1, 5), prose(2, 900)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_of_runs_connect_what_is_near():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(6))]))
    rows, keys = simhash.fuzzy_keys(fps)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.links_of_runs(keys[order], fps[rows][order])
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert bin(x ^ y).count("1") <= 4
        parent[find(x)] = find(y)
    for i, x in enumerate(fps.tolist()):
        for y in fps[i + 1 :].tolist():
            if bin(x ^ y).count("1") <= 4:
                assert find(x) == find(y)


def test_anchors_are_functions_of_the_window():
    text = (prose(5, 300) + "x" * 150 + prose(5, 300)).encode()
    h, place, first, last = owned_windows(np.frombuffer(text, np.uint8), 8, 30)
    assert first[0] == 0 and last[-1] == len(text) - 30 and (first[1:] == last[:-1] + 1).all()
    seen = {}
    for x, p, a, z in zip(h.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, z + 1):
            assert s <= p <= s + 22
            assert seen.setdefault(text[s : s + 30], (x, p - s)) == (x, p - s)


def test_expanded_intervals_are_common_prefixes():
    r = random.Random(7)
    s = np.array([r.randrange(3) for _ in range(400)] + [9])
    order = suffix_dedup.suffix_order(s, 64)
    common = suffix_dedup.expand_intervals(s[order - 1], 12)
    for k in range(1, len(s)):
        a, b = s[order[k - 1] :].tolist(), s[order[k] :].tolist()
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == (n if n < 12 else -1)


def test_window_classes():
    contexts = [prose(k % 3, 40).encode()[: 110 + k] for k in range(9)]
    of, at, cls = suffix_dedup.window_classes(contexts)
    windows = [contexts[c][a : a + 100] for c, a in zip(of.tolist(), at.tolist(), strict=True)]
    assert len(windows) == sum(len(c) - 99 for c in contexts)
    named = dict(zip(cls.tolist(), windows, strict=True))
    assert all(named[c] == w for c, w in zip(cls.tolist(), windows, strict=True)) and len(named) == len(set(windows))


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_mpeg_round_trip(n):
    text = prose(n, 2000)[:n]
    media, got = mpeg.store_text(text)
    assert got["payload"] == mpeg.pad(text.encode()) and len(got["payload"]) % 192 == 0
    assert got["crc_bad"] == 0 and got["skipped"] == 0 and got["table"]["frames"] == len(got["offsets"]) + 1
    assert got["tags"]["TXXX:n_bytes"] == str(n) and got["samples"] == 1152 * len(got["offsets"])
    assert all(media[o] == 255 for o in got["offsets"])


def test_mpeg_resynchronises_and_sees_damage():
    media, good = mpeg.store_text(prose(3, 600))
    cut = good["offsets"][4]
    got = mpeg.scan_stream(media[:cut] + b"junk\xff\xfajunk" + media[cut:])
    assert got["skipped"] == 10 and len(got["offsets"]) == len(good["offsets"]) and got["payload"] == good["payload"]
    broken = bytearray(media)
    broken[good["offsets"][2] + 10] ^= 1
    assert mpeg.scan_stream(bytes(broken))["crc_bad"] == 1
    assert mpeg.scan_stream(b"")["samples"] == 0


@pytest.mark.parametrize("n", [192, 960])
def test_mpeg_tag_words_within_a_frame(n):
    text = prose(n, 2000)[: n - 103] + "TAG" + prose(5, 200)[:100]
    media, got = mpeg.store_text(text)
    assert media[-128:-125] == b"TAG" and got["payload"] == text.encode() and got["skipped"] == 0
    tag = b"TAG" + bytes(125)
    for tail, skipped in ((tag, 0), (b"\xffjunk" + tag, 5)):
        tagged = mpeg.scan_stream(media + tail)
        assert tagged["payload"] == text.encode() and tagged["skipped"] == skipped
    assert mpeg.scan_stream(b"junk" + mpeg._frames(np.zeros((1, 192), np.uint8)).tobytes() + tag)["samples"] == 1152


def reservoir_stream(parts, channels, crc):
    """Frames of any channels whose main data begin as early as the reservoir of 511 bytes allows: an independent writer
    that lays all main data end to end over the frames' data areas."""
    side, size = (17 if channels == 1 else 32), 144_000 * 64 // 48000
    head = bytes([0xFF, 0xFA if crc else 0xFB, 5 << 4 | 1 << 2, 0xC0 if channels == 1 else 0])
    room = size - 4 - 2 * crc - side
    frames, areas, at = [], [], 0  # at: where the next main data go in the areas laid end to end
    for k, p in enumerate(parts):
        begin = max(at, k * room - 511)
        assert begin + len(p) <= (k + 1) * room
        granules = 2 * channels
        share = [len(p) * 8 // granules] * granules
        share[-1] += len(p) * 8 - sum(share)
        bits = f"{k * room - begin if begin < k * room else 0:09b}" + "0" * (9 if channels == 1 else 11) + "".join(f"{n:012b}" + "0" * 47 for n in share)
        info = int(bits.ljust(side * 8, "0"), 2).to_bytes(side, "big")
        check = int(mpeg.crc16(np.frombuffer(head[2:] + info, np.uint8)[None])[0]).to_bytes(2, "big") if crc else b""
        begin = begin if begin < k * room else k * room
        areas += bytes(max(0, begin + len(p) - len(areas)))
        areas[begin : begin + len(p)] = p
        at = begin + len(p)
        frames.append(head + check + info)
    areas += bytes(len(parts) * room - len(areas))
    return b"".join(f + bytes(areas[k * room : (k + 1) * room]) for k, f in enumerate(frames)), size


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("crc", [0, 1])
def test_mpeg_reservoir(channels, crc):
    r = random.Random(channels)
    parts = [r.randbytes(r.choice((100, 130, 120, 80, 0, 60))) for _ in range(40)]
    media, size = reservoir_stream(parts, channels, crc)
    got = mpeg.scan_stream(media)
    assert got["payload"] == b"".join(parts) and got["lost"] == got["crc_bad"] == got["skipped"] == 0 and len(got["offsets"]) == 40
    # without its first frames, what began in them is lost, and nothing else
    got = mpeg.scan_stream(media[size * 3 :])
    assert b"".join(parts).endswith(got["payload"]) and len(got["payload"]) >= sum(map(len, parts[8:])) and got["lost"] <= 5
    got = mpeg.scan_stream(media[: size * 20] + b"junk" + media[size * 20 :])
    assert got["skipped"] == 4 and got["payload"].startswith(b"".join(parts[:20])) and got["lost"] <= 6


def test_mpeg_reads_any_bytes():
    r = random.Random(11)
    good = [mpeg.store_text(prose(4, 400))[0], reservoir_stream([r.randbytes(90) for _ in range(12)], 2, 1)[0], mpeg._frames(np.full((1, 192), 255, np.uint8)).tobytes()]
    for n in range(1500):
        b = bytearray(r.choice(good))
        for _ in range(r.choice((1, 3, 30))):
            b[r.randrange(len(b))] = r.choice((0, 255, 250, r.randrange(256)))
        b = bytes(b[r.randrange(50) * (n % 3 == 0) : r.randrange(1, len(b)) if n % 2 else len(b)])
        got = mpeg.scan_stream(b)
        assert len(got["payload"]) <= len(b) * 5 and got["skipped"] <= len(b) and len(got["offsets"]) == len(got["lengths"])
    for n in range(400):
        mpeg.scan_stream(r.choice((b"", b"ID3", b"ID3\x04\0\x50", b"\xff\xfa\x64\xc0", b"TAG")) + r.randbytes(r.randrange(300)))
    only = bytearray(mpeg._frames(np.zeros((1, 192), np.uint8)).tobytes())
    only[6 + 2 : 6 + 4] = b"\x3f\xff"  # far more main data than the frame has
    assert mpeg.scan_stream(bytes(only))["lost"] == 1


def test_mpeg_tables():
    frame = bytearray(mpeg._frames(np.zeros((1, 192), np.uint8)).tobytes())
    frame[36:] = (b"VBRI" + bytes(6) + (999).to_bytes(4, "big") + (77).to_bytes(4, "big") + (3).to_bytes(2, "big") + bytes(2) + (2).to_bytes(2, "big") + bytes(2) + b"abcdef").ljust(len(frame) - 36, b"\0")
    got = mpeg.scan_stream(bytes(frame) + mpeg._frames(np.ones((2, 192), np.uint8)).tobytes())
    assert got["table"] == {"frames": 77, "bytes": 999, "toc": b"abcdef"} and len(got["offsets"]) == 2 and got["payload"] == b"\1" * 384


def test_best_fit_decreasing():
    r = random.Random(1)
    sizes = [r.randint(1, 64) for _ in range(300)]
    bins = packing.best_fit_decreasing(sizes, 64)
    free = []
    for i in sorted(range(300), key=lambda k: -sizes[k]):  # the same rule by search over all bins
        fit = [f for f in free if f >= sizes[i]]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - sizes[i])
        else:
            free.append(64 - sizes[i])
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(free)
    assert sorted(i for b in bins for i in b) == list(range(300))


@pytest.mark.parametrize("text", ["", " ", "a  b", "it's 12 o'clock\n\n x\t y ", " a b c", prose(4, 50), " lead", "trail "])
def test_tokenizer_matches_whole_text_encoding(text):
    tok = packing.Tokenizer(open(packing.VOCABULARY, "rb").read())
    assert tok.encode(text) == tok._ids(text) == tok.encode(text)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(9, 5)), np.array([0, 4, 6]), np.array([1.0, 0.0, 1.0])
    net = quality.Bags.start(5, np.zeros(5), np.ones(5), 0.1, True)
    net.w = {k: np.array(w, float) for k, w in net.w.items()}
    loss = lambda: -np.mean(y * np.log(p := net.forward(net.encode(x), at)["y"]) + (1 - y) * np.log(1 - p))
    g = net.gradient(x, at, y)
    for name in ("E", "V", "U", "a", "c"):
        k = tuple(0 for _ in net.w[name].shape)
        old = net.w[name][k]
        net.w[name][k] = old + 1e-5
        up = loss()
        net.w[name][k] = old - 1e-5
        down = loss()
        net.w[name][k] = old
        assert abs((up - down) / 2e-5 - g[name][k]) < 1e-6


def test_quality_features_of_odd_texts():
    for text in (None, "", "\n", "a", "ß" * 2000, "x " * 9000):
        f = np.concatenate(list(quality.passage_features(text)))
        assert f.shape[1] == quality.N_FEATURES and np.isfinite(f).all() and len(f) >= 1
    assert quality.train([], np.zeros(0)).scores(["a", None]).tolist() == [1.0, 1.0]
    assert quality.crc_fold(12) == zlib.crc32(b"12") % 4


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    assert (((boosting.fit(x, y, 30).margin(x) > 0) == (y > 0)).mean()) > 0.95


def test_main_text_of_pages():
    model = html_text.trained()
    right = total = 0
    for seed in range(90_000, 90_150):
        page, want = html_text.page_maker(seed)
        right += html_text.main_texts([page], model)[0] == want
        total += 1
    assert right / total > 0.88
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three &lt;ok&gt;. It goes on for a while, as texts do.<p>Second paragraph of the text, which is longer.</article><footer>&copy; x</footer>"
    assert html_text.main_texts([page, None, "", "<p"], model)[:3] == ["A & B\nOne two three <ok>. It goes on for a while, as texts do.\nSecond paragraph of the text, which is longer.", "", ""]


@pytest.mark.parametrize("head", ["<head><title>t</title><meta charset=utf-8><link href=x><noscript><img src=x></noscript>", "<html><head><script>var a='<p>'</script><title>t</title></html>"])
def test_a_head_without_end_tag_hides_no_text(head):
    body = "<article><h1>A</h1><p>One two three. It goes on for a while, as texts do.<p>Second paragraph of the text, which is longer.</article>"
    model = html_text.trained()
    want = html_text.main_texts(["<head><title>t</title></head><body>" + body], model)
    assert want[0].startswith("A\nOne") and html_text.main_texts([head + body], model) == want
    text = lambda page: [n.text for n in html_text.nodes_of(html_text.parse(page)) if n.text]
    assert text("<head><title>t</title>plain <b>text</b>") == ["plain text"] and text("<head>\n<title>t</title>\n<div>a</div>") == ["a"]
    assert text("<head><title>t</title><template><p>x</p></template></head><p>a") == ["a"]


def test_decoding_is_consistent():
    nodes = html_text.nodes_of(html_text.parse("<div><p>a<p>b</div><ul><li>c<li>d</ul>"))
    kept = html_text.decode(nodes, np.random.default_rng(2).normal(size=len(nodes)))
    assert all(kept[d.up.index] for d, k in zip(nodes, kept, strict=True) if k and d.up is not None)
