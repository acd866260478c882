import random
import re

import numpy as np
import xxhash

from contentgauge.llm import simhash

SCHEMA = "doc_id long, text string, component_id string"


def fingerprint(text, words=4, lanes=1):
    found = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    out = 0
    for lane in range(lanes):
        hashes = [xxhash.xxh64_intdigest(s, 42 + lane) for s in shingles]
        out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def groups(prints, radius):
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def corpus(n=150):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(200)] + ["É", "ÀB"]
    texts = [None, "", "  \n", "One", "one", "a b c", "A  b\tC", "x " * 5000, "w" * 100_000]
    while len(texts) < n:
        text = draw.choice(texts) if draw.random() < 0.4 else None
        text = text.split() if text and text.split() else [draw.choice(words) for _ in range(draw.randint(1, 150))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            text[draw.randrange(len(text))] = draw.choice(words)
        texts.append(draw.choice([" ", "\n", "  "]).join(text))
    return texts


def test_groups_equal_brute_force(frame, monkeypatch):
    texts = corpus()
    for words, lanes, radius, block in ((4, 1, 4, 32_768), (5, 4, 51, 32_768), (4, 1, 12, 16)):
        monkeypatch.setattr(simhash.near_links, "__defaults__", (block,))
        prints = {k: fingerprint(t, words, lanes) for k, t in enumerate(texts)}
        want = groups(prints, radius)
        got = simhash.near_duplicates(frame([(k, t, "x") for k, t in enumerate(texts)], SCHEMA), words=words, lanes=lanes, radius=radius)
        rows = {r.doc_id: (int.from_bytes(r.fp), r.component_id) for r in got.collect()}
        assert rows == {k: (prints[k], want[k]) for k in prints}
        assert len(set(want.values())) < len(texts) - 20


def test_null_ids_and_repeated_rows(frame):
    rows = [(None, "a b c d e", ""), (7, "a b c d e", ""), (7, "a b c d e", ""), (None, "unlike any other text", "")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(frame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (0, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(frame([], SCHEMA)).collect() == []


def test_one_of_each_group_stays(frame):
    base = " ".join(f"w{k % 97}x{k}" for k in range(200))
    near = base.replace("w3x3 ", "other ")
    df = frame([(3, near, "a"), (1, base, "b"), (2, base, "c"), (9, "nothing in common with them at all", "d")], "doc_id long, text string, fp string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 9}


def test_tiles_skip_nothing_within_the_radius():
    draw, size = random.Random(8), 300
    prints = sorted({draw.getrandbits(64) & draw.getrandbits(64) for _ in range(size)}, key=lambda x: (x.bit_count(), x))
    blob = b"".join(x.to_bytes(8) for x in prints)
    for radius in (8, 14):
        want = {k: v for k, v in groups(dict(enumerate(prints)), radius).items()}
        label = {}
        for member, root in simhash.forest(blob, blob, True, 1, radius):
            label[int.from_bytes(member)] = int.from_bytes(root)
        for k, x in enumerate(prints):
            assert label.get(x, x) == prints[want[k]]


def test_keep_one_with_null_and_shared_ids(frame):
    draw = random.Random(6)
    texts = [" ".join(f"{draw.randrange(10**6)}w" for _ in range(60)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[3]), (4, texts[4]), (4, texts[4])]
    kept = simhash.keep_one(frame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(
        [(0, texts[0]), (0, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[4])])


def spread(draw, n, lanes, flips):
    """Random fingerprints, a crowd around one of them and single copies of others, in order of population count."""
    prints = [draw.getrandbits(64 * lanes) for _ in range(n // 2)]
    for k in range(n - len(prints)):
        x = draw.choice(prints) if k % 3 else prints[0]
        for bit in draw.sample(range(64 * lanes), draw.randint(1, flips)):
            x ^= 1 << bit
        prints.append(x)
    return sorted(set(prints), key=lambda x: (x.bit_count(), x))


def matrix(prints, lanes):
    return simhash._matrix(b"".join(x.to_bytes(8 * lanes) for x in prints), lanes)


def test_parts_join_what_tiles_join():
    draw = random.Random(17)
    for lanes, radius in ((4, 51), (1, 4), (1, 0), (2, 20), (4, 2)):
        prints = spread(draw, 1200, lanes, radius + radius // 6 + 1)
        whole, cut = matrix(prints, lanes), len(prints) // 3
        want = np.arange(len(prints))
        simhash.by_tiles(whole, whole, True, radius, want)
        assert 100 < len(np.unique(want)) <= len(prints) - 50 * (radius > 0)
        for split, size in ((4, 4), (5, 16), (6, 8), (8, 64)):
            got = np.arange(len(prints))
            simhash.by_parts(whole, whole, True, radius, got, split, size)
            assert got.tolist() == want.tolist()
            # two blocks, and each with itself
            both = np.arange(len(prints))
            simhash.by_parts(whole[:, :cut].copy(), whole[:, cut:].copy(), False, radius, both, split, size)
            for k, part in ((0, whole[:, :cut].copy()), (cut, whole[:, cut:].copy())):
                own = np.arange(part.shape[1])
                simhash.by_parts(part, part, True, radius, own, split, size)
                simhash._join(both, np.arange(len(own)) + k, own + k)
            assert both.tolist() == want.tolist()


def test_parts_prove_every_pair_within_the_radius():
    """As many differing bits as the radius, dealt over the lanes and parts as unluckily as can be."""
    for lanes, radius in ((4, 51), (1, 4), (2, 20), (1, 0)):
        for split in simhash.SPLITS:
            parts = simhash._parts(lanes, radius, split)
            assert sum(flips + 1 for _, _, _, flips, _ in parts) == radius + 1
            most = dict((lane, most) for lane, _, _, _, most in parts)
            assert sum(m + 1 for m in most.values()) == radius + 1
            for lane in most:
                assert sum(flips + 1 for x, _, _, flips, _ in parts if x == lane) == most[lane] + 1
            assert all(0 <= first and first + width <= 64 for _, first, width, _, _ in parts)


def test_large_blocks_compare_a_small_share_of_the_pairs(monkeypatch):
    """Unlike fingerprints of two large blocks: few lanes are compared, not all of every pair."""
    draw, seen, count = np.random.default_rng(5), [0], np.bitwise_count
    blocks = [draw.integers(0, 2**64, (4, 100_000), np.uint64, endpoint=False) for _ in range(2)]
    blobs = [x.T.astype(">u8").tobytes() for x in blocks]

    def counted(x, *args, **kwargs):
        seen[0] += x.size
        return count(x, *args, **kwargs)

    monkeypatch.setattr(np, "bitwise_count", counted)
    assert simhash.forest(*blobs, False, 4, 51) == []
    assert seen[0] < 0.25 * 4 * 100_000**2
