import numpy as np

from contentgauge.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def corpus(width=64):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, width))
    rows = [b for b in draw.normal(size=(150, width))]
    for k in range(150):
        b = base[k % 12 if k % 2 else 0]
        rows.append(b + draw.normal(size=width) * np.linalg.norm(b) / np.sqrt(width) * draw.choice([0.05, 0.2, 0.3]))
    rows += [base[1]] * 5 + [3 * base[1], 1e-30 * base[2], 1e30 * base[2], -base[2]]
    return [[float(np.float32(x)) for x in r] for r in rows]


def expected(rows, least=0.95):
    """(links, smallest id of the group) of each row, all pairs compared."""
    ok = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = [np.array(r) / np.abs(r).max() if o else None for r, o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(n, root(k)) for k, n in enumerate(links)]


def test_links_equal_brute_force(frame):
    rows = corpus() + [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] * 64,
                       [1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [2.0], [3.0], [-2.0]]
    df = frame([(k, r, 0, "x") for k, r in enumerate(rows)], SCHEMA)
    for block in (512, 16):  # crowded buckets are cut into blocks
        got = {r.vec_id: r for r in vectors.near_copies(df, block=block).collect()}
        want = expected(rows)
        assert len(got) == len(rows)
        assert [(got[k].n_links, got[k].component_id) for k in range(len(rows))] == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_large_cells(frame, monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.normal(size=64)
    rows = [[float(np.float32(x)) for x in base + draw.normal(size=64) * 0.05] for _ in range(300)]
    got = vectors.near_copies(frame([(k, r, 0, "") for k, r in enumerate(rows)], SCHEMA), block=64).collect()
    want = expected(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, *w) for k, w in enumerate(want)]


def test_recall_at_the_threshold():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    a, b = (vectors.buckets(v, 8, 3, 4) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.999


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)
    assert np.allclose((vectors.hadamard(x) ** 2).sum(1), (x**2).sum(1))


def test_null_ids_and_repeated_rows(frame):
    a = [1.0, 0.0]
    rows = [(None, a, 0, ""), (5, a, 0, ""), (5, a, 0, ""), (None, [0.0, 1.0], 0, "")]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_copies(frame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0, False), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert vectors.near_copies(frame([], SCHEMA)).collect() == []
