"""Statistics of shuffled groups by selection: only what may be the answer is ordered.

A shuffle orders ids by md5(id:shuffle:seed) and gives the first rows of a descriptor to its first
group, the next to the second, and so on. Only the keys of the groups' last rows matter. Keys are even, so
it is known within a few standard errors where such a key lies: rows below that window are counted,
the keys inside are ordered, and the counts tell whether the window held the key. With the borders known,
a row's group is a comparison. The quantile of a group is found the same way, in a window of
values around the quantile of all rows. Many rows may share a window's first or last value (0 above
all): those are only counted, what lies between them are no more rows than the window is wide. Where a
window missed, all are made wider and the step is repeated.

The rows are read twice and their keys made anew, which is cheaper than to keep shuffles x rows. A window
holds a share of the rows that falls with the root of their number. What comes back to the driver are
the borders: shuffles x groups keys, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentgauge.session import cut_lineage, ship

WIDTH = 5.0  # standard errors to both sides
IDS = 64  # rows whose keys are made at once
HELD = 500_000  # keys or values a task holds before it hands them on
GROUPED = 1_000_000  # about as many come together in a task
ROWS_PER_TASK = 20_000
TOP = 2 ** 64 - 1


@dataclass(frozen=True)
class Tested:
    """A descriptor, whether only the share above zero counts, and its groups' sizes in order."""

    name: str
    presence: bool
    sizes: tuple[int, ...]


@dataclass(frozen=True)
class Plan:
    """What the tasks need to know. ``alike[k]``: the first descriptor with the same sizes and the same nulls."""

    tested: tuple[Tested, ...]
    alike: tuple[int, ...]
    permutations: int
    seed: int
    share: float

    def ends(self) -> list[tuple[int, int]]:
        """(descriptor, rows up to the end of a group) of every border to find."""
        return [(k, sum(t.sizes[:g + 1])) for k, t in enumerate(self.tested) if self.alike[k] == k for g in range(len(t.sizes) - 1)]

    def groups(self) -> list[tuple[int, int, int]]:
        """(descriptor, group, size) of every group."""
        return [(k, g, m) for k, t in enumerate(self.tested) for g, m in enumerate(t.sizes)]

    def keys(self, ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the keys, a line per id and a column per shuffle."""
        rest = [f":{p}:{self.seed}".encode() for p in range(self.permutations)]
        raw = b"".join([md5(i.encode() + r).digest() for i in ids for r in rest])
        both = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(ids), self.permutations, 2)
        return both[:, :, 0], both[:, :, 1]


def shuffled_ranges(rows: DataFrame, tested: list[Tested], permutations: int, seed: int, share: float = 1.0 / 3.0) -> DataFrame:
    """(descriptor, perm, rango): the range between groups of the ``share`` quantile, or of the share above zero.

    ``rows``: descriptor, id, value, one row per descriptor and id; null values have no place.
    """
    spark = rows.sparkSession
    ship(spark)
    names = [t.name for t in tested]
    wide = rows.where(F.col("descriptor").isin(names)).groupBy(F.col("id").cast("string").alias("id")).agg(
        *[F.max(F.when(F.col("descriptor") == d, F.col("value"))).alias(f"v{k}") for k, d in enumerate(names)])
    most = max(sum(t.sizes) for t in tested)
    # a row is worth ``permutations`` keys: dealt over all cores however few rows there are
    wide = cut_lineage(wide.repartition(max(spark.sparkContext.defaultParallelism, -(-most // ROWS_PER_TASK))))
    plan = Plan(tuple(tested), _alike(wide, tested), permutations, seed, share)
    width, borders = WIDTH, None
    while borders is None:
        borders = _borders(wide, plan, width)
        width *= 2
    width = WIDTH
    while True:
        found = cut_lineage(_ranges(wide, plan, borders, _windows(wide, plan, width), width))
        if found.where("rango is null").isEmpty():
            return found.select(F.array(*map(F.lit, names))[F.col("k")].alias("descriptor"), "perm", "rango")
        width *= 2


def _alike(wide: DataFrame, tested: list[Tested]) -> tuple[int, ...]:
    """Descriptors of the same group sizes that are null in the same rows share their borders."""
    pairs = [(a, b) for b in range(len(tested)) for a in range(b) if tested[a].sizes == tested[b].sizes]
    if not pairs:
        return tuple(range(len(tested)))
    differ = wide.agg(*[F.max(F.col(f"v{a}").isNull() != F.col(f"v{b}").isNull()).alias(f"d{a}_{b}") for a, b in pairs]).first()
    return tuple(min([a for a, b in pairs if b == k and not differ[f"d{a}_{k}"]], default=k) for k in range(len(tested)))


def _error(share: float, n: int, width: float) -> float:
    return width * float(np.sqrt(share * (1 - share) / n)) + 2 / n


class Held:
    """Counts of (shuffle, column), and codes (shuffle x columns + column) with what goes with them, handed on
    in blocks of shuffles."""

    def __init__(self, permutations: int, columns: int, block: int, *kinds):
        self.columns, self.block, self.kinds = columns, block, kinds
        self.below = np.zeros((permutations, columns), np.int64)
        self.codes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def put(self, perm: np.ndarray, column: int, *parts: np.ndarray) -> None:
        self.codes.append(perm * self.columns + column)
        self.parts.append(parts)
        self.size += len(perm)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size < HELD and not last:
            return
        codes = np.concatenate([np.zeros(0, np.int64), *self.codes])
        parts = [np.concatenate([np.zeros(0, kind), *p]) for kind, p in zip(
            self.kinds, zip(*self.parts) if self.parts else [()] * len(self.kinds), strict=True)]
        of = codes // (self.columns * self.block)
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(-(-len(self.below) // self.block) + 1))
        rows = []
        for b in range(len(cut) - 1):
            own = order[cut[b]:cut[b + 1]]
            below = self.below[b * self.block:(b + 1) * self.block].tobytes() if last else b""
            rows.append((b, below, codes[own].tobytes(), b"".join(p[own].tobytes() for p in parts)))
        self.codes, self.parts, self.size = [], [], 0
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2, 3)],
        ], ["block", "below", "codes", "parts"])


HELD_SCHEMA = "block long, below binary, codes binary, parts binary"


def _together(table: pa.Table, columns: int, *kinds) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(below, codes, parts) of a block."""
    below = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("below") if len(x.as_py()))
    codes, parts = [], [[] for _ in kinds]
    for c, p in zip(table.column("codes"), table.column("parts"), strict=True):
        codes.append(np.frombuffer(c.as_py(), np.int64))
        at, n = 0, len(codes[-1])
        for held, kind in zip(parts, kinds, strict=True):
            held.append(np.frombuffer(p.as_py(), kind, n, at))
            at += n * np.dtype(kind).itemsize
    return np.asarray(below).reshape(-1, columns), np.concatenate(codes), [np.concatenate(p) for p in parts]


def _block(permutations: int, expected: float) -> int:
    """Shuffles that come together in a task, if each brings so many rows."""
    return int(max(1, min(permutations, 64, GROUPED / max(expected, 1.0))))


def _pass(wide: DataFrame, plan: Plan, make: Callable[[], Held], look: Callable) -> DataFrame:
    def run(batches):
        held = make()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            values = [batch.column(f"v{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(plan.tested))]
            for at in range(0, len(ids), IDS):
                look(held, *plan.keys(ids[at:at + IDS]), [v[at:at + IDS] for v in values])
                yield from held.batches()
        yield from held.batches(last=True)

    return wide.mapInArrow(run, HELD_SCHEMA)


def _borders(wide: DataFrame, plan: Plan, width: float) -> np.ndarray | None:
    """Keys of the last rows of all groups but a descriptor's last: (border, shuffle, half of the key). None where
    a window missed."""
    ends = plan.ends()
    spans, expected = [], 0.0
    for k, e in ends:
        n = sum(plan.tested[k].sizes)
        error = _error(e / n, n, width)
        low, high = max(0.0, e / n - error), min(1.0, e / n + error)
        expected += (high - low) * n
        spans.append((np.uint64(min(TOP, int(low * 2 ** 64))), np.uint64(min(TOP, int(high * 2 ** 64)))))
    block = _block(plan.permutations, expected)

    def look(held, high, low, values):
        known = {k: ~np.isnan(values[k]) for k, _ in ends}
        for j, ((k, _), (first, last)) in enumerate(zip(ends, spans, strict=True)):
            h, w = high[known[k]], low[known[k]]
            held.below[:, j] += (h < first).sum(axis=0)
            row, perm = np.nonzero((h >= first) & (h <= last))
            held.put(perm, j, h[row, perm], w[row, perm])

    def select(key, table):
        below, codes, (high, low) = _together(table, len(ends), np.uint64, np.uint64)
        order = np.lexsort((low, high, codes))
        codes, high, low = codes[order], high[order], low[order]
        perms = key[0].as_py() * block + np.arange(len(below))
        want = perms[:, None] * len(ends) + np.arange(len(ends))[None, :]
        start, stop = np.searchsorted(codes, want, "left"), np.searchsorted(codes, want, "right")
        at = start + np.array([e for _, e in ends])[None, :] - below - 1
        sure = bool(((at >= start) & (at < stop)).all())
        keys = np.stack([high[at], low[at]]).tobytes() if sure else b""
        return pa.table([pa.array([key[0].as_py()]), pa.array([sure]), pa.array([keys], pa.binary())], ["block", "sure", "keys"])

    found = _pass(wide, plan, lambda: Held(plan.permutations, len(ends), block, np.uint64, np.uint64), look)
    rows = found.groupBy("block").applyInArrow(select, "block long, sure boolean, keys binary").collect()
    if not all(r["sure"] for r in rows):
        return None
    parts = [np.frombuffer(r["keys"], np.uint64).reshape(2, -1, len(ends)) for r in sorted(rows)]
    return np.concatenate(parts, axis=1).transpose(2, 1, 0)


def _windows(wide: DataFrame, plan: Plan, width: float) -> list[tuple[float, float]]:
    """Per group the values between which its quantile is looked for; any will do, as they are checked."""
    shares = {}
    for k, _, m in plan.groups():
        error = _error(plan.share, m, width)
        shares.setdefault(k, []).extend([plan.share - error, plan.share + error])
    row = wide.agg(*[F.percentile_approx(f"v{k}", [min(1.0, max(0.0, x)) for x in xs], 10_000).alias(f"v{k}") for k, xs in shares.items()]).first()
    out = []
    for k, g, _ in plan.groups():
        low, high = shares[k][2 * g:2 * g + 2]
        out.append((row[f"v{k}"][2 * g] if low > 0 else -np.inf, row[f"v{k}"][2 * g + 1] if high < 1 else np.inf))
    return out


def _ranges(wide: DataFrame, plan: Plan, borders: np.ndarray, windows: list[tuple[float, float]], width: float) -> DataFrame:
    """(k, perm, rango), null where a window missed.

    ``below`` has three columns a group: rows below the window, at its first and at its last value.
    """
    ends, groups, tested = plan.ends(), plan.groups(), plan.tested
    columns = 3 * len(groups)
    expected = sum(min(1.0, 2 * _error(plan.share, m, width)) * m for k, _, m in groups if not tested[k].presence)
    block = _block(plan.permutations, expected)

    def look(held, high, low, values):
        dealt = {}
        for k in sorted(set(plan.alike)):
            known = ~np.isnan(values[k])
            h, w, group = high[known], low[known], np.zeros((int(known.sum()), plan.permutations), np.int8)
            for j, (owner, _) in enumerate(ends):
                if owner == k:
                    top, rest = borders[j, :, 0], borders[j, :, 1]
                    group += (h > top) | ((h == top) & (w > rest))
            dealt[k] = known, group
        for column, ((k, g, _), (first, last)) in enumerate(zip(groups, windows, strict=True)):
            known, group = dealt[plan.alike[k]]
            v = values[k][known]
            if tested[k].presence:
                held.below[:, column] += (group[v > 0] == g).sum(axis=0)
                continue
            for part, which in enumerate((v < first, v == first, (v == last) & (v > first))):
                held.below[:, part * len(groups) + column] += (group[which] == g).sum(axis=0)
            inside = np.flatnonzero((v > first) & (v < last))
            row, perm = np.nonzero(group[inside] == g)
            held.put(perm, column, v[inside][row])

    sizes = np.array([m for _, _, m in groups])
    at = (sizes - 1) * plan.share
    lower, upper = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    presence = np.array([tested[k].presence for k, _, _ in groups])
    owner = np.array([k for k, _, _ in groups])
    firsts, lasts = np.array(windows).T

    def select(key, table):
        counts, codes, (values,) = _together(table, columns, np.float64)
        below, at_first, at_last = np.split(counts, 3, axis=1)
        order = np.lexsort((values, codes))
        codes, values = codes[order], np.append(values[order], np.nan)
        perms = key[0].as_py() * block + np.arange(len(below))
        want = perms[:, None] * columns + np.arange(len(groups))[None, :]
        start, stop = np.searchsorted(codes, want, "left"), np.searchsorted(codes, want, "right")
        between = stop - start

        def value(at):  # null outside the window
            own = at - below - at_first
            listed = values[np.where((own >= 0) & (own < between), start + own, len(codes))]
            found = np.where(own < 0, firsts, np.where(own < between, listed, lasts))
            return np.where(~presence & (at >= below) & (own < between + at_last), found, np.nan)

        x, y = value(lower), value(upper)
        middle = np.where((lower == upper) | (x == y), x, (upper - at) * x + (at - lower) * y)
        stat = np.where(presence, below / sizes, middle)
        out = [[], [], []]
        for k in range(len(tested)):
            mine = owner == k
            wide_ = stat[:, mine].max(axis=1) - stat[:, mine].min(axis=1)
            out[0].append(np.full(len(perms), k, np.int32))
            out[1].append(perms)
            out[2].append(np.rint(wide_ * 1e9) / 1e9)
        k, perm, rango = map(np.concatenate, out)
        return pa.table([pa.array(k), pa.array(perm), pa.array(rango, mask=np.isnan(rango))], ["k", "perm", "rango"])

    found = _pass(wide, plan, lambda: Held(plan.permutations, columns, block, np.float64), look)
    return found.groupBy("block").applyInArrow(select, "k int, perm long, rango double")
