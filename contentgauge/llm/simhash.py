"""Near copies of documents by SimHash, compared tile by tile.

Fingerprints of a document's word shingles are compared exactly: distinct fingerprints
are dealt into blocks of one population count, every pair of blocks whose counts lie
within the radius meets in one task, and numpy takes exclusive-or and bit counts over
small tiles. A task returns a forest over what it links, never all pairs of a group.

A fingerprint is cut into parts of 8 to 16 bits. Two within the radius must differ in very few bits of one
part, and no more than a lane's share in the lane that holds it, so only buckets of a part whose values are that
near are compared, and of these one lane. Nothing within the radius is missed. Where blocks are too small for that, whole
tiles are compared.

The comparison stays quadratic in the number of distinct fingerprints, for 256 bits and 51 with one lane of 15 to 30 % of
the pairs (five or six parts a lane, rows not filled up); exact copies are folded first and cost nothing.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.llm.common import components, store

SEED = 42
BLOCK = 32_768
GROUP = 262_144  # fingerprints that come to a task from either side
TILE = (128, 2_048)
SPLITS = (4, 5, 6, 8)  # parts that a lane may be cut into
ROWS = (4, 8, 16, 32, 64)  # fingerprints of a bucket that are compared at once
PENDING = 1 << 16  # links that are joined at once


def fingerprint(text: bytes | None, words: int, lanes: int) -> bytes:
    """SimHash of the ``words``-word shingles, ``lanes`` x 64 bits, most significant first.

    A-Z are lower-cased, words end at ASCII white space. Fewer words than a shingle has
    form one shingle; no word gives zeros, and so does null.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return bytes(8 * lanes)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(tokens))
    first, last = (ends - lengths)[: len(tokens) - size + 1].tolist(), ends[size - 1:].tolist()
    out = []
    for lane in range(lanes):
        digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
        for at in range(0, len(first), BLOCK):
            span = zip(first[at:at + BLOCK], last[at:at + BLOCK], strict=True)
            hashes = b"".join([digest(joined[a:b], SEED + lane) for a, b in span])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(first)).tobytes())
    return b"".join(out)


def with_fingerprint(df: DataFrame, text: str, words: int = 4, lanes: int = 1, name: str = "fp") -> DataFrame:
    """Add the fingerprint (binary) and ``<name>_ones``, its population count."""

    @F.arrow_udf("struct<fp: binary, ones: int>")
    def marks(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, words, lanes) for t in texts.cast(pa.large_binary()).to_pylist()]
        ones = [int.from_bytes(f).bit_count() for f in found]
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(ones, pa.int32())], ["fp", "ones"])

    marked = df.withColumn("_fp", marks(F.col(text)))
    return marked.withColumns({name: F.col("_fp.fp"), f"{name}_ones": F.col("_fp.ones")}).drop("_fp")


def _matrix(blob: bytes, lanes: int) -> np.ndarray:
    return np.frombuffer(blob, ">u8").astype(np.uint64).reshape(-1, lanes).T.copy()


def _parts(lanes: int, radius: int, split: int) -> list[tuple[int, int, int, int, int]]:
    """(lane, first bit, width, flips, most): two fingerprints within the radius differ, in one of these parts, in no more than
    ``flips`` bits, and in no more than ``most`` of its lane. Else every part would differ in a bit more, which makes radius + 1."""
    each, more = divmod(radius + 1, lanes * split)
    shares = [[each + (k * lanes + lane < more) for k in range(split)] for lane in range(lanes)]
    edges = [64 * k // split for k in range(split + 1)]
    return [(lane, edges[k], edges[k + 1] - edges[k], shares[lane][k] - 1, sum(shares[lane]) - 1)
            for lane in range(lanes) for k in range(split) if shares[lane][k]]


def _plan(n: int, m: int, lanes: int, radius: int) -> tuple[int, int]:
    """(parts of a lane, fingerprints of a row) that need the fewest steps; no parts: tiles of all pairs."""
    best, found = float(lanes * n * m), (0, 0)
    for split in SPLITS:
        for size in ROWS:
            work = 0.0
            for _, _, width, flips, _ in _parts(lanes, radius, split):
                rows, others = (k / size + 0.5 * min(k, 1 << width) for k in (n, m))
                probes = sum(comb(width, k) for k in range(flips + 1))
                # rows looked up, pairs of rows fetched and compared, both sides put in order
                work += probes * (20 * rows + rows * others / (1 << width) * (size * size + 8 * size + 50) + 50_000) + 300 * (n + m)
            if work < best:
                best, found = work, (split, size)
    return found


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the groups of every a and b one; a group's label is its first member."""
    while len(a):
        p, q = label[a], label[b]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label[:] = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _rows(words: np.ndarray, first: int, width: int, size: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each row, first row of each value, members of each row): rows of ``size`` with one value of a part, groups side
    by side; what a row lacks is its first member again."""
    value = (words >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
    order = np.lexsort((label, value))
    counts = np.bincount(value, minlength=1 << width)
    ends, rows = np.cumsum(counts), -(-counts // size)
    start = np.concatenate([[0], np.cumsum(rows)])
    of = np.repeat(np.arange(1 << width), rows)
    begin = (ends - counts)[of] + (np.arange(len(of)) - start[of]) * size
    at = begin[:, None] + np.arange(size)
    return of, start, order[np.where(at < ends[of][:, None], at, begin[:, None])]


def _differ(every: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints i and j differ."""
    return np.bitwise_count(every[:, i] ^ every[:, j]).sum(axis=0, dtype=np.int64)


def _led(every: np.ndarray, lane: int, first: int, width: int, radius: int, label: np.ndarray) -> None:
    """Join every fingerprint with the first of its bucket, if near: large groups are one before they are paired."""
    value = every[lane] >> np.uint64(first) & np.uint64((1 << width) - 1)
    order = np.argsort(value, kind="stable")
    lead = order[np.searchsorted(value[order], value)]
    member = np.flatnonzero(label != label[lead])
    near = member[_differ(every, member, lead[member]) <= radius]
    _join(label, near, lead[near])


def by_parts(left: np.ndarray, right: np.ndarray, same: bool, radius: int, label: np.ndarray, split: int, size: int) -> None:
    """Join what lies within the radius, comparing buckets of parts that may hold it."""
    lanes, n = left.shape
    every, shift = (left, 0) if same else (np.concatenate([left, right], axis=1), n)
    pairs = max(1, TILE[0] * TILE[1] // size**2)
    bits, count = (np.empty(pairs * size * size, kind) for kind in (np.uint64, np.uint8))
    for lane, first, width, flips, most in _parts(lanes, radius, split):
        _led(every, lane, first, width, radius, label)
        of, start, items = _rows(left[lane], first, width, size, label[:n])
        o_of, o_start, others = (of, start, items) if same else _rows(right[lane], first, width, size, label[n:])
        others = others + shift
        words, o_words = every[lane][items], every[lane][others]
        links, waiting = [], 0

        def one(members):  # label of rows that hold one group, -1 for others
            found = label[members]
            return np.where((found == found[:, :1]).all(axis=1), found[:, 0], -1)

        def joined():
            _join(label, *(np.concatenate(side) for side in zip(*links, strict=True)))
            links.clear()
            return one(items), one(others)

        group, o_group = one(items), one(others)
        for flip in (sum(1 << k for k in bit) for some in range(min(flips, width) + 1) for bit in combinations(range(width), some)):
            rows = np.flatnonzero(of < of ^ flip) if same and flip else np.arange(len(of))
            low = o_start[of[rows] ^ flip]
            ends = np.cumsum(o_start[(of[rows] ^ flip) + 1] - low)
            at = 0
            while at < len(rows):  # rows that meet a bounded number of others
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + (1 << 20), side="right")))
                met = np.diff(ends[at:stop], prepend=done)
                i = np.repeat(rows[at:stop], met)
                j = np.arange(len(i)) + np.repeat(low[at:stop] - (ends[at:stop] - met - done), met)
                at = stop
                apart = (group[i] != o_group[j]) | (group[i] < 0)
                if same and not flip:
                    apart &= i <= j
                i, j = i[apart], j[apart]
                for k in range(0, len(i), pairs):
                    x, y = i[k:k + pairs], j[k:k + pairs]
                    # one inner loop runs over all pairs of rows
                    b, c = (space[:len(x) * size * size] for space in (bits, count))
                    b = b.reshape(size, size, -1)
                    np.bitwise_xor(words[x].T.copy()[:, None], o_words[y].T.copy()[None], out=b)
                    np.bitwise_count(b, out=c.reshape(b.shape))
                    hit = np.flatnonzero(c <= most)
                    if not len(hit):
                        continue
                    place, pair = np.divmod(hit, len(x))
                    p, q = items[x[pair], place // size], others[y[pair], place % size]
                    new = label[p] != label[q]
                    p, q = p[new], q[new]
                    near = _differ(every, p, q) <= radius
                    if near.any():
                        links.append((p[near], q[near]))
                        waiting += len(links[-1][0])
                    if waiting > PENDING:
                        (group, o_group), waiting = joined(), 0
        if links:
            joined()


def by_tiles(left: np.ndarray, right: np.ndarray, same: bool, radius: int, label: np.ndarray) -> None:
    """Join what lies within the radius, comparing all pairs.

    The blocks are in order of population count; tiles whose counts lie too far apart are skipped.
    """
    lanes, n = left.shape
    m, shift, (high, wide) = right.shape[1], 0 if same else n, TILE
    ones, others = (np.bitwise_count(x).sum(axis=0, dtype=np.int64) for x in (left, right))
    bits, count, total = (np.empty((high, wide), kind) for kind in (np.uint64, np.uint8, np.uint16))
    for i in range(0, n, high):
        for j in range(i // wide * wide if same else 0, m, wide):
            h, w = min(high, n - i), min(wide, m - j)
            if others[j] - ones[i + h - 1] > radius or ones[i] - others[j + w - 1] > radius:
                continue
            x, c, t = bits[:h, :w], count[:h, :w], total[:h, :w]
            for lane in range(lanes):
                np.bitwise_xor(left[lane, i:i + h, None], right[lane, None, j:j + w], out=x)
                np.bitwise_count(x, out=c)
                if lanes > 1:
                    np.copyto(t, c) if lane == 0 else np.add(t, c, out=t)
            near = c if lanes == 1 else t
            if same:
                near[np.arange(h)[:, None] + i >= np.arange(w) + j] = 255 if lanes == 1 else 65_535
            if near.min() > radius:
                continue
            hit = near <= radius
            for row in np.flatnonzero(hit.any(axis=1)):
                met = np.flatnonzero(hit[row]) + j + shift
                groups = np.unique(np.append(label[met], label[i + row]))
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]


def forest(a: bytes, b: bytes, same: bool, lanes: int, radius: int) -> list[tuple[bytes, bytes]]:
    """(member, root) of what two blocks of fingerprints link within ``radius``."""
    left, right = _matrix(a, lanes), _matrix(b, lanes)
    n, m = left.shape[1], right.shape[1]
    label = np.arange(n if same else n + m)
    split, rows = _plan(n, m, lanes, radius)
    if split:
        by_parts(left, right, same, radius, label, split, rows)
    else:
        by_tiles(left, right, same, radius, label)
    size = 8 * lanes

    def at(k):
        return a[k * size:(k + 1) * size] if k < n else b[(k - n) * size:(k - n + 1) * size]

    return [(at(k), at(label[k])) for k in np.flatnonzero(label != np.arange(len(label))).tolist()]


def near_links(marks: DataFrame, fp: str, lanes: int, radius: int, block: int = GROUP) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``radius`` bits of each other."""
    width = max(1, radius // 4)
    distinct = marks.select(F.col(fp).alias("fp"), F.col(f"{fp}_ones").alias("ones")).distinct()
    distinct = distinct.withColumn("class", F.floor(F.col("ones") / width).cast("int"))
    # one row for each class of population counts: 64 x lanes + 1 at most
    counts = distinct.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    spark = marks.sparkSession
    classes = spark.createDataFrame([(r["class"], -(-r["n"] // block)) for r in counts], "class int, parts long")
    dealt = distinct.join(F.broadcast(classes), "class").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))

    def pack(rows: pa.Table) -> pa.Table:
        blob = b"".join(rows.sort_by([("ones", "ascending"), ("fp", "ascending")])["fp"].to_pylist())
        return pa.table({"class": rows["class"][:1], "part": rows["part"][:1], "fps": pa.array([blob], pa.binary())})

    dealt = dealt.select("class", "part", "fp", "ones")
    blocks = store(dealt.groupBy("class", "part").applyInArrow(pack, "class int, part long, fps binary"), "blocks")
    gap = F.col("o_class") - F.col("class")
    near = (gap >= 0) & ((gap - 1) * width < radius)

    def dealt_to(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))

    # both sides of a pair of blocks go where the pair is hashed to, so pairs are dealt evenly
    other = classes.select(F.col("class").alias("o_class"), "parts")
    left = blocks.join(F.broadcast(other), near).withColumn("o_part", dealt_to(F.col("parts"))).where((gap > 0) | (F.col("part") <= F.col("o_part")))
    right = blocks.select(F.col("class").alias("o_class"), F.col("part").alias("o_part"), F.col("fps").alias("o_fps"))
    right = right.join(F.broadcast(classes), near).withColumn("part", dealt_to(F.col("parts"))).where((gap > 0) | (F.col("part") <= F.col("o_part")))
    same = (F.col("class") == F.col("o_class")) & (F.col("part") == F.col("o_part"))
    pairs = left.drop("parts").join(right.drop("parts"), ["class", "part", "o_class", "o_part"]).select("fps", "o_fps", same.alias("same"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = forest(*[batch[c][k].as_py() for c in ("fps", "o_fps", "same")], lanes, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[side] for x in found], pa.binary()) for side in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(compare, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1, radius: int = 4,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: its fingerprint and the smallest id of its group.

    Two documents link when their fingerprints differ in ``radius`` bits or fewer; groups
    are what links connect. Null and empty texts have the fingerprint zero and link like any
    other. Rows with a null id take part; a group of null ids only has a null component.
    """
    marks = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = store(with_fingerprint(marks, "text", words, lanes).drop("text"), "fingerprints")
    roots = components(near_links(marks, "fp", lanes, radius))
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "fp"))
    groups = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    members = nodes.join(groups, "root").select("fp", "component_id")
    return marks.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, lanes: int = 4, radius: int = 51) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id (null last); all columns stay.

    Rows are told apart by a 128-bit hash of id and text, so rows with a null or shared id are
    documents of their own; those that agree in both are one group, of which one row stays.

    With 256-bit fingerprints of five-word shingles, 51 differing bits are a similarity
    (equal bits) of 0.8; unrelated texts differ in 128 +- 8 bits, texts whose shingle sets
    overlap by 0.8 in 39 +- 6. Documents with an empty or null text form one group.
    """
    of = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    rows = docs.withColumns({"_h1": F.xxhash64(*of), "_h2": F.xxhash64(F.lit(1), *of)})
    keyed = rows.withColumn("_key", F.struct(of[0].alias("none"), F.col("doc_id"), F.col("_h1"), F.col("_h2")))
    groups = near_duplicates(keyed, "_key", "text", words, lanes, radius)
    firsts = groups.select(F.col("component_id._h1"), F.col("component_id._h2")).distinct()
    kept = rows.join(firsts, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"])
    return kept.select(*docs.columns)
