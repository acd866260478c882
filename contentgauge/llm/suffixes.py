"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of ``length`` bytes is repeated if it starts in two places. Its smallest k-gram hash
(its anchor) is the same in both, so windows are told apart by what lies left and right of their
anchor, and only suffixes that begin at anchors are sorted: one for about 70 bytes of text.

1. Anchors whose k-gram occurs once cannot belong to a repeat and are left out.
2. Every task sorts the suffixes of its documents and writes front-coded runs: the length of the
   prefix shared with the suffix before, and the rest. Equal suffixes are one entry of a run.
   Runs are dealt out by the k-gram, so suffixes that share ``k`` bytes meet.
3. The runs of a bucket are merged by a loser tree that carries, for each run, how many bytes it
   shares with the last output. Of two runs the one that shares more is smaller; only equal ones
   are compared, from the first unknown byte on. The merge yields each suffix's common prefix with
   its predecessor.
4. In every group of suffixes that share the anchor, a window with ``d`` bytes left of it is
   repeated if another member shares ``d`` bytes to the left and the rest to the right.

Anchors with very many different surroundings (a passage that a large part of all documents
holds begins or ends there) would be one group in one task; their windows are counted one by one
instead, by 128-bit hash, which combines before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from contentgauge.llm.common import store
from contentgauge.session import scratch_path

LENGTH, GRAM = 200, 64
CROWD = 20_000
CHUNK = 1 << 19
RUN_BYTES = 48 << 20
BUCKET_ROWS = 60_000
WIDE = 40


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, powers of an odd base modulo 2^64, and their inverses."""
    draw = np.random.default_rng(11)
    values = draw.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    size = CHUNK + 2 * LENGTH
    power = np.cumprod(np.full(size, base, np.uint64))
    inverse = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
    return values, power, inverse


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks, put together."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1:n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, most, least, hash): an anchor, and that it is the anchor of the windows which begin
    ``least`` to ``most`` bytes before it. Every window has exactly one."""
    values, power, inverse = _tables()
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(text) - length + 1, CHUNK):
        part = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[part] * power[:n], out=total[1:])
        code = (total[gram:] - total[:-gram]) * inverse[:n - gram + 1]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        # the place in the low bits: of equal hashes the leftmost is the smallest
        key = (code >> np.uint64(20) << np.uint64(20)) | np.arange(len(code), dtype=np.uint64)
        least = _window_min(key, length - gram + 1)
        first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        found.append((place + at, place - first, place - last, code[place].view(np.int64)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def surroundings(text: bytes, place: int, most: int, least: int, length: int) -> tuple[bytes, bytes]:
    """What an anchor's windows hold from it on, and before it (reversed)."""
    return text[place:place - least + length], text[place - most:place][::-1]


def _key(right: bytes, left: bytes) -> bytes:
    return xxhash.xxh3_128_digest(left + right, len(left))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Run:
    """Front-coded sorted suffixes, each with its left side, its key and whether it occurred twice."""

    def __init__(self, entries: dict[tuple[bytes, bytes], int]):
        self.rows = sorted(entries.items())

    def columns(self) -> dict[str, bytes]:
        shared, rest, last = [], [], b""
        for (right, _), _ in self.rows:
            n = common(last, right)
            shared.append(n)
            rest.append(right[n:])
            last = right
        pack = zstandard.ZstdCompressor(3).compress
        lefts = [left for (_, left), _ in self.rows]
        return {
            "shared": np.array(shared, np.uint16).tobytes(),
            "sizes": np.array([*map(len, rest)], np.uint16).tobytes(),
            "rest": pack(b"".join(rest)),
            "left_sizes": np.array([*map(len, lefts)], np.uint16).tobytes(),
            "lefts": pack(b"".join(lefts)),
            "twice": np.array([n > 1 for _, n in self.rows], np.uint8).tobytes(),
        }


RUN = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("shared", "sizes", "rest", "left_sizes", "lefts", "twice")]])


def read_run(row: dict) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """(bytes shared with the one before, suffix, left side, occurred twice) in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    shared, sizes, left_sizes = (np.frombuffer(row[c], np.uint16).tolist() for c in ("shared", "sizes", "left_sizes"))
    rest, lefts, at, left_at, last = unpack(row["rest"]), unpack(row["lefts"]), 0, 0, b""
    for n, size, left_size, twice in zip(shared, sizes, left_sizes, row["twice"], strict=True):
        last = last[:n] + rest[at:at + size]
        yield n, last, lefts[left_at:left_at + left_size], bool(twice)
        at, left_at = at + size, left_at + left_size


def merge(runs: list[Iterator[tuple[int, bytes, bytes, bool]]]) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """All entries of sorted runs in order, each with its common prefix with the one before.

    A loser tree: a node holds the run that lost there, with the number of bytes that run shares
    with the winner it lost to. A run's next entry shares with the last output what its front
    coding says, so prefixes that are known are never looked at again.
    """
    count = 1
    while count < len(runs):
        count *= 2
    heads = [next(r, None) for r in runs] + [None] * (count - len(runs))
    shared = [0] * count

    def loses(a: int, b: int) -> bool:
        """Whether ``a`` loses to ``b``; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is None
        if shared[a] != shared[b]:
            return shared[a] < shared[b]
        n = common(x[1], y[1], shared[a])
        lost = x[1][n:n + 1] > y[1][n:n + 1] or (x[1] == y[1] and a > b)
        shared[a if lost else b] = n
        return lost

    tree = [-1] * count

    def play(node: int) -> int:
        if node >= count:
            return node - count
        a, b = play(2 * node), play(2 * node + 1)
        if loses(a, b):
            a, b = b, a
        tree[node] = b
        return a

    best = play(1) if count > 1 else 0
    first = True
    while heads[best] is not None:
        _, right, left, twice = heads[best]
        yield (0 if first else shared[best]), right, left, twice
        first = False
        heads[best] = following = next(runs[best], None)
        shared[best] = following[0] if following else 0
        node = (best + count) // 2
        while node:
            other = tree[node]
            if loses(best, other):
                tree[node], best = best, other
            node //= 2


def _adjacent(sorted_lefts: list[bytes]) -> np.ndarray:
    return np.array([0, *(common(a, b) for a, b in zip(sorted_lefts, sorted_lefts[1:], strict=False))])


def repeats(group: list[tuple[int, bytes, bytes, bool]], length: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(right, left, from, to): windows that begin ``from`` to ``to`` bytes left of the anchor are repeated.

    ``group`` holds suffixes in order that share the anchor, with their common prefixes.
    """
    members: dict[tuple[bytes, bytes], list] = {}
    bound = length
    for k, (n, right, left, twice) in enumerate(group):
        bound = min(bound, n) if k else length  # since the last new member
        known = members.get((right, left))
        if known:
            known[1] = True
        else:
            members[right, left] = [bound, twice]
            bound = length
    entries = [(right, left, *x) for (right, left), x in members.items()]
    spans: list[list[tuple[int, int]]] = [[] for _ in entries]
    for k, (right, left, _, twice) in enumerate(entries):
        if twice:
            spans[k].append((length - len(right), len(left)))
    if 1 < len(entries) <= WIDE:
        for i in range(1, len(entries)):
            right, left, n = entries[i][:3]
            for j in range(i - 1, -1, -1):
                begin = max(length - n, length - len(right), length - len(entries[j][0]))
                end = common(left, entries[j][1])
                if begin <= end:
                    spans[i].append((begin, end))
                    spans[j].append((begin, end))
                n = min(n, entries[j][2])
    elif len(entries) > WIDE:
        # classes of equal left and of equal right sides, for every number of bytes to the left
        order = sorted(range(len(entries)), key=lambda k: entries[k][1])
        beside = _adjacent([entries[k][1] for k in order])
        above = np.array([e[2] for e in entries])
        least, most = np.array([length - len(e[0]) for e in entries]), np.array([len(e[1]) for e in entries])
        lefts = np.empty(len(entries), np.int64)
        for d in range(int(least.min()), int(most.max()) + 1):
            lefts[order] = np.cumsum(beside < d)
            code = np.cumsum(above < length - d) * (len(entries) + 1) + lefts
            valid = np.flatnonzero((least <= d) & (d <= most))
            _, which, times = np.unique(code[valid], return_inverse=True, return_counts=True)
            for k in valid[times[which] > 1].tolist():
                if spans[k] and spans[k][-1][1] == d - 1:
                    spans[k][-1] = (spans[k][-1][0], d)
                else:
                    spans[k].append((d, d))
    for (right, left, _, _), found in zip(entries, spans, strict=True):
        end = -1
        for a, b in sorted(found):
            if b > end:
                yield right, left, max(a, end + 1), b
                end = b


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _find_anchors(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), _texts(batch["text"]), strict=True):
                place, most, least, code = anchors(text, length, gram)
                if not len(place):
                    continue
                around = [xxhash.xxh3_64_intdigest(text[p - m:p - n + length]) & 0x7FFFFFFF
                          for p, m, n in zip(place.tolist(), most.tolist(), least.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(row, pa.int64()), len(place)), pa.array(code),
                     pa.array((place << 16) | (most << 8) | least), pa.array(around, pa.int64())],
                    ["row", "code", "place", "around"])

    return run


def _places(values: list[int] | None) -> Iterator[tuple[int, int, int, bool]]:
    for v in values or ():
        yield v >> 17, v >> 9 & 255, v >> 1 & 255, bool(v & 1)


def _build_runs(length: int, gram: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]):
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, dict] = {}
        size = 0

        def flush():
            for bucket, entries in held.items():
                yield _batch([(bucket, *Run(entries).columns().values())], RUN)
            held.clear()

        for batch in batches:
            for packed, places in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
                text = unpack(packed)
                for place, most, least, crowd in _places(places):
                    if crowd:
                        continue
                    entry = surroundings(text, place, most, least, length)
                    bucket = xxhash.xxh3_64_intdigest(entry[0][:gram]) % buckets
                    entries = held.setdefault(bucket, {})
                    seen = entries.get(entry, 0)
                    entries[entry] = seen + 1
                    size += 0 if seen else len(entry[0]) + len(entry[1]) + 150
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


FOUND = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("most", pa.int64())])


def _merge_runs(length: int, gram: int):
    def run(rows: pa.Table) -> pa.Table:
        out, group = [], []

        def close():
            for right, left, least, most in repeats(group, length) if group else ():
                out.append((_key(right, left), least, most))
            group.clear()

        for entry in merge([read_run(r) for r in rows.to_pylist()]):
            if entry[0] < gram:
                close()
            group.append(entry)
        close()
        return pa.Table.from_batches([_batch(out, FOUND)], FOUND)

    return run


MEMBERS = pa.schema([("row", pa.int64()), ("key", pa.binary()), ("places", pa.list_(pa.int64()))])


def _keys(length: int, crowded: bool):
    """Of every document the keys of its anchors and the places of each key: text that repeats
    itself within a document makes one row, not one per place. Of crowded anchors, the same for windows."""

    def run(batches: Iterable[pa.RecordBatch]):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("row", "text", "places"))
            for row, packed, places in zip(*columns, strict=True):
                text, found = unpack(packed), {}
                for place, most, least, crowd in _places(places):
                    if crowd != crowded:
                        continue
                    if crowded:
                        for s in range(place - most, place - least + 1):
                            found.setdefault(xxhash.xxh3_128_digest(text[s:s + length]), []).append(s)
                    else:
                        found.setdefault(_key(*surroundings(text, place, most, least, length)), []).append(place)
                out = [(row, key, at) for key, at in found.items()]
                for at in range(0, len(out), 20_000):
                    yield _batch(out[at:at + 20_000], MEMBERS)

    return run


def _remove(text: bytes, spans: Iterable[tuple[int, int]]) -> tuple[bytes, int]:
    kept, at, count, end = [], 0, 0, -1
    for begin, stop in sorted(spans):
        if begin > end:  # not even touching the run before
            count += 1
            kept.append(text[at:begin])
        end = at = max(end, stop)
    kept.append(text[at:])
    return b"".join(kept), count


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row.

    Texts are UTF-8 bytes, null is empty. ``kept`` (binary) is the text without every byte that a
    string of ``length`` bytes covers which also starts anywhere else, judged on the input;
    ``n_spans`` counts maximal removed runs. Strings do not cross documents. Rows that repeat a
    document are copies of each other; a null id is kept as such.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = rows.select("row", "text").mapInArrow(
        _find_anchors(length, gram), "row long, code long, place long, around long")
    shared = found.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where("n > 1")
    crowded = ((F.col("n") > crowd) & (F.col("a") != F.col("b"))).cast("long")
    places = found.join(shared, "code").select("row", (F.col("place") * 2 + crowded).alias("place"))
    places = places.groupBy("row").agg(F.collect_set("place").alias("places"))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(3).compress
        return pa.array([pack(t or b"") for t in texts.to_pylist()], pa.binary())

    # texts are shuffled once, compressed; the table stays bucketed for the join at the end
    small = rows.select("row", "doc_id", packed("text").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    small.join(places, "row", "left").write.option("path", scratch_path(spark, "repeat-texts")).bucketBy(
        parts, "row").sortBy("row").saveAsTable(name)
    kept = spark.table(name)
    held = kept.where("places is not null").select("row", "text", "places")
    entries = held.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(parts, -(-entries // BUCKET_ROWS))
    runs = held.mapInArrow(_build_runs(length, gram, buckets), "bucket int, shared binary, sizes binary, rest binary, "
                           "left_sizes binary, lefts binary, twice binary")
    same = store(runs.groupBy("bucket").applyInArrow(_merge_runs(length, gram), "key binary, least long, most long"), "repeats")
    members = held.mapInArrow(_keys(length, False), "row long, key binary, places array<long>")
    spans = members.join(same, "key").select("row", "places", "least", "most")
    windows = held.where(F.exists("places", lambda p: p.bitwiseAND(F.lit(1)) == 1)).mapInArrow(
        _keys(length, True), "row long, key binary, places array<long>")
    # a window's key with its count is combined before the shuffle
    often = windows.groupBy("key").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("key")
    zero = F.lit(0).cast("long")
    crowd_spans = windows.join(often, "key").select("row", "places", zero.alias("least"), zero.alias("most"))
    spans = spans.unionByName(crowd_spans).groupBy("row").agg(F.collect_set(F.struct("places", "least", "most")).alias("spans"))

    @F.arrow_udf("struct<n_bytes: bigint, n_spans: bigint, kept: binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        sizes, counts, out = [], [], []
        for packed_text, found_spans in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            whole = unpack(packed_text)
            rest, n = _remove(whole, [(p - s["most"], p - s["least"] + length) for s in found_spans or () for p in s["places"]])
            sizes.append(len(whole))
            counts.append(n)
            out.append(rest)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())],
            ["n_bytes", "n_spans", "kept"])

    result = kept.select("row", "doc_id", "text").join(spans, "row", "left").select("doc_id", cut("text", "spans").alias("c"))
    return result.select(
        "doc_id", "c.n_bytes", (F.col("c.n_bytes") - F.octet_length("c.kept")).alias("n_removed"), "c.n_spans", "c.kept")
