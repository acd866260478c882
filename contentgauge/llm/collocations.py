"""Phrase collocations from suffix subtrees over vertically partitioned word prefixes.

First words are counted, one scan. A prefix (a word, per language) with more occurrences than the memory
budget is extended by a word, another scan over its occurrences alone, until every prefix fits or
has all its words. Prefixes are then grouped until a group's occurrences fill the budget. One more
scan hands every suffix, cut to ``DEPTH`` words, to the group of its prefix, as sorted runs with equal
suffixes folded. A group's suffixes in order are the leaves of its subtree, built alone: the
boundaries of a depth are its nodes, the sums of leaf totals between them their counts. Scores
and the choice are DataFrame operations on phrases that are frequent enough.

A worker holds ``CHUNK`` words at once, or the longest run without a stop if that is longer; a group holds
``BUDGET`` suffixes, fewer where suffixes repeat. What reaches the driver are prefixes above the budget (no
more than words / ``BUDGET`` a depth) and occurrences of ``SLOTS`` hash slots, the units that are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.llm.common import store
from contentgauge.operators.skew import salted_join, top_per_group

DEPTH = 4
CHUNK = 1_500_000
BUDGET = 2_000_000
SLOTS = 1 << 16
SLICE = 8 << 20  # bytes of a text taken at once
LEAST, FIRST, COVER = 30, 2_000, 80
STOPS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
PARTS_PER_TASK = 200_000
CODEC = pa.Codec("zstd", compression_level=1)


def _table() -> bytes:
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    out[9] = 32
    for b in STOPS:
        out[b] = 255  # no byte of UTF-8
    return bytes(out)


TABLE = _table()


def slices(text: bytes) -> Iterator[bytes]:
    """A text's bytes, stops as 255, in slices that end at a stop."""
    data = text.translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b"\xff", min(at + SLICE, len(data)))
        end = len(data) if end < 0 else end + 1
        yield data[at:end]
        at = end


def coded(parts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(words by code, codes) of slices, a stop after each; code 0 is a stop."""
    text = pa.array([b" ".join([b"\xff", *[b"%b \xff" % p for p in parts]])], pa.large_binary())
    words = pc.split_pattern(text, pattern=b" ").flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)


def chunks(batches, size: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words by code, codes) of batches (lang, text), about ``size`` words each, fewer where blanks repeat."""
    held: dict[str, list[bytes]] = {}
    count = 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, value in zip(langs, batch.column("text"), strict=True):
            for part in slices(value.as_py() or b""):
                part = part.replace(b"\xff", b" \xff ")
                held.setdefault(lang, []).append(part)
                count += part.count(b" ") + 1
                if count >= size:
                    yield from _done(held)
                    count = 0
    yield from _done(held)


def _done(held: dict[str, list[bytes]]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    for lang in list(held):
        yield lang, *coded(held.pop(lang))


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``DEPTH`` codes, counts): the different suffixes of two words or more in order, cut to
    ``DEPTH`` words and at stops (0 from there on)."""
    padded = np.append(codes, np.zeros(DEPTH, np.int64))
    # a suffix is the pair of words at its place and the one two words on
    pairs, rank = np.unique(padded[:-1] << 32 | np.where(padded[:-1] > 0, padded[1:], 0), return_inverse=True)
    n = len(codes)
    keys = np.sort((rank[:n] << 32 | rank[2:n + 2])[(codes > 0) & (padded[1:n + 1] > 0)])
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = pairs[keys[start] >> 32], pairs[keys[start] & 0xffffffff]
    return np.stack([half for pair in ends for half in (pair >> 32, pair & 0xffffffff)]), np.diff(np.append(start, len(keys)))


def fold(rows: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns of codes in order, equal ones once, with the sum of their counts (of ones)."""
    if not rows.shape[1]:
        return rows, np.zeros(0, np.int64)
    width = int(rows.max()).bit_length()
    lows, low = np.unique(rows[2] << 32 | rows[3], return_inverse=True)
    rest = len(lows).bit_length()
    if 2 * width + rest < 64:
        keys = rows[0] << (width + rest) | rows[1] << rest | low
        order = np.argsort(keys)
        keys = keys[order]
        new = keys[1:] != keys[:-1]
    else:
        high = rows[0] << 32 | rows[1]
        order = np.lexsort((low, high))
        new = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    start = np.flatnonzero(np.append(True, new))
    sums = np.diff(np.append(start, len(order))) if counts is None else np.add.reduceat(counts[order], start)
    return rows[:, order[start]], sums


def nodes(rows: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, total) of the nodes of a depth, leaves in order."""
    if not rows.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(rows.shape[1], bool)
    new[0] = True
    for k in range(depth):
        new[1:] |= rows[k, 1:] != rows[k, :-1]
    start = np.flatnonzero(new)
    total = np.add.reduceat(counts, start)
    whole = rows[depth - 1, start] > 0
    return start[whole], total[whole]


def slot_of(lang: str, prefix: bytes) -> int:
    """As ``pmod(xxhash64(lang, prefix), SLOTS)`` in Spark."""
    return xxhash.xxh64_intdigest(prefix, xxhash.xxh64_intdigest(lang.encode(), 42)) % SLOTS


class Partition:
    """Which group a suffix belongs to: by the slot of its prefix, the shortest that is not above the budget."""

    def __init__(self):
        self.heavy: list[frozenset[tuple[str, bytes]]] = []  # by number of words - 1
        self.groups: list[np.ndarray] = []  # group of a slot, -1 for none
        self.count = 0

    def pack(self, sizes: dict[int, int], budget: int) -> None:
        """Slots of the next depth, grouped in their order until the budget is full."""
        out, held = np.full(SLOTS, -1, np.int64), None
        for slot in sorted(sizes):
            if held is None or held + sizes[slot] > budget:
                self.count += 1
                held = 0
            held += sizes[slot]
            out[slot] = self.count - 1
        self.groups.append(out)

    def of(self, lang: str, words: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, words of the prefix) per suffix, group -1 where it needs none."""
        group = np.full(rows.shape[1], -1, np.int64)
        depths = np.zeros(rows.shape[1], np.int64)
        open_ = np.arange(rows.shape[1])
        for depth, groups in enumerate(self.groups, 1):
            open_ = open_[rows[depth - 1, open_] > 0]
            start, _ = nodes(rows[:, open_], np.ones(len(open_), np.int64), depth)
            if not len(start):
                break
            prefixes = [b" ".join([words[c] for c in rows[:depth, open_[s]]]) for s in start]
            heavy = self.heavy[depth - 1]
            target = np.array([-2 if (lang, p) in heavy else groups[slot_of(lang, p)] for p in prefixes], np.int64)
            each = np.repeat(target, np.diff(np.append(start, len(open_))))
            group[open_] = np.where(each == -2, -1, each)
            depths[open_] = depth
            open_ = open_[each == -2]
        return group, depths


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))


def count_prefixes(texts: DataFrame, depth: int, heavy: frozenset, size: int) -> DataFrame:
    """(lang, phrase, f) of all words, or of the phrases of ``depth`` words that extend a heavy one."""
    firsts = {(lang, phrase.split(b" ")[0]) for lang, phrase in heavy}

    def run(batches):
        for lang, words, codes in chunks(batches, size):
            if depth == 1:
                counts = np.bincount(codes, minlength=len(words))[1:]
                phrases = words[1:]
            else:
                # only what begins as a heavy prefix does is put in order, and no more words of it than are counted
                first = np.fromiter(((lang, w) in firsts for w in words), bool, len(words))
                padded = np.append(codes, np.zeros(DEPTH, np.int64))
                at = np.flatnonzero(first[codes])
                rows = np.zeros((DEPTH, len(at)), np.int64)
                rows[0] = codes[at]
                for k in range(1, depth):
                    rows[k] = padded[at + k] * (rows[k - 1] > 0)
                rows, counts = fold(rows[:, rows[depth - 1] > 0], None)
                begin, _ = nodes(rows, counts, depth - 1)
                sure = np.array([(lang, b" ".join([words[c] for c in rows[:depth - 1, s]])) in heavy for s in begin], bool)
                inside = np.repeat(sure, np.diff(np.append(begin, rows.shape[1])))
                rows, counts = rows[:, inside], counts[inside]
                start, counts = nodes(rows, counts, depth)
                phrases = [b" ".join([words[c] for c in rows[:depth, s]]) for s in start]
            if len(phrases):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
                ], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _packed(words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of suffixes with the words it needs."""
    if rows.size < len(words):
        used, small = np.unique(rows, return_inverse=True)
    else:
        met = np.zeros(len(words), bool)
        met[rows] = True
        used, small = np.flatnonzero(met), (np.cumsum(met) - 1)[rows]
    names = b" ".join([words[c] if c else b"" for c in used])
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    body = small.reshape(rows.shape).astype(kind).tobytes() + counts.astype(np.int64).tobytes()
    head = np.array([rows.shape[1], len(names), kind().itemsize, 32 + len(names) + len(body)], np.int64).tobytes()
    return head[24:] + CODEC.compress(head + names + body, asbytes=True)


def _unpacked(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words by code, codes, counts); the word b"" is a stop."""
    data = CODEC.decompress(run[8:], int(np.frombuffer(run, np.int64, 1)[0]), asbytes=True)
    n, long, width, _ = np.frombuffer(data, np.int64, 4)
    names, body = data[32:32 + long], data[32 + long:]
    rows = np.frombuffer(body, np.uint16 if width == 2 else np.uint32, DEPTH * n).reshape(DEPTH, n)
    return names.split(b" "), rows, np.frombuffer(body, np.int64, n, DEPTH * int(n) * int(width))


def hand_out(texts: DataFrame, partition: Partition, size: int) -> DataFrame:
    """(grp, lang, prefix, run): runs of suffixes for the groups."""
    def run(batches):
        for lang, words, codes in chunks(batches, size):
            rows, counts = suffixes(codes)
            group, depths = partition.of(lang, words, rows)
            order = np.argsort(group, kind="stable")
            order = order[group[order] >= 0]
            if not len(order):
                continue
            start = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            found = ([], [], [])
            for s, e in zip(start, np.append(start[1:], len(order)), strict=True):
                own = order[s:e]
                for column, value in zip(found, (group[own[0]], depths[own[0]], _packed(words, rows[:, own], counts[own])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(found[0], pa.int64()), pa.array([lang] * len(start)), pa.array(found[1], pa.int64()),
                pa.array(found[2], pa.binary())], ["grp", "lang", "prefix", "run"])

    return texts.mapInArrow(run, "grp long, lang string, prefix long, run binary")


def subtrees(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f): nodes of the groups' subtrees, from their prefixes down, of at least ``least`` occurrences."""
    def build(key, table):
        lang, prefix = key[1].as_py(), max(key[2].as_py(), 2)
        codes: dict[bytes, int] = {b"": 0}
        parts, sums = [], []
        for run in table.column("run"):
            words, rows, counts = _unpacked(run.as_py())
            mapped = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
            parts.append(mapped[rows])
            sums.append(counts)
        rows, counts = fold(np.concatenate(parts, axis=1), np.concatenate(sums))
        words, phrases, totals = list(codes), [], []
        for depth in range(prefix, DEPTH + 1):
            start, total = nodes(rows, counts, depth)
            often = total >= least
            phrases += [b" ".join([words[c] for c in rows[:depth, s]]) for s in start[often]]
            totals.append(total[often])
        return pa.table([
            pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
            pa.array(np.concatenate(totals), pa.int64())], ["lang", "phrase", "f"])

    return runs.groupBy("grp", "lang", "prefix").applyInArrow(build, "lang string, phrase string, f long")


def frequent(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, budget: int = BUDGET, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes): (lang, phrase, f) of all phrases of up to ``DEPTH`` words that occur ``least`` times, (lang, n)."""
    texts = _texts(docs, lang, text)
    partition, found, heavy = Partition(), [], frozenset()
    for depth in range(1, DEPTH + 1):
        level = count_prefixes(texts, depth, heavy, chunk)
        level = store(level if depth == 1 else level.where(F.col("f") >= least), "prefixes")
        if depth == 1:
            sizes = level.groupBy("lang").agg(F.sum("f").alias("n"))
        often = level.where(F.col("f") >= least)
        large = F.col("f") > budget
        found.append(often if depth in (1, DEPTH) else often.where(large))
        if depth == DEPTH:
            break
        slot = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SLOTS))
        slots = level.where(~large).groupBy(slot.alias("slot")).agg(F.sum("f").alias("n"), F.max("f").alias("most"))
        partition.pack({r["slot"]: r["n"] for r in slots.where(F.col("most") >= least).collect()}, budget)
        heavy = frozenset((r["lang"], r["phrase"].encode()) for r in often.where(large).select("lang", "phrase").collect())
        partition.heavy.append(heavy)
        if not heavy:
            break
    out = subtrees(hand_out(texts, partition, chunk), least)
    for more in found:
        out = out.unionByName(more.select("lang", "phrase", "f"))
    return store(out, "phrases"), sizes


def _joined(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, F.lit(n) if isinstance(n, int) else n), " ")


def _wide(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def scored(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one stands for.

    A candidate's first parts, rests and the phrases inside it are looked up by all candidates at once; a
    word that ends or begins very many of them is dealt over tasks. All that is known of a
    candidate is then brought together by one aggregate.
    """
    candidates = phrases.withColumn("words", F.split("phrase", " ")).withColumn("m", F.size("words")).where("m >= 2")
    cuts = F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(
        k.alias("k"), F.array(_joined(F.col("words"), 1, k), _joined(F.col("words"), k + 1, F.col("m") - k)).alias("parts")))
    parts = candidates.select("lang", "phrase", F.inline(cuts)).select("lang", "phrase", "k", F.posexplode("parts").alias("side", "part"))
    parts = parts.select("phrase", "k", "side", F.struct("lang", "part").alias("of"))
    lookup = phrases.select(F.struct("lang", F.col("phrase").alias("part")).alias("of"), "f")
    looked = salted_join(parts, lookup, "of", "phrase", per_task=PARTS_PER_TASK)
    known = [F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")).alias(f"{'lr'[s]}{k}") for k in range(1, DEPTH) for s in (0, 1)]
    none = F.lit(None).cast("long")
    names = [f"{s}{k}" for k in range(1, DEPTH) for s in "lr"]
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("m") - n + 1), lambda s: _joined(F.col("words"), s, n))))
    rows = looked.select(F.col("of.lang").alias("lang"), "phrase", *known, none.alias("a"), none.alias("c"))
    rows = rows.unionByName(candidates.select("lang", "phrase", *[none.alias(c) for c in names], F.col("f").alias("a"), none.alias("c")))
    rows = rows.unionByName(candidates.where("m >= 3").select("lang", F.explode(inside).alias("phrase"), "f").select(
        "lang", "phrase", *[none.alias(c) for c in names], none.alias("a"), F.col("f").alias("c")))
    whole = rows.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in [*names, "a", "c"]])
    whole = whole.where(F.col("c").isNull() | (_wide("c") * 100 < _wide("a") * cover))
    # decimals of 38 digits: products pass 64 bits
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"(2000000BD * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + r{k})").alias("score"),
        F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, DEPTH)]
    best = whole.withColumn("best", F.array_min(F.array(*cuts)))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, first: int = FIRST, cover: int = COVER,
    budget: int = BUDGET, chunk: int = CHUNK,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of two to ``DEPTH`` words of every language.

    A null language counts as ``und``, a null text as empty. Ties go by occurrences, then by the phrase's bytes, so ranks
    are defined; repeated rows count as often as they stand. Other columns take no part.
    """
    phrases, sizes = frequent(docs, lang, text, least, budget, chunk)
    best = top_per_group(scored(phrases, cover), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], first, F.col("phrase"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
