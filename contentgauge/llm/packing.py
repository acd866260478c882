"""Packing documents into windows of several context sizes.

Documents are tokenised once, in the row, and cut into whole windows and one rest, so the pieces
and their checksums are final before anything is placed. A rest belongs to the tier of the smallest
context size that holds it. The plan works on the number of rests of each length, a table of one
row per length below the window, whatever the corpus: from the longest tier down, rests that fill
the tier's context size exactly are a sequence of that size; the gaps of the windows are filled
with the longest rests that still fit, shorter tiers' too, as often as the counts allow. So only windows
are padded. Pieces then find their place in the plan by their number within their
length, which is counted in slices; no task sees all pieces of a length.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from contentgauge.llm.bpe import SPACE, byte_symbols
from contentgauge.llm.common import store

WINDOW = 2_048
TIERS = (256, 512, 1_024, 2_048)
CLOSING = 1
SPARED = 0.25  # of the rests of a length, for the windows
CACHED = 600_000
LONGEST = 64
STOPS = ".,;:!?|&$%#*"
# how byte-level files of this kind split texts
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")
SLICES = 256
GROUP = 8  # sequences of a step


class Units(dict):
    """Ids (little-endian, 32 bits) of units: white space and what follows it up to the next.

    The file's pieces never reach over the end of a unit, so a text's ids are those of its units. A
    unit is encoded when it is first met and kept; the oldest half goes when ``CACHED`` are held.
    Pieces are merged by tiktoken with the file's own vocabulary, which gives the same ids as the
    tokenizers library and takes a third of its time; that library encodes what holds a special token.
    """

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or made != sorted(made):
            raise ValueError("this encoder takes byte-level files whose ids are in order of the merges")
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in ids.items() if token not in added}
        # one pattern, and pieces go to the merges as they are
        self.piece = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(PATTERN).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall

    def __missing__(self, unit: str) -> bytes:
        core = unit.rstrip(STOPS)
        if self.special(unit):
            found = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        elif core and len(core) < len(unit) and core[-1].isalnum():  # a piece ends between the two
            found = self[core] + self[unit[len(core):]]
        else:
            ids = array("I")
            for piece in self.pieces(unit):
                ids.extend(self.piece(piece.encode()))
            found = ids.tobytes()
        if len(self) >= CACHED:
            for old in list(islice(self, CACHED // 2)):
                del self[old]
        if len(unit) <= LONGEST:
            self[unit] = found
        return found

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.units(text))) if text else b""


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    return Units(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids and the closing id, cut
    at multiples of ``window``. A null or empty text is the closing id alone."""
    closing = array("I", [CLOSING]).tobytes()

    def cut(batches):
        encode = units(path).ids
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for k, text in enumerate(batch["text"].to_pylist()):
                ids = encode(text) + closing
                for at in range(0, len(ids), 4 * window):
                    part = ids[at:at + 4 * window]
                    for column, value in zip(rows, (k, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        column.append(value)
            owner = batch["doc_id"].take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [owner, *[pa.array(c, pa.int64()) for c in rows[1:]]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def size_of(lengths: tuple[int, ...], window: int = WINDOW) -> int:
    """The context size of a sequence: its own length where that is a tier's, else the window, to which it is padded."""
    return total if (total := sum(lengths)) in TIERS else window


def _filled(left: dict[int, int], gap: int, parts: int) -> tuple[int, ...] | None:
    """At most ``parts`` of the lengths left that fill the gap exactly, the longest first."""
    if left.get(gap):
        return (gap,)
    if parts > 1:
        for n in sorted((n for n in left if n < gap), reverse=True):
            rest = _filled({m: c - (m == n) for m, c in left.items() if c - (m == n)}, gap - n, parts - 1)
            if rest:
                return (n, *rest)
    return None


def plan(counts: dict[int, int], window: int = WINDOW, tiers: tuple[int, ...] = ()) -> list[tuple[int, tuple[int, ...]]]:
    """[(how many sequences, lengths in order)] that use up all rests, the longest sequences first.

    Whole windows stand alone, and rests above the longest shorter tier open windows, whose gaps take the
    longest rest left that fits, shorter tiers' too. In each shorter tier, from the longest down, a rest and at
    most two others that fill its context size *exactly* are a sequence, so it needs no padding; of every length
    ``SPARED`` of the rests stay back for the windows, which take all that is left. A pattern is repeated until
    one of its lengths runs out.
    """
    left = {n: c for n, c in counts.items() if c}
    out = []

    def take(lengths: tuple[int, ...], held: dict[int, int]) -> int:
        times = min(held[n] // lengths.count(n) for n in set(lengths))
        out.append((times, lengths))
        return times

    def drop(lengths: tuple[int, ...], times: int, held: dict[int, int]) -> None:
        for n in set(lengths):
            held[n] -= times * lengths.count(n)
            if not held[n]:
                del held[n]

    def windows(above: int) -> None:
        while left and max(left) > above:
            gap, used = window, []
            for n in sorted(left, reverse=True):
                fits = min(left[n], gap // n)
                used += [n] * fits
                gap -= n * fits
            lengths = tuple(used)
            drop(lengths, take(lengths, left), left)

    if window in left:
        out.append((left.pop(window), (window,)))
    short = sorted((t for t in tiers if t < window), reverse=True)
    windows(max(short, default=0))
    for size, below in zip(short, [*short[1:], 0]):
        free = {n: f for n, c in left.items() if (f := c - math.ceil(c * SPARED))}
        for n in sorted((n for n in free if below < n <= size), reverse=True):
            while free.get(n):
                others = {m: c - (m == n) for m, c in free.items() if c - (m == n)}
                rest = () if n == size else _filled(others, size - n, 2)
                if rest is None:
                    break
                lengths = (n, *rest)
                times = take(lengths, free)
                drop(lengths, times, free)
                drop(lengths, times, left)
    windows(0)
    return sorted(out, key=lambda x: -size_of(x[1], window))


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, sequence, step, offset) rows: the piece numbered ``first`` + k of its
    length goes to ``sequence`` + k, where it begins at ``offset``. One row per place of a pattern."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, first + times - 1, sequence, offset, size_of(lengths)))
            used[n] = first + times
            offset += n
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step) per piece.

    ``tier`` is the context size of the sequence (below the window it is filled to the last id), ``step`` the group of ``group`` sequences trained
    together: sequences are numbered tier by tier and dealt over the steps, so the steps' numbers of
    sequences of a tier differ by one at most. Rows with a null id are packed like any other.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, path, doc_id, text), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLICES)).cast("int")
    cut = cut.withColumn("salt", salt)
    sizes = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # at most window x SLICES small rows, summed to one row per length for the plan
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(counts, WINDOW, TIERS)
    rows = places(patterns)
    total = sum(times for times, _ in patterns)
    steps = max(1, -(-total // group))
    table = spark.createDataFrame(
        rows, "length long, first long, last long, sequence long, offset long, tier int")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = cut.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("r")).drop("r", "base", "salt")
    spans = table.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("first", "last", "sequence", "offset", "tier"))).alias("spans"))
    placed = numbered.join(F.broadcast(spans), "length").withColumn("s", F.element_at(F.filter(
        "spans", lambda s: (s["first"] <= F.col("number")) & (s["last"] >= F.col("number"))), 1))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("s.sequence") + F.col("number") - F.col("s.first")).alias("sequence_id"),
        F.col("s.offset").alias("offset"), F.col("s.tier").alias("tier"),
    ).withColumn("step", F.pmod(F.col("sequence_id"), F.lit(steps)))
