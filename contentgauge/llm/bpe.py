"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Merges are applied in order of rank. What follows a prefix can change its tokens only near
its end: a merge over the border of what is known moves the border left by its left part, and
the next merge that does so must have a higher rank and take, on its right, a token that begins
at the border. ``sufficient_lookahead`` follows these chains through the merge list once; tokens
that end further than that before the end of the known symbols are final and are emitted. The
rest is carried on, so memory does not grow with the text. Decoding is a state machine over ids.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], end: str = "") -> int:
    """How many symbols must follow a token before no continuation can change it."""
    def length(token: str) -> int:
        return len(token.removesuffix(end)) if end else len(token)

    reach: dict[str, int] = {}  # left part of a merge: the longest chain that ends with it
    starts: dict[str, set[str]] = {}  # token: tokens that it may have begun as
    longest = 0
    for left, right in merges:
        begun = starts.get(right, set()) | {right}
        chain = length(left) + max(reach.get(x, 0) for x in begun)
        reach[left] = max(reach.get(left, 0), chain)
        starts.setdefault(left + right, set()).update(starts.get(left, set()) | {left})
        longest = max(longest, chain)
    return longest + bool(end)  # the last symbol itself differs at the end of a word


class Vocabulary:
    """A tokenizer file: merges, ids, special tokens and how texts are normalised and split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.longest = max(map(len, self.ids))
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"]
        if [n for n in self.normal if n not in ("NFC", "Replace", "Lowercase")] or pre["type"] != "Sequence":
            raise ValueError("this encoder takes files of words with normalised white space")
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        # white space only ends pieces here, so texts may be cut at it first
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}")
        self.pieces = regex.compile(pattern)
        self.pieces_of_lines = regex.compile(rf"{pattern}|\n")
        self.decoder = (spec["decoder"] or {}).get("type")
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}

    def normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower() if "Lowercase" in self.normal else text
        if "NFC" in self.normal:
            text = unicodedata.normalize("NFC", text)
        # each character for itself: no special final sigma
        return text.replace("Σ", "σ").lower() if "Lowercase" in self.normal else text

    def merged(self, tokens: list[int]) -> list[int]:
        """All merges of a sequence of ids, lowest rank first, left to right: a heap over linked places."""
        rules, n = self.rules, len(tokens)
        tokens, after, before = tokens.copy(), [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rules[p][0], k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rules]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            following = after[k]
            rule = rules.get((tokens[k], tokens[following])) if tokens[k] >= 0 and following < n else None
            if rule is None or rule[0] != rank:
                continue  # one of the two has been merged since
            tokens[k], tokens[following], after[k] = rule[1], -1, after[following]
            if after[k] < n:
                before[after[k]] = k
                rule = rules.get((tokens[k], tokens[after[k]]))
                if rule:
                    heappush(heap, (rule[0], k))
            if before[k] >= 0:
                rule = rules.get((tokens[before[k]], tokens[k]))
                if rule:
                    heappush(heap, (rule[0], before[k]))
        return [t for t in tokens if t >= 0]


class Lockstep:
    """Merges many short pieces at once. Every round, each piece applies its lowest rule wherever it
    occurs; pieces without a rule are done. Rules are found in a hash table over pairs of ids."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, rules: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 17 | b for a, b in rules], np.uint64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key, self.rank, self.made = (np.zeros(1 << self.bits, k) for k in (np.uint64, np.int32, np.int32))
        self.rank[:] = self.NONE
        self.key[:] = np.iinfo(np.uint64).max
        ranks, made = (np.array([r[k] for r in rules.values()], np.int32) for k in (0, 1))
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):  # linear probing, all at once: the first to claim a free slot has it
            self.probes += 1
            slot = at[left]
            free = left[self.rank[slot] == self.NONE]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[won]], self.rank[at[won]], self.made[at[won]] = keys[won], ranks[won], made[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, slot) of each pair."""
        keys = left.astype(np.uint64) << np.uint64(17) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank = np.where(self.key[slot] == keys, self.rank[slot], self.NONE)
        open_ = np.flatnonzero((self.key[slot] != keys) & (self.rank[slot] != self.NONE))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            same = self.key[slot[open_]] == keys[open_]
            rank[open_[same]] = self.rank[slot[open_[same]]]
            open_ = open_[~same & (self.rank[slot[open_]] != self.NONE)]
        return rank, slot

    def run(self, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """``tokens`` of all pieces in a row, ``sizes`` their lengths (at least one); 32-bit ids of each."""
        done: list[bytes] = [b""] * len(sizes)
        piece = np.arange(len(sizes))
        while len(piece):
            starts = np.cumsum(sizes) - sizes
            rank, slot = self.find(tokens, np.append(tokens[1:], 0))
            rank[starts + sizes - 1] = self.NONE  # a pair does not reach into the next piece
            least = np.minimum.reduceat(rank, starts)
            over = least == self.NONE
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    done[piece[k]] = tokens[starts[k]:starts[k] + sizes[k]].tobytes()
                stay = np.repeat(~over, sizes)
                tokens, rank, slot = tokens[stay], rank[stay], slot[stay]
                piece, sizes, least = piece[~over], sizes[~over], least[~over]
                if not len(piece):
                    break
            owner = np.repeat(np.arange(len(piece)), sizes)
            hit = np.flatnonzero(rank == least[owner])
            if len(hit) > 1:  # of places that overlap, every second one from the left
                new = np.append(True, np.diff(hit) > 1)
                run = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            tokens[hit] = self.made[slot[hit]]
            stay = np.ones(len(tokens), bool)
            stay[hit + 1] = False
            sizes = sizes - np.bincount(owner[hit], minlength=len(piece))
            tokens = tokens[stay]
        return done


class Transducer:
    """Ids of one piece, whose bytes come in parts; holds a bounded window.

    Nothing is emitted before the window is full. A piece that ends in its first window therefore has
    one merge, that of ``finish``; the encoder takes these ends of many pieces together (``Lockstep``).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = self.size(vocabulary)
        self.held: list[str] = []

    @staticmethod
    def size(vocabulary: Vocabulary) -> int:
        return 2 * (vocabulary.lookahead + vocabulary.longest + 1)

    def feed(self, part: bytes) -> Iterator[int]:
        for at in range(0, len(part), self.window):
            self.held += [self.v.symbols[b] for b in part[at:at + self.window]]
            if len(self.held) >= self.window:
                yield from self._settled()

    def _settled(self) -> Iterator[int]:
        final, done = len(self.held) - self.v.lookahead, 0
        for token in self.v.merged([self.v.ids[s] for s in self.held]):
            stop = done + len(self.v.tokens[token])
            if stop > final:
                break
            done = stop
            yield token
        del self.held[:done]

    def finish(self) -> list[int]:
        if self.held:
            self.held[-1] += self.v.end
        tokens = self.v.merged([self.v.ids[s] for s in self.held])
        self.held = []
        return tokens


class Encoder:
    """Ids of whole texts. Words (runs without white space) and pieces are kept in a bounded memory;
    every piece is a transducer's, whose window most pieces do not fill: their ends are merged together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.odd = re.compile(f"[^{SPACE}]+").findall
        self.lockstep = Lockstep(vocabulary.rules)
        self.byte_id = np.array([vocabulary.ids[s] for s in vocabulary.symbols], np.int32)
        self.last_id = np.array([vocabulary.ids[s + vocabulary.end] for s in vocabulary.symbols], np.int32)
        self.window = Transducer.size(vocabulary)
        self.known: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        # str.split also ends words at four control characters
        return self.odd(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _pieces(self, word: str) -> list[str]:
        """Pieces of a word; a special token is a piece of its own."""
        parts = self.v.cut.split(word)
        return [x for k, part in enumerate(parts) for x in ([part] if k % 2 else self.v.pieces.findall(self.v.normalised(part)))]

    def _parts(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word, found in one text of all words without special tokens."""
        text, parts = "\n".join(words), {}
        if self.v.cut.search(text):
            parts = {w: self._pieces(w) for w in words if self.v.cut.search(w)}
            words = [w for w in words if w not in parts]
            text = "\n".join(words)
        found, at = self.v.pieces_of_lines.findall(self.v.normalised(text) + "\n"), 0
        for w in words:
            end = found.index("\n", at)
            parts[w] = found[at:end]
            at = end + 1
        return parts

    def _learn(self, pieces: list[str]) -> None:
        ending = []
        for piece in pieces:
            if piece in self.v.special:
                self.piece[piece] = np.array([self.v.special[piece]], np.int32).tobytes()
                continue
            raw = piece.encode()
            if len(raw) < self.window:
                ending.append((piece, raw))
                continue
            transducer = Transducer(self.v)
            ids = [*transducer.feed(raw)]
            self.piece[piece] = np.array(ids + transducer.finish(), np.int32).tobytes()
        if ending:
            short, coded = zip(*ending, strict=True)
            sizes = np.array([*map(len, coded)])
            raw = np.frombuffer(b"".join(coded), np.uint8)
            tokens, ends = self.byte_id[raw], np.cumsum(sizes) - 1
            tokens[ends] = self.last_id[raw[ends]]
            self.piece.update(zip(short, self.lockstep.run(tokens, sizes), strict=True))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids begin and the last ends)."""
        words = [self._words(t) if t else [] for t in texts]
        present = set().union(*words)
        if len(self.known) + len(present) > CACHED:  # what is frequent is in this batch as well
            self.known = {w: self.known[w] for w in present & self.known.keys()}
        if len(self.piece) > CACHED:
            self.piece = {}
        known, piece = self.known, self.piece
        # looked up one by one: a difference of sets would run through all that is known
        parts = self._parts([w for w in present if w not in known])
        self._learn([p for p in set(chain.from_iterable(parts.values())) if p not in piece])
        for w, found in parts.items():
            known[w] = piece[found[0]] if len(found) == 1 else b"".join([piece[p] for p in found])
        ids = [b"".join(map(self.known.__getitem__, w)) for w in words]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return np.frombuffer(b"".join(ids), np.int32), ends


class Decoder:
    """Text of ids that come in parts. Files without a decoder join token strings by a space;
    byte-level ones turn tokens to bytes, of which an unfinished character waits for the next."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.begun = vocabulary, False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = [*filter(None, map(self.v.tokens.get, ids))]
        if self.v.decoder is None:
            lead = " " if self.begun and tokens else ""
            self.begun = self.begun or bool(tokens)
            return lead + " ".join(tokens)
        return self.text.decode(b"".join(map(self._bytes, tokens)))

    def _bytes(self, token: str) -> bytes:
        known = self.v.bytes_of
        return bytes(known[c] for c in token) if all(c in known for c in token) else token.encode()

    def finish(self) -> str:
        return self.text.decode(b"", True)


class Strings:
    """``Decoder`` for files without a decoder, a column of id lists at once: its state is only whether a token came
    before, so a text is its token strings, joined."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.tokens, default=-1) + 1
        self.tokens = pa.array([vocabulary.tokens.get(i) or None for i in range(top)] + [None], pa.string())

    def joined(self, column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
        unknown = len(self.tokens) - 1
        found = self.tokens.take(pa.array(np.where((ids < 0) | (ids >= unknown), unknown, ids).astype(np.int64)))
        if found.null_count:
            known = found.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
            found = found.drop_null()
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), " ")


@lru_cache(maxsize=4)
def strings(path: str) -> Strings:
    return Strings(vocabulary(path))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in a worker; ``path`` must exist on every machine, as installed files do."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def encode(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add ``name``: the token ids of the whole text (array of int); a null text has none."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        values, ends = encoder(path).batch(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    return df.withColumn(name, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded", part: int = 65_536) -> DataFrame:
    """Add ``name``: the text of the ids, special tokens included; unknown ids are left out.
    Null ids give an empty text."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        words, out = vocabulary(path), []
        if words.decoder is None:
            return strings(path).joined(column)
        for row in column:
            state, values = Decoder(words), row.values
            values = [] if values is None else values.to_numpy(zero_copy_only=False)
            found = [state.feed(values[k:k + part].tolist()) for k in range(0, len(values), part)]
            out.append("".join(found) + state.finish())
        return pa.array(out, pa.string())

    return df.withColumn(name, texts(F.col(ids)))
