import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contentgauge.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    draw, encode = random.Random(3), packing.units(PATH).ids
    alphabet = "abcAB sS'tTre  \n\t\x1c\x85\xa0éß한😂19½²!?.,-_<|>"
    texts = ["", " ", "a" * 3000, "  <|endoftext|>  x", "it's I'LL 's", "foo'.bar, baz.' ?!x", " \n \n x \n"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_memory_of_units_is_bounded(monkeypatch, library):
    monkeypatch.setattr(packing, "CACHED", 50)
    known = packing.Units(PATH)
    text = " ".join(f"word{k}, {k}" for k in range(500))
    assert np.frombuffer(known.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(known) <= 51


def test_plan_uses_up_all_rests():
    draw = random.Random(1)
    counts = Counter(min(2047, 1 + int(draw.expovariate(1 / 500))) for _ in range(9000)) + Counter({2048: 70, 1: 500})
    used, padding = Counter(), 0
    for times, lengths in packing.plan(counts):
        assert sum(lengths) <= packing.WINDOW
        padding += times * (packing.WINDOW - sum(lengths))
        for n in lengths:
            used[n] += times
    assert used == counts
    assert padding < 0.005 * sum(n * c for n, c in counts.items())
    assert packing.plan({}) == []


def test_pieces_and_sequences(frame, library):
    draw = random.Random(2)
    texts = [None, "", "x", "the end " * 5000] + [" ".join(draw.choice(["alpha", "beta", "Gamma", "ça", "\n"]) for _ in range(
        draw.choice([5, 200, 900, 4000]))) for _ in range(120)]
    texts += ["the same text " * 30] * 80
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    got = packing.pack(frame(rows, "doc_id long, text string, length string, step int"), PATH).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for doc, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.CLOSING]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW and len({r.step for r in found}) == 1
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < packing.WINDOW + 0.01 * sum(r.length for r in got)
    steps = Counter({r.sequence_id: r.step for r in got}.values())
    assert max(steps.values()) - min(steps.values()) <= 1


def test_empty_table_and_repeated_rows(frame):
    schema = "doc_id long, text string"
    assert packing.pack(frame([], schema), PATH).collect() == []
    got = packing.pack(frame([(None, "a b"), (1, "a b"), (1, "a b")], schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.offset) for r in got) == [(0, 0), (1, 3), (1, 6)] or sorted(r.offset for r in got) == [0, 3, 6]


def test_tiers_have_sequences_of_their_size(frame, monkeypatch):
    draw = random.Random(4)
    counts = Counter(1 + int(draw.expovariate(1 / 300)) % 2048 for _ in range(9000)) + Counter({2048: 70})
    used, sizes, order, padding = Counter(), Counter(), [], 0
    for times, lengths in packing.plan(counts, packing.WINDOW, packing.TIERS):
        size = packing.size_of(lengths)
        # a sequence below the window is full; only windows are padded
        assert sum(lengths) == size if size < packing.WINDOW else sum(lengths) <= size
        padding += times * (size - sum(lengths))
        sizes[size] += times
        order.append(size)
        for n in lengths:
            used[n] += times
    assert used == counts and order == sorted(order, reverse=True)
    assert set(sizes) == set(packing.TIERS) and padding < 0.01 * sum(n * c for n, c in counts.items())
    rows = [(k, "word " * draw.choice([10, 100, 230, 400, 480, 900, 511, 1023, 255, 256, 127, 155])) for k in range(600)]

    def packed():
        sequences = {}
        for r in packing.pack(frame(rows, "doc_id long, text string"), PATH).collect():
            sequences.setdefault(r.sequence_id, []).append(r)
        return sequences

    sequences, steps = packed(), {}
    for found in sequences.values():
        total = sum(r.length for r in found)
        assert len({r.tier for r in found}) == 1
        assert total == found[0].tier if found[0].tier < packing.WINDOW else total <= packing.WINDOW
        steps.setdefault(found[0].tier, Counter())[found[0].step] += 1
    assert len(steps) > 1
    n_steps = len({r.step for found in sequences.values() for r in found})
    for dealt in steps.values():
        every = [*dealt.values(), *[0] * (n_steps - len(dealt))]
        assert max(every) - min(every) <= 1
    monkeypatch.setattr(packing, "TIERS", (2048,))  # the tiers decide where pieces go
    assert len(packed()) < len(sequences)
