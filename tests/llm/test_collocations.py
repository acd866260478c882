"""Phrase collocations next to a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from contentgauge.llm import collocations
from contentgauge.llm.collocations import collocations as mined

SCHEMA = "doc_id int, text string, lang string, f long, phrase string"


def expected(rows, least, first):
    out = []
    for lang in sorted({r[2] if r[2] is not None else "und" for r in rows}):
        f, n = Counter(), 0
        for r in rows:
            if (r[2] if r[2] is not None else "und") != lang:
                continue
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                f.update(tuple(w[k:k + m]) for m in range(1, 5) for k in range(len(w) - m + 1))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(100 * b >= 80 * a and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
                   for q, b in cands.items() if len(q) > len(p)):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


def found(df, **how):
    return sorted(tuple(r) for r in mined(df, **how).collect())


def corpus(seed=1, docs=90):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "york", "é", "Éa", "a", "b", "z\x00", "naïve", "日本", "x\x1cy", "\xa0", "d'or", "$", "<|>"]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "! ", "  ", "\x0b", "\x0c", ";:"]
    rows = []
    for k in range(docs):
        text = "".join(rng.choices(vocab, weights=range(len(vocab), 0, -1))[0] + rng.choice(ends) for _ in range(rng.randint(0, 80)))
        rows.append((k, text + rng.choice(["", " New York City hall the of the of"]), rng.choice(["en", "en", "de", None, "und", ""]), 1, "x"))
    return rows + [(None, None, "en", None, None), (1, "", None, 1, "y"), (2, "the " * 4000, "hot", 1, "z"), rows[0], rows[0]]


@pytest.mark.parametrize("budget, chunk", [(10 ** 9, 10 ** 9), (40, 300), (5, 50)])
def test_equals_plain_count(frame, budget, chunk):
    rows = corpus()
    assert found(frame(rows, SCHEMA), least=5, first=40, budget=budget, chunk=chunk) == expected(rows, 5, 40)


def test_long_texts_are_cut_at_stops(frame, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 64)
    assert [len(s) for s in collocations.slices(b"ab. cd" * 20)] == [69, 51]
    assert list(collocations.slices(b"ab " * 100)) == [b"ab " * 100]
    assert b"".join(collocations.slices(b"A, b\tc!" * 50)) == b"a\xff b c\xff" * 50
    rows = corpus(seed=2, docs=30)
    assert found(frame(rows, SCHEMA), least=3, first=2_000, budget=60, chunk=100) == expected(rows, 3, 2_000)


def test_empty_table(frame):
    assert found(frame([], SCHEMA)) == []


def test_scores_pass_64_bits(spark):
    big = 4 * 10 ** 18
    rows = [("en", "a", big), ("en", "b", big + 3), ("en", "a b", big - 7)]
    r = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()
    assert [tuple(x) for x in r] == [("en", "a b", big - 7, big, big + 3, 2_000_000 * (big - 7) // (2 * big + 3))]


def test_runs_and_slots(spark):
    words = [b"\xff", b"a", "é".encode(), b"c"]
    rows, counts = collocations.suffixes(np.array([1, 2, 3, 0, 1, 2, 3, 0, 3, 0, 2, 2, 2, 2, 2, 0]))
    assert [tuple(r) for r in rows.T] == [(1, 2, 3, 0), (2, 2, 0, 0), (2, 2, 2, 0), (2, 2, 2, 2), (2, 3, 0, 0)]
    assert list(counts) == [2, 1, 1, 2, 2]
    names, again, sums = collocations._unpacked(collocations._packed(words, rows, counts))
    assert [[names[c] for c in r] for r in again.T] == [[words[c] if c else b"" for c in r] for r in rows.T] and list(sums) == list(counts)
    got = spark.sql("select pmod(xxhash64('é', 'a ü'), 65536)").first()[0]
    assert got == collocations.slot_of("é", "a ü".encode())


def test_words_are_coded_and_put_in_order_as_plain_python_does():
    texts = [b"the  a \x1c the \xc3\xa9", b"", b"  ", b"\xff a \xff \xff b the"]
    words, codes = collocations.coded(texts)
    assert words[0] == b"\xff" and len(set(words)) == len(words)
    assert [words[c] for c in codes] == b" \xff ".join([b"", *texts, b""]).split()
    rng = np.random.default_rng(3)
    for most in (3, 1_000, 70_000, 1 << 31):  # the last has keys beyond 64 bits
        codes = np.append(rng.choice([0, 1, 2, most - 1], 500), rng.integers(0, most, 300))
        padded = [*codes.tolist(), 0, 0, 0, 0]
        plain = Counter()
        for k in range(len(codes)):
            row = padded[k:k + 4]
            row = row[:row.index(0)] if 0 in row else row
            if len(row) > 1:
                plain[tuple(row + [0] * (4 - len(row)))] += 1
        rows, counts = collocations.suffixes(codes)
        assert list(zip(map(tuple, rows.T.tolist()), counts.tolist(), strict=True)) == sorted(plain.items())
        mixed = rng.permutation(np.append(np.arange(rows.shape[1]), np.arange(rows.shape[1])))
        again, sums = collocations.fold(rows[:, mixed], counts[mixed])
        assert (again == rows).all() and (sums == 2 * counts).all()


def test_heavy_prefixes_are_extended(spark):
    rows = [("en", b"a b c. a b d. x a b c"), ("de", b"a b c a b")]
    texts = spark.createDataFrame(rows, "lang string, text binary")
    got = collocations.count_prefixes(texts, 3, frozenset({("en", b"a b")}), 100).collect()
    assert sorted(map(tuple, got)) == [("en", "a b c", 2), ("en", "a b d", 1)]
