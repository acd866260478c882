"""Licence scans next to plain search and known notices."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contentgauge.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NOTICE = dict(licenses.TEMPLATES)  # the longest of each label comes last


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def places(text):
    w, out = words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
    return sorted(out)


def run(frame, texts):
    df = frame([(k, t, "x", 5) for k, t in enumerate(texts)], "doc_id int, text string, places string, score int")
    return {r.doc_id: r for r in licenses.labelled(licenses.scan(df)).collect()}


CASES = [
    None, "", "   \n", "CC BY", "cc-by cc by ccby cc  BY", "all rights reserved all rights reserved.", "All Rights\nReserved",
    "the GNU General Public License general public general public license", "café ccé by", "cc by cc by",
    "all all rights rights reserved", "cc cc by by", "İcc by", "all rights", "x" * 200_000, "cc by " * 20_000,
    "general public " * 3 + "license", "\x00cc\x01by\x7f",
]


def test_places_equal_plain_search(frame):
    rng = random.Random(3)
    pool = "cc by general public license all rights reserved the under gnu".split()
    texts = CASES + [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(150)]
    for k, r in run(frame, texts).items():
        want = places(texts[k])
        assert [(p.start, p.label) for p in r.places] == want, texts[k][:80]
        assert (r.n_words, r.n_base) == (len(words(texts[k])), len(want))
        assert (r.first_word, r.last_word) == ((min(want)[0], max(want)[0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (not want or r.score == 1)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        made = tuple(("t%d" % k, " ".join(rng.choices("abcd", k=rng.randint(1, 9)))) for k in range(4))
        machine = licenses.Automaton(licenses.templates((("a b", "ab"),), made))
        held = [t.words for t in machine.templates]
        text = [c.encode() for c in rng.choices("abcde", k=60)]

        def longest(i):
            return max(n for n in range(i + 1) if any(h[k:k + n] == text[i - n:i] for h in held for k in range(len(h) + 1)) or n == 0)

        stats = [longest(i) for i in range(len(text) + 1)]
        ends = {(n, i) for i, n in enumerate(stats) if n and (i == len(text) or stats[i + 1] != n + 1)}
        matches, _ = machine.read(text)
        least = min(t.least for t in machine.templates)
        assert {(n, i) for _, n, i in matches} == {(n, i) for n, i in ends if n >= least}
        for state, n, i in matches:
            want = {(t, k + n) for t, h in enumerate(held) for k in range(len(h) - n + 1) if h[k:k + n] == text[i - n:i]}
            assert set(e for e in machine.states[state].ends) == want


@pytest.mark.parametrize("label", sorted(set(NOTICE)))
def test_whole_notices_are_found(label):
    got = licenses._scan(f"Some words before. {NOTICE[label]} And after.".encode(), licenses.automaton())
    assert label in {s["label"] for s in got["spans"]} and got["score"] == 1.0


def test_changed_and_broken_notices(frame):
    mit, other = NOTICE["mit"], "plain words of nobody " * 30
    changed = mit.replace("Software", "Program")
    half = " ".join(mit.split()[:40])
    apart = " ".join(mit.split()[:45]) + " " + other + " ".join(mit.split()[45:])
    turned = " ".join(mit.split()[45:]) + " " + " ".join(mit.split()[:45])
    mid = mit.replace("subject to", "* * subject inserted words to")
    r = run(frame, [mit, changed, half, apart, turned, mid, other, (mit + "\n") * 300])
    assert r[0].labels == "mit" and r[0].spans[0].start == 0 and r[0].spans[0].end == r[0].n_words
    assert r[1].labels == "mit" and 0.8 <= r[1].score < 1
    assert [r[k].labels for k in (2, 3, 4)] == ["", "", ""] and r[2].score == 0
    assert r[5].labels == "mit" and r[6].labels == "" and r[7].labels == "mit" and len(r[7].spans) >= 300


def test_columns_and_empty_table(frame):
    df = frame([], "doc_id int, text string, places string, extra int")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "extra", "n_words", "places", "spans", "score"] and out.count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, phrases=(("...", "dots"),))
    assert licenses.scan(df.select(F.col("text").alias("body")), "body").columns[0] == "body"
