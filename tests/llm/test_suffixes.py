import random
from collections import Counter

from contentgauge.llm import suffixes

SCHEMA = "doc_id long, text string, row string, n int"


def expected(docs, length=200):
    times = Counter(t[s:s + length] for _, t in docs for s in range(len(t) - length + 1))
    out = []
    for doc, text in docs:
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            if times[text[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        runs = sum(1 for k in range(len(text)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=110):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijé") for _ in range(draw.randint(1, 9))) for _ in range(300)]

    def prose(k):
        return " ".join(draw.choice(words) for _ in range(k))

    passages, docs = [prose(draw.randint(30, 120)) for _ in range(8)], [(900, None), (901, ""), (902, "x" * 199), (903, "y" * 200)]
    for k in range(n):
        kind, other = draw.random(), draw.choice(docs)[1] or ""
        if kind < 0.15:
            text = other
        elif kind < 0.55:
            text = prose(draw.randint(0, 60))
            for _ in range(draw.randint(1, 3)):
                p = draw.choice(passages)
                text += p[draw.randint(0, 60):len(p) - draw.randint(0, 60)] + prose(draw.randint(0, 20))
        elif kind < 0.65:
            text = draw.choice(["a", "xyz "]) * draw.randint(60, 700)
        elif kind < 0.85:
            text = "".join("#" if draw.random() < 0.004 else c for c in other)
        else:
            text = prose(draw.randint(0, 200))
        docs.append((k, text))
    return docs


def check(frame, docs, **options):
    df = frame([(d, t, "x", 0) for d, t in docs], SCHEMA)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, **options).collect()]
    assert sorted(got, key=str) == expected([(d, (t or "").encode()) for d, t in docs])


def test_removed_bytes_equal_brute_force(frame):
    docs = corpus(1)
    check(frame, docs)
    check(frame, docs, crowd=3)  # crowded anchors are counted window by window


def test_many_members_of_a_group(frame):
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(330))

    def side():
        return "".join(draw.choice("ij") for _ in range(40))

    # so many different surroundings that classes are counted instead of pairs
    check(frame, [(k, side() + passage[draw.randint(0, 60):] + side()) for k in range(150)])


def test_repeated_rows_null_ids_and_empty_tables(frame):
    text = "".join(random.Random(3).choice("abcdef") for _ in range(500))
    check(frame, [(None, text), (1, text[:250]), (2, "other"), (2, "other")])
    check(frame, [(4, text + "é"), (4, text + "é")])
    check(frame, [])


def test_a_text_of_several_chunks(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    suffixes._tables.cache_clear()
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(3000))
    whole = [a.tolist() for a in suffixes.anchors(text.encode())]
    spans = sorted((p - m, p - n) for p, m, n, _ in zip(*whole))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) - 200
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))  # every window has one anchor
    suffixes._tables.cache_clear()


def test_loser_tree_merges_and_knows_common_prefixes():
    draw = random.Random(5)
    runs, everything = [], []
    for _ in range(7):
        rows = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(0, 12))).encode() for _ in range(draw.randint(0, 40))})
        everything += rows
        runs.append(iter([(suffixes.common(rows[k - 1], r) if k else 0, r, b"", False) for k, r in enumerate(rows)]))
    merged = list(suffixes.merge(runs))
    assert [m[1] for m in merged] == sorted(everything)
    assert [m[0] for m in merged][1:] == [suffixes.common(a[1], b[1]) for a, b in zip(merged, merged[1:])]
    assert list(suffixes.merge([iter([])])) == []


def test_front_coding_gives_the_entries_back():
    entries = {(b"abcabc" * 20, b"left"): 1, (b"abcabd" * 20, b""): 2, (b"abcabc" * 20, b"lefT"): 1}
    run = suffixes.Run(entries)
    assert [(r, left, t) for _, r, left, t in suffixes.read_run(run.columns())] == [(*k, n > 1) for k, n in sorted(entries.items())]
