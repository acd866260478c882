import random
import re

from pyspark.sql import functions as F

from contentgauge.llm import lines

SCHEMA = "doc_id long, text string, pos string, n_chars int"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("n", "st", "ll") for c in ("a", "es", "ing", "ö")]


def words_of(line):
    return [w for w in re.split(lines.BREAK, line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def meet(a, b):
    """Within the radius, and at most one bit apart in some block."""
    differ, at = [x != y for x, y in zip(a, b, strict=True)], 0
    blocks = []
    for width in lines.WIDTHS:
        blocks.append(sum(differ[at:at + width]))
        at += width
    return sum(differ) <= lines.RADIUS and min(blocks) <= 1


def expected(spark, docs):
    """Removed line numbers of every document, by comparing all pairs of lines."""
    found, nodes = [], {}
    for doc, text in docs:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            words = words_of(line)
            if len(line) >= lines.LETTERS and len("".join(words)) >= lines.LETTERS:
                nodes.setdefault(" ".join(words), []).append((doc, pos))
                found.append((doc, pos, " ".join(words)))
    norms = sorted(nodes)
    df = spark.createDataFrame([(n, n.split(" ")) for n in norms] or [("", [""])], "norm string, words array<string>")
    hashes = dict(df.selectExpr("norm", "transform(words, w -> xxhash64(w))").collect())
    hashes = {n: set(h) for n, h in hashes.items()}  # a word counts once
    bits = {n: [2 * sum(h >> b & 1 for h in hashes[n]) > len(hashes[n]) for b in range(lines.BITS)] for n in norms}
    parent = {n: n for n in norms}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(norms):
        for b in norms[:i]:
            longer = max(len(a), len(b))
            if 10 * abs(len(a) - len(b)) > longer or not meet(bits[a], bits[b]):
                continue
            if 10 * distance(a, b) <= longer:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    keep = {}
    for doc, pos, norm in found:
        keep[root(norm)] = min(keep.get(root(norm), (doc, pos)), (doc, pos))
    gone = {}
    for doc, pos, norm in found:
        if keep[root(norm)] != (doc, pos):
            gone.setdefault(doc, set()).add(pos)
    return gone, sum(root(n) != n for n in norms)


def corpus():
    draw = random.Random(11)
    pool = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(3, 60))) for _ in range(40)]
    docs = [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "short\nshort\nshort"), (1004, "12345 67890 12345 67890 12345\n" * 2),
            (1005, " ".join(draw.choice(WORDS) for _ in range(3000)) + "\n" + "z" * 50_000)]
    for k in range(60):
        text = []
        for _ in range(draw.randint(0, 8)):
            line = draw.choice(pool)
            if draw.random() < 0.5:  # one letter of a long line: few bits change
                at = draw.randrange(len(line))
                line = line[:at] + draw.choice("xyz") + line[at + 1:]
            text.append(draw.choice([line, line.upper(), line + " 17.", "- " + line]))
        docs.append((k, "\n".join(text)))
    return docs


def test_removed_lines_equal_brute_force(spark, frame):
    docs = corpus()
    gone, linked = expected(spark, docs)
    assert linked > 5
    out = lines.dedup(frame([(d, t, "x", len(t) if t is not None else None) for d, t in docs], SCHEMA)).collect()
    assert len(out) == len(docs)
    texts = dict(docs)
    for r in out:
        text, removed = texts[r.doc_id], gone.get(r.doc_id, set())
        if text is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
            continue
        kept = [line for k, line in enumerate(text.split("\n")) if k not in removed]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(kept), text.count("\n") + 1, len(removed)), r.doc_id
        assert r.n_chars == len(r.text)


def test_wide_counters_agree_with_narrow_ones(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 100), x -> 'w' || x) as w", "transform(sequence(1, 100), x -> xxhash64('w' || x)) as h")
    found = df.select(*[lines.folded_simhash(df["w"], w).alias(f"w{w}") for w in (9, 21, 63)]).first()
    hashes = df.first().h
    want = [2 * sum(h >> k & 1 for h in hashes) > 100 for k in range(63)]
    for got in found:
        assert [bool(got >> k & 1) for k in range(63)] == want


def test_documents_of_repeats_go(frame):
    line = "the same long line of words in every document"
    df = frame([(1, line, "", 1), (2, line.upper(), "", 1), (3, line + "\nand one line of its own that stays", "", 1), (4, None, "", 1), (None, line, "", 1)], SCHEMA)
    kept = lines.keep_new(df)
    assert kept.columns == df.columns
    # a null id comes first
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, line), (3, "and one line of its own that stays"), (4, None)}
    assert lines.keep_new(df.where("doc_id > 9")).collect() == []


def test_short_lines_differ_in_letters(spark, frame):
    """A wrong letter in ten words is far less than a tenth of the line, six of sixty letters are exactly that."""
    draw = random.Random(5)
    rows = []
    while len(rows) < 4000:
        words = [draw.choice("abcdefgh") + draw.choice("aeiou") + draw.choice(["lm", "rst", "nd"]) for _ in range(10)]
        line = " ".join(words)
        line += "o" * (60 - len(line))
        at = draw.choice([k for k, c in enumerate(line) if c != " "])
        few = line[:at] + "z" + line[at + 1:]
        tenth = line[:-6] + "zzzzzz"
        rows += [(line, few), (line, tenth)]
    sims = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", "array_distinct(split(a, ' ')) as x", "array_distinct(split(b, ' ')) as y")
    sims = sims.select("a", "b", lines.folded_simhash(sims["x"], 9).alias("s"), lines.folded_simhash(sims["y"], 9).alias("t"))
    near = [(r.a, r.b) for r in sims.where("bit_count(s ^ t) <= 2").collect()]
    near = [x for x in near if distance(*x) == 1][:3] + [x for x in near if distance(*x) == 6][:3]
    assert {distance(*x) for x in near} == {1, 6}
    rows = [(2 * k + i, x, "", 1) for k, pair in enumerate(near) for i, x in enumerate(pair)]
    out = lines.dedup(frame(rows, SCHEMA))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {k: k % 2 for k, *_ in rows}


def test_lines_of_edit_similarity_link(spark, frame, monkeypatch):
    """One word of 10 to 30 replaced by one as long: compared with edit similarity alone. Small crowds
    take the way over the most frequent line."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(4, 6)))
    pairs = []
    while len(pairs) < 150:
        words = [word() for _ in range(draw.randint(10, 30))]
        at = draw.randrange(len(words))
        other = words[:at] + ["q" * len(words[at])] + words[at + 1:]
        a, b = " ".join(words), " ".join(other)
        if 10 * distance(a, b) <= len(a):
            pairs.append((a, b))
    rows = [(2 * k + i, x, "", 1) for k, pair in enumerate(pairs) for i, x in enumerate(pair)]
    sims = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "array_distinct(split(a, ' ')) as x", "array_distinct(split(b, ' ')) as y")
    sims = sims.select("a", lines.folded_simhash(sims["x"], 9).alias("s"), lines.folded_simhash(sims["y"], 9).alias("t"))
    bits = dict(sims.selectExpr("a", "bit_count(s ^ t)").collect())
    sure = {2 * k + 1 for k, (a, _) in enumerate(pairs) if bits[a] <= 7}
    for crowd in (lines.CROWD, 0):
        monkeypatch.setattr(lines, "CROWD", crowd)
        gone = {r.doc_id for r in lines.dedup(frame(rows, SCHEMA)).collect() if r.n_removed}
        assert all(k % 2 for k in gone) and sure <= gone
        assert len(gone) >= 0.85 * len(pairs)


def test_rows_without_an_id_of_their_own(frame):
    common = "this common line of words stands in many documents"
    own = [f"document {w} has this line of its own about {w} things" for w in ("alpha alpha", "bravo bravo", "carol carol", "delta delta")]
    texts = [f"{own[0]}\n{common}", f"{common}\n{own[1]}", f"{own[2]}\nx\n{common}"]
    for ids in ((None, None, None), (7, 7, 7)):
        out = lines.dedup(frame([(i, t, "", 1) for i, t in zip(ids, texts)] + [(9, own[3], "", 1)], SCHEMA)).collect()
        assert len(out) == 4 and sum(r.n_removed for r in out) == 2
        left = [x for r in out for x in r.text.split("\n")]
        assert sorted(x for x in left if x != "x") == sorted([*own, common])
    out = lines.dedup(frame([(None, common, "", 1)] * 3, SCHEMA)).collect()
    assert sorted(r.n_removed for r in out) == [0, 1, 1]


def test_scripts_never_cost_less_than_the_distance(spark):
    rng = random.Random(3)
    words = ["a", "the", "tide", "meadow", "lantern", "river", "été", "of"]
    pairs = [([], []), (["a"], []), ([], ["the", "a"]), (["a"] * 40, ["a"] * 41), (["tide", "river"], ["river", "tide"])]
    for _ in range(300):
        x = [rng.choice(words) for _ in range(rng.randrange(1, 40))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(3)] = [rng.choice(words) for _ in range(rng.randrange(3))]
        pairs.append((x, y))
    pairs.append((["a", "tide"], ["a", "river", "tide"]))  # nothing is left of the first one
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x array<string>, y array<string>")

    def least(x, y):
        return F.levenshtein(x, y).alias("least")

    # words with their blanks: the script counts a blank with every word
    whole = [F.array_join(F.transform(c, lambda w: F.concat(w, F.lit(" "))), "") for c in ("x", "y")]
    got = rows.select("k", "x", "y", lines._script(F.col("x"), F.col("y")).alias("some"), least(*whole)).orderBy("k").collect()
    assert len(got) == len(pairs)
    assert all(r["some"] >= r["least"] for r in got)
    assert all(r["some"] == 0 for r in got if r["x"] == r["y"])
    # many scripts of a few edits are the shortest ones
    assert sum(r["some"] == r["least"] for r in got) > len(got) / 3
    # equal ends do not change the distance
    middles = lines._middles(rows).select("k", "x", "y", least(F.col("x"), F.col("y"))).orderBy("k").collect()
    assert [r["least"] for r in middles] == [r["least"] for r in got]
    assert (middles[-1]["x"], middles[-1]["y"]) == ("", "river ")


def test_short_lines_take_part(frame):
    """Repeats of any line with a word go; of 10 to 19 characters also what one edit sets apart, none under that."""
    texts = ["Chapter\n\n---\nRead more here\nlantern", "chapter:\n\n---\nRead moore here\nlanterns", "Read more hare\nread mor here\nRead it here\nlanterns!"]
    out = lines.dedup(frame([(k, t, "", len(t)) for k, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in out} == {
        0: (texts[0], 0), 1: ("\n---\nlanterns", 2), 2: ("Read it here", 3)}


def test_all_short_pairs_within_an_edit_link(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    made = []
    for _ in range(120):
        a = " ".join(word() for _ in range(3))
        at = rng.randrange(len(a))
        made += [a, rng.choice([a[:at] + "b" + a[at + 1:], a[:at] + a[at + 1:], a[:at] + "d" + a[at:]])]
    norms = [" ".join(words_of(x)) for x in made]
    parent = list(range(len(norms)))

    def root(n):
        return n if parent[n] == n else root(parent[n])

    for i, a in enumerate(norms):
        for j in range(i):
            if a == norms[j] or 9 < max(len(a), len(norms[j])) < 20 and distance(a, norms[j]) <= 1:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = lines.dedup(frame([(k, x, "", 1) for k, x in enumerate(made)], SCHEMA)).collect()
    gone = {r.doc_id for r in out if r.n_removed}
    short = {k for k, x in enumerate(norms) if len(x) < 19}
    assert len(gone & short) > 40 and gone & short == {k for k in short if root(k) != k}


def test_pairs_grow_with_the_nodes_of_a_group(frame, monkeypatch):
    """Four hundred near copies of a line are one group, whose texts are fetched for few pairs a node."""
    draw = random.Random(31)
    base = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(60)]
    rows = [(k, " ".join(base[:at] + [base[at] + "x" * (k % 7 + 1)] + base[at + 1:]), "", 1) for k, at in enumerate(
        [draw.randrange(60) for _ in range(400)])]
    stored, write = {}, lines.store

    def count(df, name):
        out = write(df, name)
        if name in ("line-pairs", "alike"):
            stored[name] = stored.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "store", count)
    got = lines.dedup(frame(rows, SCHEMA)).collect()
    nodes = len({text for _, text, _, _ in rows})
    assert nodes > 200 and sum(r.n_removed for r in got) == 399
    assert nodes - 1 <= stored["line-pairs"] <= 20 * nodes


def test_letters_never_prove_more_than_the_distance(spark):
    """Also for lines whose counts pass the end of a lane; lines of other letters are told apart."""
    rng = random.Random(12)
    line = lambda n: "".join(rng.choice("etaoinzxéß  ") for _ in range(n)).strip()
    pairs = [("", "a"), ("e" * 300, "e" * 180 + "t" * 90), ("a b c", "abc"), ("é", "z")]
    for _ in range(150):
        a = line(rng.randrange(1, 60))
        b = a
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + rng.choice(["", "e", " ", "é", "to"]) + b[at + rng.randrange(3):]
        pairs += [(a, b), (a, line(len(a) + 1))]
    rows = spark.createDataFrame(pairs, "x string, y string")
    sides = [dict(zip(("bag1", "bag2"), lines.bags(F.col(c), F.char_length(c), F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))), strict=True)) for c in ("x", "y")]
    got = rows.select("x", "y", lines._apart(*sides).alias("least"), F.levenshtein("x", "y").alias("d")).collect()
    assert len(got) == len(pairs) and all(0 <= r.least <= r.d for r in got)
    assert sum(r.least for r in got) > 0.3 * sum(r.d for r in got)
    assert [r.least for r in got if len(r.x) == 300] == [63]


def test_a_pair_meets_once_and_only_where_letters_allow(spark):
    """Nodes that share all four blocks come from the join of the first alone; of two lines alike in bits, but not in letters, nothing comes."""
    rng = random.Random(4)
    base = rng.getrandbits(lines.BITS)
    sims = [base, base, base ^ 1, base ^ 1 << 20 ^ 3, base ^ 0b111 ^ 7 << 20, rng.getrandbits(lines.BITS)]
    texts = ["the tide of the river turns at noon near the old mill"] * 6
    rows = [(k, sim, text, k) for k, (sim, text) in enumerate(zip(sims, texts, strict=True))]
    rows.append((9, base, "xyz wv qqq kk zzz bbbbb jjjjj vvv xx yyyy kkk ffff zz", 9))
    nodes = spark.createDataFrame(rows, "id long, sim long, norm string, root long").withColumn("chars", F.char_length("norm"))
    bag1, bag2 = lines.bags(F.col("norm"), F.col("chars"), F.size(F.split("norm", " ")) - 1)
    nodes = nodes.withColumns({"bag1": bag1, "bag2": bag2}).localCheckpoint()
    codes = lines._codes(lines.SIMILAR)
    met = [[(r.a, r.b) for r in lines._met_first(nodes, codes, k, lines.RADIUS, lines.SIMILAR).collect()] for k in range(4)]
    bits = [[s >> b & 1 for b in range(lines.BITS)] for s in sims]
    want = {(a, b) for b in range(6) for a in range(b) if meet(bits[a], bits[b])}
    found = [p for pairs in met for p in pairs]
    assert len(want) == 10 and sorted(found) == sorted(want)
    assert (0, 1) in met[0]


def test_parts_of_the_probes_share_no_pair_and_lose_none(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(lines.BITS) for _ in range(4)]
    sims = [b ^ 1 << rng.randrange(lines.BITS) ^ 1 << rng.randrange(lines.BITS) for b in base for _ in range(12)]
    rows = [(k, sim, k, 50 + k % 5, 0, 0) for k, sim in enumerate(sims)]
    nodes = spark.createDataFrame(rows, "id long, sim long, root long, chars int, bag1 long, bag2 long").localCheckpoint()
    codes = lines._codes(lines.SIMILAR)
    assert all(len(probes) == lines.PARTS > 1 for _, probes in codes)
    parts = [lines._met_first(nodes, codes, 1, lines.RADIUS, lines.SIMILAR, range(k, k + 1)).collect() for k in range(lines.PARTS)]
    whole = lines._met_first(nodes, codes, 1, lines.RADIUS, lines.SIMILAR).collect()
    assert all(parts) and sorted(p for part in parts for p in part) == sorted(whole)
    assert len(set(whole)) == len(whole)


def test_neighbours_in_one_group_already_are_not_judged(frame, monkeypatch):
    """Near copies that all link with their bucket's most frequent line need no other pairs."""
    rng, judged, alike = random.Random(5), [], lines._alike
    words = rng.choices(WORDS, k=60)

    def copy(k):
        return " ".join([*words[:k], "zu", *words[k + 1:]])

    def count(pairs, *rest):
        judged.append(pairs.distinct().count())
        return alike(pairs, *rest)

    monkeypatch.setattr(lines, "_alike", count)
    docs = [(k, " ".join(words), "x", 1) for k in range(3)] + [(3 + k, copy(k), "x", 1) for k in range(50)]
    left = lines.dedup(frame(docs, SCHEMA)).where("n_removed = 0").collect()
    assert [r.doc_id for r in left] == [0]
    assert sum(judged) < 3 * 51


def test_equal_lines_are_hashed_once(frame, monkeypatch):
    """Two hundred lines with two texts: two are turned into words, letters and SimHashes."""
    hashed, own = [], lines.hashed

    def count(texts):
        hashed.append(texts.count())
        return own(texts)

    monkeypatch.setattr(lines, "hashed", count)
    out = lines.dedup(frame([(k, "a line that stands in every document\nAnother one, of other words.", "", 1) for k in range(100)], SCHEMA))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {k: 2 * (k > 0) for k in range(100)}
    assert hashed == [2]
