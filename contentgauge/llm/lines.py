"""Fuzzy line dedup with DataFrame operations only.

A line is normalised to its lower-case letter words. Its SimHash has 63 bits: every different word adds
its hash bits to counters that lie side by side in a few longs, so a word costs a handful of integer
operations (words that a line repeats count once: the few that stand everywhere would make all
SimHashes alike). Equal normalised lines are one node. Pairs within the radius that belongs to the edit
similarity asked for are compared by edit distance in characters, and of every connected group the
first occurrence stays.

Nodes meet in one of four blocks of 15 or 16 bits, where they agree or differ in one bit: each also
looks where a bit it lacks is set. Seven differing bits always leave such a block, eight in 95 % of
cases, nine in 84 %. The key also holds a band of line lengths; a node looks in every band that
holds a length within the similarity. Blocks are joined one after the other, each by ``PARTS`` parts of its probes, and write
the pairs that no block before them holds. The join drops pairs that letters alone prove too far apart: an edit changes two counts of letters by one.

Every line with a word takes part. In a line of few words one edit changes many bits, so lines short enough that one
edit is all they may differ in also meet by their texts with a character left out: such pairs are all found.

The lines of a large group of near copies are not paired off: every node is first compared with the most
frequent line of each of its buckets, and what these links connect is one group. Nodes of different groups are then compared
with a few that lie next to them in a bucket when ordered by the other bits, which makes the groups larger. Afterwards only nodes
of different groups are compared, so the pairs grow with the nodes, not with the square of a group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentgauge.llm.common import components, forget, store, store_texts
from contentgauge.operators.shape import once

BITS, WIDTHS = 63, (16, 16, 16, 15)
SIMILAR = 0.9


def radius_of(similar: float) -> int:
    """Bits in which the SimHashes of two lines differ that have this share of their words in common, and a
    standard deviation more."""
    share = math.acos(similar) / math.pi
    return math.ceil(BITS * share + math.sqrt(BITS * share * (1 - share)))


RADIUS = radius_of(SIMILAR)
CROWD = 2  # the nodes of a bucket of more are first compared with its most frequent line
NEIGHBOURS = 3  # nodes before it in an order of its bucket that a node is first compared with
PARTS = 3  # of a block's probes, one after the other: what is dealt at once is all the disk holds
COLUMNS = ("id", "sim", "chars", "root", "bag1", "bag2")
# letters, bits of a count (the highest one stays free), counts in a long
LETTERS_COUNTED, LANE, LANES = "etaoinshrldcumg", 7, 9
LETTERS = 1  # a line without any has no words to compare
LOOK = 3  # words in which an edit script looks for the next equal one
NARROW, WIDE = 9, 21  # bits of a counter
# ASCII characters that are no letters end a word
BREAK = r"[\x00-@\[-`{-\x7f]+"


def _lanes(width: int) -> int:
    return sum(1 << (width * k) for k in range(BITS // width))


def _counters(h: Column, width: int) -> list[Column]:
    """What a hash adds to counters ``width`` bits wide, lying side by side in ``width`` longs."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_lanes(width))) for k in range(width)]


def _majority(counters: list[Column], n: Column, width: int) -> Column:
    """Bits set in over half of ``n`` hashes; good for n below 2^(width - 1)."""
    one = F.lit(_lanes(width))
    # a count above n / 2 carries into the counter's highest bit
    carry = (F.lit((1 << (width - 1)) - 1) - F.floor(n / F.lit(2))) * one
    out = F.lit(0).cast("long")
    for k in range(width):
        high = F.shiftrightunsigned(counters[k] + carry, width - 1).bitwiseAND(one)
        out = out.bitwiseOR(F.shiftleft(high, k))
    return out


def folded_simhash(words: Column, width: int) -> Column:
    """SimHash of an array of words, folded inside the row."""
    def add(state: Column, h: Column) -> Column:
        return F.struct(*[(state[f"c{k}"] + c).alias(f"c{k}") for k, c in enumerate(_counters(h, width))])

    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(width)])
    return F.aggregate(F.transform(words, lambda w: F.xxhash64(w)), zero, add, lambda state: _majority(
        [state[f"c{k}"] for k in range(width)], F.size(words), width))


def counted(norm: Column, chars: Column, blanks: Column) -> Column:
    """bag1 and bag2: two longs with the counts of ``LETTERS_COUNTED``, of blanks and of all other characters in a line, side by side."""
    def step(state: Column, c: Column) -> Column:  # what is counted goes, so every letter is looked for in less text
        return F.struct(F.replace(state["rest"], c, F.lit("")).alias("rest"), F.concat(state["sizes"], F.array(F.octet_length(state["rest"]))).alias("sizes"))

    def packed(state: Column) -> Column:
        sizes = [F.get(state["sizes"], k) for k in range(len(LETTERS_COUNTED))] + [F.octet_length(state["rest"])]
        top = F.lit((1 << (LANE - 1)) - 1)
        counts = [a - b for a, b in zip(sizes, sizes[1:])]
        # blanks are the most frequent: what does not fit their lane goes to another
        counts += [blanks, F.greatest(blanks - top, F.lit(0)), chars - blanks - (sizes[0] - sizes[-1])]
        lanes = [F.least(c, top).cast("long") for c in counts]
        return F.struct(*[reduce(Column.bitwiseOR, [F.shiftleft(c, LANE * k) for k, c in enumerate(lanes[at:at + LANES])]).alias(name)
                          for at, name in ((0, "bag1"), (LANES, "bag2"))])

    start = F.struct(F.replace(norm, F.lit(" "), F.lit("")).alias("rest"), F.array().cast("array<int>").alias("sizes"))
    return F.aggregate(F.array(*[F.lit(c) for c in LETTERS_COUNTED]), start, step, packed)


def bags(norm: Column, chars: Column, blanks: Column) -> list[Column]:
    """``counted`` as two columns."""
    both = counted(norm, chars, blanks)
    return [both["bag1"], both["bag2"]]


def _apart(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Never above the edit distance of two lines: an edit takes one from a count or adds one to a count, or both. Counts that
    reach a lane's end differ by less than they would."""
    free = F.lit(sum(1 << (LANE * k + LANE - 1) for k in range(LANES)))
    even = F.lit(sum(((1 << LANE) - 1) << (LANE * k) for k in range(0, LANES, 2)))

    def more(a: Column, b: Column) -> Column:  # per lane what a has more than b
        lanes = a.bitwiseOR(free) - b  # the free bit stays where a is not less
        kept = lanes.bitwiseAND(free)
        return lanes.bitwiseAND(kept - F.shiftright(kept, LANE - 1))

    def total(x: dict[str, Column], y: dict[str, Column]) -> Column:
        lanes = more(x["bag1"], y["bag1"]) + more(x["bag2"], y["bag2"])  # two counts fill a lane at most
        # lanes of twice the width: the remainder of what is one below their base is their sum
        return (lanes.bitwiseAND(even) + F.shiftright(lanes, LANE).bitwiseAND(even)) % F.lit((1 << 2 * LANE) - 1)

    return F.greatest(total(x, y), total(y, x))


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), BREAK), "")


ROW = ("_h1", "_h2", "_copy")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with a key of every row (``ROW``), whether ids are null, shared or unique: a 128-bit hash
    of id and text, and a stored number for rows that agree in both."""
    of = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    rows = docs.withColumns({"_h1": F.xxhash64(*of), "_h2": F.xxhash64(F.lit(1), *of), "_copy": F.lit(0).cast("long")})
    twins = rows.where(F.col(text).isNotNull()).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
    twins = store(twins.where("n > 1").drop("n"), "twins")
    if twins.isEmpty():
        return rows
    again = rows.join(twins, ["_h1", "_h2"], "left_semi").withColumn("_copy", F.monotonically_increasing_id())
    return rows.join(twins, ["_h1", "_h2"], "left_anti").unionByName(store(again, "twin-rows"))


def _short(similar: float) -> tuple[int, int]:
    """Lengths of lines that may differ in one edit at most, the shortest one character shorter."""
    share = max(round((1 - similar) * 1000), 1)
    return -(-1000 // share) - 1, -(-2000 // share) - 1


def read_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(``ROW``, doc_id, pos, norm, k1, k2, chars, id) of all lines with a letter; (k1, k2) is
    the 128-bit key of the normalised line ``norm``, ``id`` a number of the line, the same where it is stored."""
    rows = docs.select(*ROW, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = rows.select(*ROW, "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = once(lines.where(F.char_length("line") >= LETTERS), words=line_words(F.col("line"))).drop("line")
    norms = once(words, norm=F.array_join("words", " ")).where(F.char_length("norm") >= LETTERS)
    return norms.withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), F.col("words")),
        "chars": F.char_length("norm"), "id": F.monotonically_increasing_id()}).drop("words")


def hashed(texts: DataFrame) -> DataFrame:
    """(id, n, chars, sim, bag1, bag2) of nodes with their texts (id, n, chars, norm).

    The counters of a line are sums over its words: rows of words are added up by the hash
    aggregate, which costs a few instructions a counter; its key is short, as it is looked up for every word. Lines of more
    than 255 words, rare ones, are folded in the row, with wider counters. Words count once a line.
    """
    lines = once(texts, words=F.split("norm", " "))
    lines = once(lines, different=F.array_distinct("words"), bags=counted(F.col("norm"), F.col("chars"), F.size("words") - 1)).drop("words", "norm")
    lines = lines.withColumns({"w_n": F.size("different"), "bag1": F.col("bags.bag1"), "bag2": F.col("bags.bag2")}).drop("bags")
    few = F.col("w_n") < 1 << (NARROW - 1)
    long_ = F.when(few, F.lit(None).cast("long")).when(F.col("w_n") < 1 << (WIDE - 1), folded_simhash(F.col("different"), WIDE)).otherwise(
        folded_simhash(F.col("different"), BITS))
    out = ["id", "n", "chars", "bag1", "bag2"]
    keys = [*out, "w_n", "folded"]
    words = once(lines, folded=long_).select(*keys, F.explode(
        F.when(few, F.col("different")).otherwise(F.array(F.lit("")))).alias("w"))
    sums = words.withColumn("h", F.xxhash64("w")).groupBy(*keys).agg(
        *[F.sum(F.when(few, c).otherwise(0)).alias(f"c{k}") for k, c in enumerate(_counters(F.col("h"), NARROW))])
    narrow = _majority([F.col(f"c{k}") for k in range(NARROW)], F.col("w_n"), NARROW)
    return sums.select(*out, F.coalesce("folded", narrow).alias("sim"))


def _place() -> Column:
    """(doc_id, pos) as one number in their order, a null id first: sums and minima of numbers are
    kept in place by the hash aggregate."""
    return (_order().cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(20,0)") + F.col("pos")).cast("decimal(38,0)")


def _order() -> Column:
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def _script(x: Column, y: Column) -> Column:
    """Characters that one way of turning the words ``x`` into ``y`` edits, in their texts joined by blanks.

    Words are taken in turn. Where they differ, the nearest equal word among the next ``LOOK`` of
    either side tells what was put in or taken out, otherwise one word is rewritten as the
    other. Never below the edit distance, as it is the cost of a valid script.
    """
    def cost(words: Column) -> Column:  # each with its blank
        return F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w) + 1)

    def step(s: Column, w: Column) -> Column:
        here = F.get(y, s["at"])
        put = F.array_position(F.slice(y, s["at"] + 2, F.lit(LOOK)), w).cast("int")
        out = F.array_position(F.slice(x, s["i"] + 2, F.lit(LOOK)), here).cast("int")

        def to(at: Column, more: Column) -> Column:
            return F.struct((s["i"] + 1).alias("i"), at.alias("at"), (s["n"] + more).alias("n"))

        gone = here.isNull() | ((out > 0) & ((put == 0) | (out <= put)))
        return F.when(here == w, to(s["at"] + 1, F.lit(0))).when(gone, to(s["at"], F.char_length(w) + 1)).when(
            put > 0, to(s["at"] + put + 1, cost(F.slice(y, s["at"] + 1, put)))).otherwise(
            to(s["at"] + 1, F.levenshtein(w, here)))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(x, start, step, lambda s: s["n"] + cost(F.slice(y, s["at"] + 1, F.size(y))))


def _lead(x: Column, y: Column) -> Column:
    """Number of equal elements at the beginning of two arrays."""
    other = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(other > 0, other - 1).otherwise(F.size(x)).cast("int")


def _middles(rows: DataFrame) -> DataFrame:
    """``rows`` with the words ``x`` and ``y`` as texts, without the equal words at both ends. Every word keeps its
    blank, so the texts are as far apart as the whole ones, also where nothing is left of one."""
    others = [c for c in rows.columns if c not in ("x", "y")]

    def without(rows: DataFrame, n: Column) -> DataFrame:
        rows = once(rows, n=n)
        return rows.select(*others, *[F.slice(w, F.col("n") + 1, F.size(w)).alias(w) for w in ("x", "y")])

    rest = without(rows, _lead(F.col("x"), F.col("y")))
    rest = without(rest.withColumns({w: F.reverse(w) for w in ("x", "y")}), _lead(F.col("x"), F.col("y")))
    texts = {f"{w}_text": F.array_join(F.transform(F.reverse(w), lambda v: F.concat(v, F.lit(" "))), "") for w in ("x", "y")}
    return once(rest, **texts).select(*others, F.col("x_text").alias("x"), F.col("y_text").alias("y"))


def _alike(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) whose edit distance in characters is at most (1 - similar) of the longer line.

    A pair that some script of word edits keeps within the limit is alike; only for the others is
    the distance itself found, between what is left without the equal words at both ends (they do
    not change it).
    """
    pairs = store(pairs.select("a", "b").distinct(), "line-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # the ids are few next to the texts: these are not sorted
    found = store(texts.select("id", "norm").join(ids.hint("shuffle_hash"), "id"), "line-texts")
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a")
    both = both.join(found.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    # in integers: 1 - 0.9 is less than a tenth
    longer = F.greatest(F.char_length("x"), F.char_length("y")).cast("long")
    limit = F.floor(longer * F.lit(round((1 - similar) * 1000)) / F.lit(1000)).cast("int")
    both = both.withColumn("limit", limit).where(F.abs(F.char_length("x") - F.char_length("y")) <= limit)
    both = once(both.select("a", "b", "limit", F.split("x", " ").alias("x"), F.split("y", " ").alias("y")), some=_script(F.col("x"), F.col("y")))
    judged = store(both.select("a", "b", "limit", (F.col("some") <= F.col("limit")).alias("near"),
        F.when(F.col("some") > F.col("limit"), F.col("x")).alias("x"), F.when(F.col("some") > F.col("limit"), F.col("y")).alias("y")), "judged")
    rest = _middles(judged.where(~F.col("near")))
    # -1 beyond the limit, which also bounds the work
    within = rest.where(F.expr("levenshtein(x, y, limit) >= 0")).select("a", "b")
    alike = store(judged.where("near").select("a", "b").unionByName(within), "alike")
    forget(pairs, found, judged)
    return alike


def _bands(similar: float) -> tuple[Column, Column, Column]:
    """Band of lengths of a node, and the first and last band that hold similar lengths."""
    step = max(-math.log(similar), 0.01) * 1.000001  # lengths of similar lines differ by this factor at most
    size = F.log(F.col("chars").cast("double"))
    return tuple(F.greatest(F.floor(x / (6 * step)), F.lit(0)).cast("int") for x in (size, size - step, size + step))


def _codes(similar: float) -> list[tuple[Column, list[Column]]]:
    """Per block (bucket, probes): where a node is, and ``PARTS`` arrays of where it looks for others, no place twice, and nulls; the
    arrays take the last two of ``_bands`` from columns ``low`` and ``high``."""
    here = _bands(similar)[0]

    def code(block: int, value: Column, band: Column) -> Column:
        return ((F.lit(block << 16).bitwiseOR(value)) * 4096 + band).cast("long")

    low, high = F.col("low"), F.col("high")

    def looks(block: int, values: list[tuple[Column, Column]]) -> Column:
        # columns, not functions of arrays: these are compiled
        return F.array(*[F.when(new & there, code(block, value, at)) for at, there in ((low, F.lit(True)), (high, low != high)) for value, new in values])

    out, at = [], 0
    for block, width in enumerate(WIDTHS):
        value = F.shiftrightunsigned("sim", at).bitwiseAND(F.lit((1 << width) - 1))
        # of two values that differ in one bit, the one without it looks for the other
        bits = [[(value.bitwiseOR(F.lit(1 << k)), value.bitwiseAND(F.lit(1 << k)) == 0) for k in range(part, width, PARTS)] for part in range(PARTS)]
        bits[0].insert(0, (value, F.lit(True)))
        out.append((code(block, value, here), [looks(block, values) for values in bits]))
        at += width
    return out


def _near(x: dict[str, Column], y: dict[str, Column], radius: int, similar: float) -> Column:
    """Near in bits, length and letters, and not of one root."""
    bits = F.bit_count(x["sim"].bitwiseXOR(y["sim"])) <= radius
    limit = F.greatest(x["chars"], y["chars"]).cast("long") * F.lit(round((1 - similar) * 1000))
    alike = F.abs(x["chars"] - y["chars"]) * F.lit(1000) <= limit
    return bits & alike & (x["root"] != y["root"]) & (_apart(x, y) * F.lit(1000) <= limit)


def _sides(x: DataFrame, y: DataFrame) -> tuple[list[DataFrame], list[dict[str, Column]]]:
    # never null: a short condition is compiled, one with a check for every step is not
    sides = [rows.select("code", *[F.coalesce(c, F.lit(0)).alias(f"{side}_{c}") for c in COLUMNS]) for rows, side in ((x, "a"), (y, "b"))]
    return sides, [{c: F.col(f"{side}_{c}") for c in COLUMNS} for side in "ab"]


def _met(x: DataFrame, y: DataFrame, radius: int, similar: float) -> DataFrame:
    """Pairs (a, b) of the nodes of two tables that share a bucket and are near."""
    sides, columns = _sides(x, y)
    pairs = sides[0].alias("l").join(sides[1].hint("shuffle_hash").alias("r"), (F.col("l.code") == F.col("r.code")) & _near(*columns, radius, similar))
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _met_first(
    nodes: DataFrame, codes: list[tuple[Column, list[Column]]], block: int, radius: int, similar: float, parts: range = range(PARTS),
) -> DataFrame:
    """Pairs (a, b) of nodes that are near and meet in a block, by these parts of its probes, and in none before it, each once."""
    bucket, probes = codes[block]
    _, low, high = _bands(similar)
    looking = once(nodes.select(*COLUMNS), low=low, high=high)
    sides, (x, y) = _sides(looking.select(*COLUMNS, F.explode(F.concat(*[probes[k] for k in parts])).alias("code")).where("code is not null"), nodes.select(*COLUMNS, bucket.alias("code")))
    differ, at, apart = x["sim"].bitwiseXOR(y["sim"]), 0, []
    for width in WIDTHS[:block + 1]:
        apart.append(F.bit_count(differ.bitwiseAND(F.lit(((1 << width) - 1) << at))))
        at += width
    # where the block's bits are equal both look for the other
    new = reduce(Column.__and__, [n > 1 for n in apart[:-1]], (apart[-1] > 0) | (x["id"] < y["id"]))
    # a node is in one bucket and looks in many: the probes are not sorted
    pairs = sides[0].alias("l").join(sides[1].hint("shuffle_hash").alias("r"), (F.col("l.code") == F.col("r.code")) & _near(x, y, radius, similar) & new)
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _short_pairs(texts: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of short lines whose texts, or those with a character left out, agree: all that one edit
    sets apart. Different lines that share such a text are no more than its places times the alphabet."""
    text = F.col("norm")
    rests = F.transform(F.sequence(F.lit(0), F.char_length(text)), lambda i: F.xxhash64(
        F.concat(F.substr(text, F.lit(1), i), F.substr(text, i + 2))))
    rests = texts.where(F.col("chars").between(*_short(similar))).select("id", F.explode(F.array_distinct(rests)).alias("code"))
    rests = store(rests, "short-lines")
    met = rests.select("code", F.col("id").alias("a")).join(rests.select("code", F.col("id").alias("b")), "code")
    met = store(met.where("a < b").select("a", "b").distinct(), "short-pairs")
    forget(rests)
    return met


def _adjacent(nodes: DataFrame, codes: list[tuple[Column, list[Column]]], radius: int, similar: float) -> DataFrame:
    """Pairs (a, b) of nodes that follow one another in a bucket, by the bits before and behind the bucket's own."""
    pairs, at = [], 0
    for (bucket, _), width in zip(codes, WIDTHS, strict=True):
        turned = [F.shiftleft("sim", BITS - k).bitwiseOR(F.shiftrightunsigned("sim", k)).bitwiseAND(F.lit((1 << BITS) - 1))
                  for k in (at, (at + width) % BITS, (at + width + BITS // 2) % BITS)]
        rows = nodes.select(*COLUMNS, bucket.alias("code"), *[t.alias(f"t{k}") for k, t in enumerate(turned)])
        lags = [F.lag(F.struct(*COLUMNS), k).over(Window.partitionBy("code").orderBy(f"t{t}", "id"))
                for t in range(len(turned)) for k in range(1, NEIGHBOURS + 1)]
        met = rows.select(F.struct(*COLUMNS).alias("x"), F.array(*lags).alias("y")).select("x", F.explode("y").alias("y"))
        met = met.where(_near({c: F.col(f"x.{c}") for c in COLUMNS}, {c: F.col(f"y.{c}") for c in COLUMNS}, radius, similar))
        pairs.append(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
        at += width
    return reduce(DataFrame.unionByName, pairs).distinct()


def links(texts: DataFrame, nodes: DataFrame, radius: int, similar: float) -> DataFrame:
    """Links (a, b) that connect the ids of different normalised lines (``hashed`` nodes and their texts) as all links between them would."""
    codes = _codes(similar)
    own = nodes.withColumn("root", F.col("id")).select(*COLUMNS, "n")
    members = own.select(*COLUMNS, "n", F.explode(F.array(*[bucket for bucket, _ in codes])).alias("code"))
    leads = members.groupBy("code").agg(F.max_by(F.struct(*COLUMNS), F.struct("n", "id")).alias("lead"), F.count(F.lit(1)).alias("size"))
    leads = leads.where(F.col("size") > CROWD).select("code", "lead.*")
    few = [store(_met(members, leads, radius, similar), "led"), _short_pairs(texts, similar)]
    roots = _grown(None, few, texts, similar)
    # a pair within a group that is connected already needs no link of its own
    rooted = _rooted(own, roots)
    near = [store(_adjacent(rooted, codes, radius, similar), "adjacent")]
    forget(rooted)
    roots = _grown(roots, near, texts, similar)
    rooted = _rooted(own, roots)
    met = [store(_met_first(rooted, codes, block, radius, similar, range(part, part + 1)), "met")
           for block in range(len(codes)) for part in range(PARTS)]
    far = _alike(reduce(DataFrame.unionByName, met), texts, similar)
    forget(rooted, *met)
    return roots.unionByName(far)


def _grown(roots: DataFrame | None, pairs: list[DataFrame], texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b), b the root of a, of the groups that ``roots`` and the alike ones of ``pairs`` connect."""
    close = _alike(reduce(DataFrame.unionByName, pairs), texts, similar)
    found = components(close if roots is None else roots.unionByName(close))
    forget(close, *pairs)
    return found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("a").alias("id"), F.col("b").alias("known"))
    rooted = nodes.join(known, "id", "left").withColumn("root", F.coalesce("known", "id"))
    return store(rooted.select(*COLUMNS), "rooted")


def repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None, similar: float = SIMILAR,
) -> DataFrame:
    """(``ROW``, pos) of ``keyed`` documents: every line whose group has an earlier one, by doc_id (an
    integer, nulls first), line number and, where rows share an id, the row's key."""
    texts = store_texts(read_lines(docs, doc_id, text), "texts")
    found = store(texts.select(*ROW, "doc_id", "pos", "k1", "k2", "id"), "lines")
    placed = found.withColumn("place", _place())
    # equal lines are one node, with the number of one of them
    nodes = store(placed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.min("id").alias("id")), "nodes")
    own = store_texts(texts.select("id", "norm", "chars").join(nodes.select("id", "n").hint("shuffle_hash"), "id"), "node-texts")
    forget(texts)
    hashes = store(hashed(own), "hashes")
    radius = radius_of(similar) if radius is None else radius
    groups = components(links(own, hashes, radius, similar)).select(F.col("node").alias("id"), "root")
    # lines with company: several occurrences, or a link
    forget(own, hashes)
    grouped = nodes.join(groups, "id", "left").where(
        F.col("root").isNotNull() | (F.col("n") > 1)).withColumn("root", F.coalesce("root", "id"))
    grouped = grouped.select("k1", "k2", "place", "root")
    keep = grouped.groupBy("root").agg(F.min("place").alias("keep"))
    keep = grouped.join(keep, "root").select("k1", "k2", "root", "keep")
    rows = placed.join(keep, ["k1", "k2"])
    gone = rows.where(F.col("place") != F.col("keep")).select(*ROW, "pos")
    # rows that share an id can share the first place
    tied, row = rows.where(F.col("place") == F.col("keep")), F.struct(*ROW)
    several = tied.groupBy("root").agg(F.count(F.lit(1)).alias("ties"), F.min(row).alias("first"))
    several = store(several.where("ties > 1").select("root", "first"), "ties")
    if not several.isEmpty():
        gone = gone.unionByName(tied.join(several, "root").where(row != F.col("first")).select(*ROW, "pos"))
    gone = store(gone, "gone")
    forget(found, nodes, several)
    return gone


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None, similar: float = SIMILAR,
) -> DataFrame:
    """The documents without repeated lines, with ``n_lines`` and ``n_removed`` added.

    Lines without a letter stay. A null text stays null and has no lines.
    Rows that share an id (null included) are documents of their own. Columns of the two
    names are replaced; ``n_chars`` follows the text where it is there.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = keyed(docs, doc_id, text)
    gone = repeated_lines(rows, doc_id, text, radius, similar).groupBy(*ROW).agg(F.collect_list("pos").alias("_gone"))
    both = rows.join(gone, [*ROW], "left").withColumn("_lines", F.split(F.col(text), "\n"))
    lines = F.col("_lines")  # a column: an expression would be split again for every line
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    cut = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = both.withColumns({
        "_cut": cut, "_n": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "_m": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    new = {text: F.col("_cut")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(
            F.char_length("_cut").cast(docs.schema["n_chars"].dataType))
    return out.select(
        *[new.get(c, F.col(c)).alias(c) for c in names],
        F.when(F.col(text).isNull(), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.when(F.col("_m") < 0, 0).otherwise(F.col("_m")).cast("long").alias("n_removed"))


def keep_new(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; those that lose every line with a letter or digit go."""
    left = F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[\p{L}\p{N}]"))
    cut = once(dedup(docs), _left=(F.col("n_removed") == 0) | left)
    return cut.where("_left").select(*docs.columns)
