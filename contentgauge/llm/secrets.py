"""Secrets in texts: patterns, and entropy of sliding windows over candidate strings.

All of it is column expressions. Texts are first asked for a literal every match must hold, so
the patterns run on few of them. Positions come from the lengths of the matches and of what lies
between them. The window's Shannon entropy is kept up to date from one character to the next: the
counts of the character that enters and of the one that leaves change, nothing is counted anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
MASK = "[SECRET]"


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``alphabet``; a window of ``window`` characters whose entropy
    reaches ``bits`` is suspect. ``needs`` must occur in the candidate."""

    alphabet: str
    window: int
    bits: float
    needs: str

    @property
    def run(self) -> str:
        return f"[{self.alphabet}]{{{self.window},}}"


CLASSES = (
    CharClass("0-9A-Fa-f", 32, 3.0, "[0-9]"),
    CharClass("0-9A-Za-z+/_=-", 24, 4.0, "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
)
# no secrets: sample values, UUIDs, plain counting, web and mail names; a pattern that begins the
# candidate speaks of all of it, any other of the windows that overlap its match
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|redacted",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|abcdefghijkl|(.)\1{5,}",
    r"(?i)^(https?|www)[/_=-]",
)
WHOLE = tuple(p for p in ALLOWED if p.startswith("(?i)^"))
PARTS = tuple(p for p in ALLOWED if p not in WHOLE)
SPAN = "array<struct<start: bigint, end: bigint, kind: int>>"


def _length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """All matches of ``pattern`` that ``keep`` accepts, as spans in code points."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), _length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(_length(x["match"]), F.lit(0).cast("long"))
        wanted = x["match"].isNotNull() & (keep(x["match"]) if keep else F.lit(True))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        out = F.when(wanted, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(found, begin, step, lambda state: state["out"])


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    lower = F.lower(text)
    words = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in ASSIGN_WORDS])
    return F.concat(
        _where(words, _spans(text, ASSIGN, 0, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6)),
        _where(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)),
        _where(F.rlike(text, F.lit(HEX)), _spans(text, HEX, 2)),
    )


def allowed_spans(candidate: Column) -> Column:
    """The matches of every pattern of ``PARTS``, an array each, in order of their start."""
    return F.array(*[_where(F.rlike(candidate, F.lit(p)), _spans(candidate, p, 3)) for p in PARTS])


def outside(spans: Column, base: Column) -> Column:
    """What the base spans leave of the spans, as far as a whole window of the span's class is left (``least``).

    Both in order of their start; spans do not overlap each other. One pass: the state holds the span
    that is open and the furthest end of a base span.
    """
    none = F.lit(None).cast("struct<start: bigint, end: bigint, least: int>")
    both = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(0).alias("least"))),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["least"].alias("least")))))

    def put(out: Column, start: Column, end: Column, least: Column) -> Column:
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(3).alias("kind"))
        return F.when(end - start >= least, F.concat(out, F.array(span))).otherwise(out)

    def step(state: Column, x: Column) -> Column:
        open_ = state["open"]
        is_base, cuts = x["least"] == 0, open_["end"] > x["start"]
        out = F.when(open_.isNull() | (is_base & ~cuts), state["out"]).when(
            is_base, put(state["out"], open_["start"], x["start"], open_["least"])).otherwise(
            put(state["out"], open_["start"], open_["end"], open_["least"]))
        covered = F.greatest(state["covered"], F.when(is_base, x["end"]).otherwise(F.lit(0).cast("long")))
        rest = F.struct(F.greatest(open_["start"], x["end"]).alias("start"), open_["end"].alias("end"), open_["least"].alias("least"))
        begun = F.struct(F.greatest(x["start"], state["covered"]).alias("start"), x["end"].alias("end"), x["least"].alias("least"))
        next_ = F.when(~is_base, F.when(begun["start"] < begun["end"], begun).otherwise(none)).when(
            open_.isNull() | ~cuts, open_).when(rest["start"] < rest["end"], rest).otherwise(none)
        return F.struct(next_.alias("open"), covered.alias("covered"), out.alias("out"))

    begin = F.struct(none.alias("open"), F.lit(0).cast("long").alias("covered"), F.array().cast(SPAN).alias("out"))
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(3).alias("kind")))
    return F.when(F.size(base) == 0, plain).otherwise(F.aggregate(both, begin, step, lambda state: F.when(
        state["open"].isNull(), state["out"]).otherwise(
        put(state["out"], state["open"]["start"], state["open"]["end"], state["open"]["least"]))))


def hot_windows(candidate: Column, allowed: Column, kind: CharClass) -> Column:
    """Spans (relative to the candidate) covered by windows of high entropy that meet no allowed span,
    overlapping ones united.

    The state holds the count of every character and the sum of c log2 c over the window; the
    entropy is log2 w - sum / w. Characters are ASCII and counted by their code. It also holds, per pattern of
    allowed spans, how many of them have begun, and where the furthest ends: a character costs the same
    however long the candidate is and whatever is allowed in it.
    """
    w = kind.window
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    limit = w * (math.log2(w) - kind.bits)  # the sum at which the entropy is exactly ``bits``
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))

    def term(n: Column) -> Column:
        return F.element_at(terms, n + 1)

    def step(state: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        entered = F.element_at(state["n"], new + 1)
        total = state["sum"] + term(entered + 1) - term(entered)
        left = F.element_at(state["n"], old + 1) + (old == new).cast("int")
        total = F.when(old >= 0, total - term(left) + term(left - 1)).otherwise(total)
        counts = F.transform(state["n"], lambda c, i: c + (i == new).cast("int") - (i == old).cast("int"))
        end = state["at"] + 1
        begins = [F.get(F.get(allowed, F.lit(p)), F.element_at(state["begun"], p + 1)) for p in range(len(PARTS))]
        here = [F.coalesce(b["start"] == state["at"], F.lit(False)) for b in begins]
        begun = F.array(*[F.element_at(state["begun"], p + 1) + h.cast("int") for p, h in enumerate(here)])
        blocked = F.greatest(state["blocked"], *[F.when(h, b["end"]) for h, b in zip(here, begins, strict=True)])
        hot = (end >= w) & (total <= F.lit(limit + 1e-9)) & (blocked <= end - w)
        last = F.element_at(state["out"], -1)
        joins = (F.size(state["out"]) > 0) & (F.get(state["out"], F.size(state["out"]) - 1)["end"] >= end - w)
        span = F.struct((end - w).alias("start"), end.alias("end"), F.lit(3).alias("kind"))
        longer = F.struct(last["start"].alias("start"), end.alias("end"), F.lit(3).alias("kind"))
        out = F.when(~hot, state["out"]).when(
            joins, F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(longer))
        ).otherwise(F.concat(state["out"], F.array(span)))
        return F.struct(counts.alias("n"), total.alias("sum"), end.alias("at"), out.alias("out"),
                        begun.alias("begun"), blocked.alias("blocked"))

    begin = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"),
        F.array().cast(SPAN).alias("out"), F.array_repeat(F.lit(0), len(PARTS)).alias("begun"), F.lit(0).cast("long").alias("blocked"))
    # each character next to the one that leaves: the codes are made twice, not once a character
    old = F.slice(F.concat(F.array_repeat(F.lit(-1), w), codes), 1, F.char_length(candidate))
    moves = F.zip_with(codes, old, lambda c, o: F.struct(c.alias("new"), o.alias("old")))
    return F.aggregate(moves, begin, step, lambda state: state["out"])


def entropy_spans(text: Column, base: Column, kind: CharClass) -> Column:
    """Spans of high entropy, without what the allow-list covers and the base spans' characters; what these leave
    of a span counts where it still holds a whole window."""
    found = F.arrays_zip(
        F.transform(F.split(text, kind.run, -1), _length).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.run), F.lit(0)).alias("match"))

    def placed(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(_length(x["match"]), F.lit(0).cast("long"))
        row = F.struct(start.alias("start"), x["match"].alias("match"), allowed_spans(x["match"]).alias("allowed"))
        return F.struct(end.alias("at"), F.when(
            x["match"].isNotNull() & F.rlike(x["match"], F.lit(kind.needs)) & ~reduce(
                lambda a, b: a | b, [F.rlike(x["match"], F.lit(p)) for p in WHOLE]),
            F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
        f"array<struct<start: bigint, match: string, allowed: array<{SPAN}>>>").alias("out"))
    candidates = F.aggregate(found, begin, placed, lambda state: state["out"])
    spans = F.flatten(F.transform(candidates, lambda c: F.transform(hot_windows(c["match"], c["allowed"], kind), lambda s: F.struct(
        (s["start"] + c["start"]).alias("start"), (s["end"] + c["start"]).alias("end"), F.lit(kind.window).alias("least")))))
    return outside(spans, base)


def scan(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """Add ``name``: all spans (start, end, kind) in code points, by start and then kind.

    Base kinds are assign, access and hex; ``entropy`` spans are added without the
    characters of base spans, where at least a whole window of theirs is left. A null text has no spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_base", F.array_sort(base_spans(body)))
    more = [_where(F.rlike(body, F.lit(c.run)), entropy_spans(body, F.col("_base"), c)) for c in CLASSES]
    step = step.withColumn("_more", F.array_distinct(F.concat(*more)))
    return step.withColumn(name, F.array_sort(F.transform(
        F.concat("_base", "_more"),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))).drop("_base", "_more")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text", by: str = MASK) -> DataFrame:
    """The documents with every found secret replaced by ``by``; overlapping spans are one.

    Texts without a secret stay as they are (null stays null); ``n_chars`` follows the text.
    """
    found = scan(docs, text, "_spans")
    edges = F.aggregate(
        "_spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda state, s: F.when(s["end"] <= state["at"], state).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], F.array(
                F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")),
                F.lit(by)))).alias("out"))),
        lambda state: F.concat(F.array_join(state["out"], ""), F.substring(
            F.col(text), (state["at"] + 1).cast("int"), F.char_length(F.col(text)))))
    masked = found.withColumn(text, F.when(F.size("_spans") > 0, edges).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(
            F.size("_spans") > 0, F.char_length(text).cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
