"""Quality rules: a table of thresholds compiled into one projection.

Everything is a column expression; no function of a user runs and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.llm.common import BLANK
from contentgauge.operators.shape import once

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
# stop words of the four languages of the corpus
STOP_WORDS = (
    "the of and to in is that for with on as it was by are this from at or an "
    "de la le les et des en du un une que qui dans pour par sur au est avec "
    "der die das und den von zu mit ist im ein eine für auf dem des sich nicht "
    "el los las y del se por con una para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


# base rules: documents that fail them are out whatever the others say
BASE_RULES = (Rule("n_words", low=10), Rule("repeat_percent", high=20))
METHOD_RULES = (
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbol_ratio", high=0.3),
    Rule("stop_share", low=0.04),
    Rule("dup_line_share", high=0.5),
    Rule("adjacent_share", high=0.3),
    Rule("shout_share", high=0.5),
)


def _from(array: str, k: int) -> Column:
    """The array without its first ``k`` values."""
    return F.slice(array, k + 1, F.greatest(F.size(array) - k, F.lit(0)))


def _joined(left: str, right: Column, bits: int) -> Column:
    """Hashes of longer windows: two arrays of hashes put together place by place."""
    return F.zip_with(left, right, lambda a, b: F.shiftleft(a, bits).bitwiseXOR(b))


def _steps(text: Column) -> list[dict[str, Column]]:
    """Projections, each reading columns of those before it.

    Windows are hashed first: a text whose window hashes all differ (nearly every one) has no
    repeated window. Only the others build the windows themselves.
    """
    size, found = F.size("_words"), F.col("_words")
    return [
        {
            "_text": text,
            "_words": F.array_remove(F.split(text, BLANK), ""),
            "_lines": F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_shout": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")),
        },
        {
            "n_words": size.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines"),
            "_stop": F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))),
            "_h1": F.transform("_words", lambda w: F.xxhash64(w)),
        },
        {
            "_h2": _joined("_h1", _from("_h1", 1), 1),
            "_adjacent": F.size(F.filter(F.zip_with("_h1", _from("_h1", 1), lambda a, b: a == b), lambda x: x)),
        },
        {"_h4": _joined("_h2", _from("_h2", 2), 2)},
        {"_h5": F.slice(_joined("_h4", _from("_h1", WINDOW - 1), 1), 1, F.greatest(size - (WINDOW - 1), F.lit(0)))},
        {"n_repeat_words": F.when(F.size(F.array_distinct("_h5")) == F.size("_h5"), F.lit(0).cast("long")).otherwise(
            _covered(F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)),
                                 lambda i: F.array_join(F.slice(found, i, WINDOW), " "))))},
    ]


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort (window, place), keep the places of
    windows equal to a neighbour, and add up the union of their spans."""
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(rows: Column) -> Column:
        repeated = F.filter(
            F.transform(rows, lambda x, k: F.struct(x["i"].alias("i"), (
                ((k > 0) & (F.get(rows, k - 1)["w"] == x["w"])) | F.coalesce(F.get(rows, k + 1)["w"] == x["w"], F.lit(False))
            ).alias("twice"))),
            lambda x: x["twice"])
        return F.array_sort(F.transform(repeated, lambda x: x["i"]))

    def union(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, n: total + n)

    def named(value: Column, f) -> Column:  # bind the value to a name, so it is computed once
        return F.get(F.transform(F.array(value), f), F.lit(0))

    return named(named(ordered, places), union)


RATIOS = {
    "repeat_percent": lambda: F.try_divide(100 * F.col("n_repeat_words"), F.col("n_words")),
    "mean_word_chars": lambda: F.try_divide(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: F.try_divide(F.col("n_symbols"), F.col("n_words")),
    # a short text may well do without stop words
    "stop_share": lambda: F.when(F.col("n_words") >= 30, F.col("_stop") / F.col("n_words")),
    "adjacent_share": lambda: F.try_divide(F.col("_adjacent"), F.col("n_words")),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
    "shout_share": lambda: F.try_divide(F.col("_shout"), F.col("n_words")),
    "n_words": lambda: F.col("n_words"),
}


def broken(rules) -> Column:
    """True where a rule of the table is broken; a ratio over no words breaks none."""
    tests = []
    for rule in rules:
        value = RATIOS[rule.measure]()
        if rule.low is not None:
            tests.append(F.coalesce(value < F.lit(rule.low), F.lit(False)))
        if rule.high is not None:
            tests.append(F.coalesce(value > F.lit(rule.high), F.lit(False)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """All columns of ``docs`` plus the measures, ``base_failed`` and ``kept``.

    A null text is one without words. Columns of the same names are replaced.
    """
    names = docs.columns
    holder = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    step = reduce(lambda df, columns: df.withColumns(columns), _steps(F.coalesce(F.col("_row")[text], F.lit(""))), holder)
    step = step.withColumn("base_failed", broken(base))
    step = step.withColumn("kept", ~F.col("base_failed") & ~broken(rules))
    added = [*MEASURES, "base_failed", "kept"]
    return step.select(*[F.col("_row")[c].alias(c) for c in names if c not in added], *added)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass every rule, with their own columns."""
    names = docs.columns
    judged = assess(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"),
                                F.col(f"`{text}`").alias("_body")), "_body")
    return once(judged, _kept=F.col("kept")).where("_kept").select(*[F.col("_doc")[c].alias(c) for c in names])
