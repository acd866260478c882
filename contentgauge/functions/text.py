"""Text normalisation, tokens and closed-lexicon counting as column functions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, functions as F

TOKEN = "[a-z0-9']+"
RAW_TOKEN = "[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ0-9']+"
WORD_CHAR = r"[\p{L}\p{N}_]"
WHITE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"


@lru_cache(maxsize=2)
def _fold_table(compatibility: bool) -> tuple[str, str]:
    """Characters whose decomposition is one base letter plus marks, and the marks
    themselves (they have no counterpart, so ``translate`` drops them)."""
    form = "NFKD" if compatibility else "NFD"
    source, target, marks = [], [], []
    for code in range(0xA0, sys.maxunicode + 1):
        ch = chr(code)
        category = unicodedata.category(ch)
        if category == "Mn":
            marks.append(ch)
        elif category in ("Ll", "Lo", "Lu", "Lt", "No", "So", "Sm", "Po"):
            parts = unicodedata.normalize(form, ch)
            if parts == ch:
                continue
            base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
            if len(base) == 1 and base != ch:
                source.append(ch)
                target.append(base)
    return "".join(source) + "".join(marks), "".join(target)


def fold(c: Column) -> Column:
    """Lower case without accents; null becomes the empty string."""
    source, target = _fold_table(False)
    return F.coalesce(F.translate(F.lower(c), source, target), F.lit(""))


def quiz_fold(c: Column) -> Column:
    """Lower case, no marks, only letters and digits, single blanks."""
    source, target = _fold_table(True)
    plain = F.translate(F.lower(c), source, target)
    plain = F.regexp_replace(plain, r"[^a-z0-9ñ ]+", " ")
    # blanks are the only white space left; single ones stay as they are
    return F.coalesce(F.trim(F.regexp_replace(plain, r" {2,}", " ")), F.lit(""))


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def raw_word_count(c: Column) -> Column:
    """Words of a text that was not folded first."""
    return F.coalesce(F.regexp_count(c, F.lit(RAW_TOKEN)), F.lit(0))


def blank_words(c: Column) -> Column:
    """Words between runs of white space (none for a blank text)."""
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{WHITE}|{WHITE}$", "")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


# ------------------------------------------------------------------ lexicons


def _is_word(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def _overlaps_itself(phrase: str) -> bool:
    return any(
        phrase[shift:] == phrase[:-shift] and not _is_word(phrase[shift - 1])
        for shift in range(1, len(phrase))
    )


def _opens_with(phrase: str, head: str) -> bool:
    """``head`` is found wherever ``phrase`` is, starting at the same place."""
    return phrase.startswith(head) and (len(phrase) == len(head) or not _is_word(phrase[len(head)]))


def _branches(words: list[str]) -> str:
    """One regex for the words, sharing their beginnings; the longest wins."""
    heads: dict[str, list[str]] = {}
    for word in words:
        if word:
            heads.setdefault(word[0], []).append(word[1:])
    options = [re.escape(ch) + _branches(sorted(set(rest))) for ch, rest in sorted(heads.items())]
    if not options:
        return ""
    body = options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"
    return f"(?:{body})?" if "" in words else body


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(words: Iterable[str]) -> str:
    return ", ".join(sql_text(w) for w in words)


class PhraseScan:
    """Finds the phrases of many closed lists in one pass over a text.

    A phrase counts where it is not glued to another letter or digit, and
    phrases that overlap each count. One look-ahead regex finds, at every word
    start, the longest listed phrase; shorter phrases opening at the same place
    are known from the list, so they are added without another scan. A phrase
    that can overlap itself is counted apart, from left to right.
    """

    def __init__(self, phrases: Iterable[str]):
        everything = sorted(set(phrases))
        self.alone = [p for p in everything if _overlaps_itself(p)]
        self.listed = [p for p in everything if p not in self.alone]
        self.pattern = rf"(?<![a-z0-9])(?=({_branches(self.listed)})(?![a-z0-9]))"

    def hits(self, folded: Column) -> Column:
        """array<string>: the longest listed phrase at every word start that opens one."""
        if not self.listed:
            return F.array().cast("array<string>")
        return F.regexp_extract_all(folded, F.lit(self.pattern), F.lit(1))

    def count(self, hits: str, folded: str, phrases: Iterable[str]) -> Column:
        """Occurrences of ``phrases`` (one listed twice counts twice); ``hits`` and
        ``folded`` are column names."""
        wanted = list(phrases)
        by_weight: dict[int, list[str]] = {}
        for phrase in self.listed:
            weight = sum(_opens_with(phrase, w) for w in wanted if w not in self.alone)
            if weight:
                by_weight.setdefault(weight, []).append(phrase)
        terms = [f"{w} * size(filter({hits}, h -> h in ({sql_list(g)})))" for w, g in sorted(by_weight.items())]
        terms += [
            f"regexp_count({folded}, {sql_text(rf'(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])')})"
            for p in wanted if p in self.alone
        ]
        return F.expr(" + ".join(terms) or "0")


def count_phrases(folded: Column, phrases: Iterable[str]) -> Column:
    """Occurrences of a closed list, for short texts such as titles."""
    phrases = list(phrases)
    scan = PhraseScan(phrases)
    weights = {p: sum(_opens_with(p, w) for w in phrases if w not in scan.alone) for p in scan.listed}
    table = F.expr(f"map({', '.join(f'{sql_text(p)}, {w}' for p, w in weights.items())})")
    total = F.aggregate(scan.hits(folded), F.lit(0), lambda n, h: n + F.try_element_at(table, h))
    for phrase in [p for p in phrases if p in scan.alone]:
        total = total + F.regexp_count(folded, F.lit(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])"))
    return total


# ------------------------------------------------------------------ languages


def lexicon_language(video_language: Column, transcript_language: Column, first: str = "video") -> Column:
    """'en' or 'es': which lists to count. ``first`` names the column that decides."""
    a, b = F.nullif(video_language, F.lit("")), F.nullif(transcript_language, F.lit(""))
    chosen = F.coalesce(a, b) if first == "video" else F.lower(F.coalesce(b, a))
    return F.when(F.startswith(chosen, F.lit("en")), F.lit("en")).otherwise(F.lit("es"))


def looks_spanish(c: Column) -> Column:
    """At least 8 letter words, at least 12 % of them Spanish function words."""
    from contentgauge.functions.lexicons import SPANISH_MARKERS

    words = F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0))
    marks = F.size(F.filter(words, lambda w: w.isin(SPANISH_MARKERS)))
    return (F.size(words) >= 8) & (marks / F.greatest(F.size(words), F.lit(1)) >= 0.12)


def language_base(c: Column) -> Column:
    return F.split_part(c, F.lit("-"), F.lit(1))


def json_list(c: Column) -> Column:
    """A JSON list of strings as an array; anything else is the empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
