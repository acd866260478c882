"""The indicators in SQL, written apart from the Spark code, for the oracle."""

from __future__ import annotations

import re

from contentgauge.functions import lexicons as L

LEX = L.STAND_IN_LEXICONS


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rounded(x: str, digits: int) -> str:
    return f"(round_even(cast({x} as double) * 1e{digits}, 0)::double / 1e{digits})"


def phrase_count(phrases: list[str], doubled: str = "dbl") -> str:
    """Separators are doubled in the text, so neighbours can share none of them."""
    parts = []
    for p in phrases:
        body = "".join(c if c.isascii() and c.isalnum() else re.escape(c) * 2 for c in p)
        parts.append(f"len(regexp_extract_all({doubled}, {text('[^a-z0-9]' + body + '[^a-z0-9]')}))")
    return "(" + " + ".join(parts) + ")"


def doubled(folded: str) -> str:
    return f"(' ' || regexp_replace({folded}, '([^a-z0-9])', '\\1\\1', 'g') || ' ')"


def by_language(key: str) -> str:
    return f"(case when lang = 'en' then {phrase_count(LEX[key]['en'])} else {phrase_count(LEX[key]['es'])} end)"


def values_list(words) -> str:
    return "[" + ", ".join(text(w) for w in dict.fromkeys(words)) + "]"


def category_case(column: str = "category_id") -> str:
    whens = " ".join(f"when {text(k)} then {text(v)}" for k, v in L.CATEGORY_FORMAT.items())
    return f"(case {column} {whens} end)"


def category_name_case(column: str = "category_id") -> str:
    whens = " ".join(f"when {text(k)} then {text(v)}" for k, v in L.CATEGORY_NAMES.items())
    return f"(case {column} {whens} end)"


def duration_case(column: str = "duration_seconds") -> str:
    return (f"(case when {column} < 120 then null when {column} < 600 then 'corto' when {column} < 1800 then 'medio' "
            f"when {column} <= 10800 then 'largo' end)")


def host_pattern(hosts: list[str]) -> str:
    return "(?i)(" + "|".join(re.escape(h) for h in hosts) + ")"


# digits: runs of digits, points and commas with the letters that touch them
NUMBER_RUNS = r"""len(list_filter(
   list_transform(regexp_extract_all(regexp_replace(tnorm, '([a-z])', '\1\1', 'g'), '[a-z]?[0-9.,]+[a-z]?'),
     lambda m: struct_pack(after := regexp_matches(m, '[a-z]$'),
       body := regexp_extract(case when regexp_matches(m, '^[a-z][0-9]')
         then substring(regexp_replace(m, '[a-z]', '', 'g'), 2) else regexp_replace(m, '[a-z]', '', 'g') end,
         '[0-9].*'))),
   lambda r: r.body <> '' and (not r.after or length(r.body) >= 2)))"""
WORDY = r"(' ' || regexp_replace(tnorm, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ')"

TOKENS = rf"""
tok0 as materialized (
 select *, coalesce(strip_accents(lower(transcript)), '') as tnorm,
   coalesce(strip_accents(lower(title)), '') as title_n,
   case when transcript_lang like 'en%' then 'en' else 'es' end as lang,
   {category_case()} as formato, {duration_case()} as duracion,
   nullif(duration_seconds, 0) / 60e0 as minutes
 from content_v),
tok1 as materialized (
 select *, regexp_extract_all(tnorm, '[a-z0-9'']+') as toks, {doubled('tnorm')} as dbl, {doubled('title_n')} as title_dbl,
   len(regexp_extract_all(coalesce(transcript, ''), '[.!?…]')) as marks,
   regexp_extract_all(coalesce(description, ''), {text(L.URL_PATTERN)}) as urls
 from tok0),
tok as materialized (
 select *, len(toks) as n, len(toks) / (minutes * 150e0) as ratio,
   list_filter(toks, lambda t: not list_contains({values_list(L.STOP_WORDS['en'])}, t)
     and not (lang <> 'en' and list_contains({values_list(L.STOP_WORDS['es'])}, t))
     and not regexp_full_match(t, '[0-9]+')) as content,
   list_filter(regexp_extract_all(title_n, '[a-z0-9'']+'), lambda t: length(t) > 3
     and not list_contains({values_list(L.STOP_WORDS['en'])}, t)
     and not (lang <> 'en' and list_contains({values_list(L.STOP_WORDS['es'])}, t))) as keys
 from tok1),
gate as materialized (
 select *, coalesce(n > 0 and ratio between 0.45e0 and 1.6e0, false) as complete,
   (coalesce(n > 0 and ratio between 0.45e0 and 1.6e0, false) and category_id is not null) as apt
 from tok)"""

SOCIAL = text(host_pattern(L.SOCIAL_HOSTS))
TRACEABLE = text(host_pattern(L.TRACEABLE_HOSTS))


def rate(key: str) -> str:
    return f"({by_language(key)} / nullif(n, 0)::double * 1e3)"


COLUMNS = {
    "ritmo_ppm": rounded("case when n > 0 then n / minutes end", 1),
    "cifras_100w": rounded(f"({NUMBER_RUNS} + {phrase_count(L.NUMBER_WORDS)}) / nullif(n, 0)::double * 1e2", 2),
    "atribucion_1000w": rounded(rate("atribucion"), 2),
    "mattr_200": rounded(
        "case when n = 0 then null when n < 200 then len(list_distinct(toks)) / n::double else "
        "list_sum(list_transform(range(0, n - 199, 50), lambda i: len(list_distinct(toks[i + 1 : i + 200]))))::double "
        "/ (len(range(0, n - 199, 50)) * 2e2) end", 4),
    "conectores_1000w": rounded(rate("conectores"), 2),
    "enlaces_externos": f"len(list_filter(urls, lambda u: not regexp_matches(u, {SOCIAL})))::int",
    "promocional_1000w": rounded(f"{rate('cta')} + {rate('patrocinio')}", 2),
    "cobertura_titulo": rounded(
        "case when len(keys) > 0 and n > 0 then len(list_intersect(list_distinct(keys), toks)) "
        "/ len(list_distinct(keys))::double end", 3),
}
PANEL_SELECT = ",\n   ".join(f"{COLUMNS[d]} as {d}" for d in L.PANEL)
PANEL = TOKENS + f""",
feat as materialized (
 select content_id, corpus, channel, category_id, formato, duracion, duration_seconds, lang, n, complete, apt,
   {PANEL_SELECT}
 from gate)"""
LONG = PANEL + """,
long as materialized (
 select content_id, corpus, formato, duracion, duration_seconds, apt, descriptor, value from (
   select * replace (cast(enlaces_externos as double) as enlaces_externos) from feat)
 unpivot include nulls (value for descriptor in (%s)))""" % ", ".join(L.PANEL)
